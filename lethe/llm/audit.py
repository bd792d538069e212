"""How a set of filters interacts: what each would remove in every order in which they can be applied.

A document's row is reduced to a mask, a bit a filter it fails, and the masks are counted per part; everything about the
orders follows from those counts, so the texts are read twice at most and no order is ever run.

The filter for repeated texts works by partition refinement. Documents are split by length, then by the hash of one block
after the other, and whoever is left alone goes at once, so few rows reach the later blocks. Blocks grow eightfold, which
keeps the rounds few for texts of any length. The full texts of those left are compared with
their class's representative, the one of smallest id; large classes are dealt over many tasks. A text
that differs from its representative, its hashes being equal by chance, is compared with all others of the kind.

Null texts are empty ones; a null lang is the part of the empty string. Rows without an id never fail the filter for
repeats and cause no one to; rows of one id and one text do not repeat each other. A document has a label if any row of
labels for its id has it. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import saved, sized_broadcast

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
#: The bit of the filter for repeated texts.
REPEAT = 1 << FILTERS.index("E")
#: Where blocks of a text begin, in code points: eight times as far each, up to what a string can hold.
BOUNDS = (0, *(256 * 8**i for i in range(8)))
#: Classes whose key may be broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_CLASSES = 200_000
#: Documents that are compared with one copy of their representative.
GROUP = 1_000


def text_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text, size) of docs(doc_id, lang, text), with the size worked out once."""
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_of(F.col("text")).alias("text")).withColumn("size", F.length("text"))


def masked(rows: DataFrame) -> DataFrame:
    """rows(text, size) with mask, the bits of the filters that one text decides: few words, repeated words, capitals, odd signs."""
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("n_words", F.size("words"))
    few = F.col("n_words") < 100
    dull = F.size(F.array_distinct("words")) * 100 < F.col("n_words") * 80
    loud = F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.col("size") * 10
    odd = F.col("text").rlike(r"[#$%&*|]")
    return rows.withColumn("mask", sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate((few, dull, loud, odd))), F.lit(0))).drop("words", "n_words")


def block_hashes(text: Column, size: Column) -> Column:
    """array<bigint>: the hash of each block that the text reaches into."""
    bounds = F.array(*(F.lit(b) for b in BOUNDS))
    reached = F.filter(bounds, lambda b: b < size)
    width = lambda b: F.when(b == 0, BOUNDS[1]).otherwise(b * 7)
    return F.transform(reached, lambda b: F.xxhash64(F.substring(text, b + 1, width(b))))


def _whole(size: Column, hashes: Column) -> Column:
    """The class of a text once all its blocks have been looked at."""
    return F.aggregate(hashes, F.xxhash64(size), lambda acc, h: F.xxhash64(acc, h))


def refined(rows: DataFrame) -> DataFrame:
    """(size, key, lo, many): classes of rows(doc_id, size, hashes) that agree in length and all blocks, with smallest id and rows."""
    active, at = rows.select("doc_id", "size", "hashes", F.xxhash64("size").alias("key")), 0
    while True:
        classes = active.groupBy("size", "key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("many"), F.max(F.size("hashes")).alias("blocks"))
        classes = saved(classes.where("lo < hi"), "classes")
        found = classes.agg(F.count("*"), F.max("blocks")).first()
        if not found[0] or at >= found[1]:
            return classes.drop("hi", "blocks")
        held = active.join(sized_broadcast(classes.select("size", "key"), found[0], BROADCAST_CLASSES), ["size", "key"], "left_semi")
        block = F.get("hashes", F.lit(at))
        active = saved(held.withColumn("key", F.when(block.isNull(), F.col("key")).otherwise(F.xxhash64("key", block))), "active")
        at += 1


def repeats(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of the docs whose text a row of smaller doc_id has; rows are theirs with size and hashes."""
    classes = refined(rows.where("doc_id is not null"))
    texts = measured(docs.where("doc_id is not null")).withColumn("key", _whole(F.col("size"), block_hashes(F.col("text"), F.col("size"))))
    texts = texts.join(sized_broadcast(classes, classes.count(), BROADCAST_CLASSES), ["size", "key"])
    texts = texts.withColumn("shares", F.expr(f"(many + {GROUP - 1}) div {GROUP}").cast("int"))
    first = texts.where("doc_id = lo").groupBy("size", "key", "shares").agg(F.min("text").alias("first"))
    first = first.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    others = texts.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int"))
    same = F.col("text") == F.col("first")
    compared = others.join(first, ["size", "key", "share"]).where(~same | (F.col("doc_id") > F.col("lo")))
    out = masked(compared).select("doc_id", "part", "mask", "size", "key", F.when(~same, F.col("text")).alias("text"))
    out = saved(out, "repeats")
    odd = out.where("text is not null")
    if odd.limit(1).count():
        lo = odd.groupBy("size", "key", "text").agg(F.min("doc_id").alias("lo"))
        out = out.where("text is null").unionByName(odd.join(lo, ["size", "key", "text"]).where("doc_id > lo").drop("lo"))
    return out.select("doc_id", "part", "mask")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n) of rows(doc_id, part, mask), counted by id before they meet their labels."""
    has = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(has("quality").alias("good"), has("toxic").alias("bad"))
    counted = rows.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    return counted.groupBy("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad")).agg(F.sum("n").alias("n"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, and those of them labelled good or toxic."""
    rows = masked(measured(docs))
    rows = saved(rows.select("doc_id", "part", "mask", "size", block_hashes(F.col("text"), F.col("size")).alias("hashes")), "masks")
    again = _labelled(repeats(docs, rows), labels)
    moved = again.withColumn("n", -F.col("n")).unionByName(again.withColumn("mask", F.col("mask") + REPEAT))
    counts = _labelled(rows, labels).unionByName(moved)
    return counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic"))


def interaction(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from counts(part, mask, n, good, toxic)."""
    orders = ",".join("".join(o) for o in permutations(FILTERS))
    listed = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    rows = listed.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    letters = F.split("filter_order", "")
    rows = rows.withColumn("bit", bit_of(F.get(letters, F.col("step") - 1)))
    rows = rows.withColumn("before", F.aggregate(F.slice(letters, F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, x: acc + bit_of(x)))
    bit, before = F.col("bit"), F.col("before")
    total = lambda what, test: F.aggregate(F.filter("m", test), F.lit(0).cast("long"), lambda acc, x: acc + what(x))
    fails = lambda x: x["mask"].bitwiseAND(bit) != 0
    clean = lambda x: x["mask"].bitwiseAND(before) == 0
    n = lambda x: x["n"]
    # of the orders of k failed filters each comes first equally often
    share = lambda x: x["n"] * 120 / F.bit_count(x["mask"])
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(n, lambda x: x["mask"].bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(n, lambda x: fails(x) & clean(x)).alias("removed"),
        total(n, lambda x: fails(x) & ~clean(x)).alias("redundant"),
        total(n, lambda x: x["mask"] == bit).alias("unique_fails"),
        total(lambda x: x["good"], lambda x: fails(x) & clean(x)).alias("good_lost"),
        total(lambda x: x["toxic"], lambda x: fails(x) & clean(x)).alias("toxic_lost"),
        total(lambda x: share(x).cast("long"), fails).alias("shapley"),
    )


def op12_filter_interaction(spark, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, by language."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return interaction(masks(read("documents"), read("labels")))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lo FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > lo, false)] AS fails
  FROM w LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id) USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, fails),
l AS (SELECT unnest(range(1, 6)) AS x),
o AS (SELECT row_number() OVER () AS order_, [a.x, b.x, c.x, d.x, e.x] AS fs FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT array_to_string(list_transform(fs, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(l.x AS INT) AS step, fs[l.x] AS f, fs[1:l.x - 1] AS before FROM o, l),
r AS (SELECT part, filter_order, step, f, n, good, bad, fails[f] AS own, len(list_filter(before, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS k FROM c, s),
g AS (SELECT part, filter_order, step, f, CAST(sum(CASE WHEN own OR gone THEN 0 ELSE n END) AS BIGINT) AS kept, CAST(sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN own AND k = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN own AND NOT gone THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
"""
