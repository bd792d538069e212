"""Document fingerprints by consistent weighted sampling.

A document is the set of its lower-cased words, weighted by how often each occurs. For sample k and word w, r and c are
gamma(2, 1) and b uniform numbers drawn from a hash of (w, k) alone. With t = floor(ln(weight) / r + b) the
word's value is ln c - r (t + 1 - b), and the sample is the least value over the document's words. Two
documents have the same sample with the probability of their generalised Jaccard similarity, the sum of
smaller over the sum of larger weights. Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import saved, sized_broadcast

SAMPLES = 32
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 100_000


def samples(rows: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """(keys..., sketch array<double>) of rows(keys..., word), a row for each occurrence."""
    words = rows.groupBy(*keys, "word").agg(F.count("*").alias("weight")).select(*keys, F.xxhash64("word").alias("h"), F.log("weight").alias("lw"))
    unit = 2.0**-32
    least = []
    for k in range(n):
        one, two, three = (F.xxhash64("h", F.lit(3 * k + i)) for i in range(3))
        low = lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) * unit
        high = lambda x: (F.shiftrightunsigned(x, 32) + F.lit(0.5)) * unit
        gamma = lambda x: -F.log(low(x) * high(x))
        r, c, b = gamma(one), gamma(two), low(three)
        least.append(F.min(F.log(c) - r * (F.floor(F.col("lw") / r + b) + 1 - b)).alias(f"s{k}"))
    return words.groupBy(*keys).agg(*least).select(*keys, F.array(*(f"s{k}" for k in range(n))).alias("sketch"))


def words(text: Column) -> Column:
    """The words of a text; of one without any, a single empty word, so that all such texts are alike."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a).cast("double")


def shown(sketch: Column) -> Column:
    """Eight hexadecimal digits of each sample."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(x), 32))), 8, "0")), "")


def fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(doc_id, sketch array<double>, fingerprint) of every row of docs(doc_id, text, ...); a null text is an empty one.

    Rows that share a doc_id and a text are one row.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    out = samples(rows.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.explode(words(F.col("text"))).alias("word")), ["doc_id", "th"], n)
    return out.select("doc_id", "sketch", shown(F.col("sketch")).alias("fingerprint"))


def ranked(ids: DataFrame) -> DataFrame:
    """ids(doc_id, th, ...) with r, a gapless rank from 0 by falling doc_id (nulls last), then th.

    Rows are dealt by range and written with their range's number, so that ranks do not depend on a second
    sampling; a range's rows are counted, and only those counts, one a partition, are summed in one place.
    """
    dealt = ids.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.col("th")).withColumn("part", F.spark_partition_id())
    dealt = saved(dealt, "ranges")
    first = dealt.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("first"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), "th"))
    return dealt.withColumn("w", within).join(sized_broadcast(first, first.count(), BROADCAST_ROWS), "part").withColumn("r", F.col("first") + F.col("w") - 1).drop("part", "w", "first")


def edited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, ids): texts(fk, th, text, new), the text and its edit, and ids(fk, th, doc_id, times, r, n).

    The edit replaces the last floor(n / 2) code points by the first as many, or all, of the next document's,
    in the order of ``ranked``; after the last comes the first. Of rows equal in doc_id and text one is ranked.
    A text is shuffled once, and the part of it that its neighbour needs once more.
    """
    shown = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("fk", F.xxhash64(shown, F.col("doc_id").isNull())).withColumn("th", F.xxhash64("text"))
    ids = saved(rows.groupBy("fk", "th", "doc_id").agg(F.count("*").alias("times"), F.first(F.length("text")).alias("n")), "ids")
    twice = saved(ids.where("times > 1").select("fk", "th"), "twice")
    small = sized_broadcast(twice, twice.count(), BROADCAST_ROWS)
    key = ["fk", "th"]
    rows = rows.drop("doc_id")
    unique = rows.join(small, key, "left_anti").unionByName(rows.join(small, key, "left_semi").dropDuplicates(key))
    ids = saved(ranked(ids), "ranks")
    count = F.lit(max(ids.count(), 1))
    before = ids.select(F.pmod(F.col("r") + 1, count).alias("r"), F.col("fk").alias("fk_before"), F.col("th").alias("th_before"), F.col("n").alias("n_before"))
    place = saved(ids.join(before, "r").select("fk", "th", "n", "fk_before", "th_before", "n_before"), "places")
    placed = unique.join(place, key)
    head = placed.select(F.col("fk_before").alias("fk"), F.col("th_before").alias("th"), F.expr("left(text, cast(n_before div 2 as int))").alias("head"))
    both = placed.select("fk", "th", "text", "n").join(head, key)
    return both.withColumn("new", F.concat(F.expr("left(text, cast(n - n div 2 as int))"), F.col("head"))).drop("head", "n"), ids


def op9_weighted_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness and that to the next document's.

    A null text is an empty one. A document repeated as a whole has its own copy as the next but for the last.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, ids = edited(docs)
    part = lambda k, text, digest: F.struct(F.lit(k).alias("k"), words(text).alias("w"), digest.alias("sha"))
    both = F.array(part(0, F.col("text"), F.lit(None).cast("binary")), part(1, F.col("new"), F.unhex(F.sha2("new", 256))))
    each = texts.select("fk", "th", F.explode(both).alias("x")).select("fk", "th", F.col("x.k").alias("k"), F.col("x.sha").alias("sha"), F.explode("x.w").alias("word"))
    # the rows of a text are already together, so neither count nor minimum shuffles
    sketches = saved(samples(each, ["fk", "th", "k", "sha"]), "sketches")
    key = ["fk", "th"]
    count = F.lit(max(ids.count(), 1))
    own = sketches.where("k = 0").select(*key, F.col("sketch").alias("own"))
    new = sketches.where("k = 1").select(*key, F.col("sketch").alias("new"), F.lower(F.hex("sha")).alias("edited_sha256"))
    own = saved(ids.join(own, key), "own")
    after = own.select(F.pmod(F.col("r") - 1, count).alias("r"), F.col("own").alias("after"))
    out = own.join(after, "r").join(new, key)
    copies = saved(out.where("times > 1").select(*key, "doc_id", "times", "n", "own"), "copies")
    last = out.select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("new")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"))
    return last if copies.isEmpty() else last.unionByName(_copies(copies, texts))


def _copies(copies: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of the repeated documents but for the last of each: the next document is the same text, the edit its first half twice."""
    key = ["fk", "th"]
    half = F.concat(F.expr("left(text, cast(length(text) - length(text) div 2 as int))"), F.expr("left(text, cast(length(text) div 2 as int))"))
    wanted = copies.select(*key)
    once = texts.join(sized_broadcast(wanted, wanted.count(), BROADCAST_ROWS), key, "left_semi").select(*key, half.alias("half"))
    sketch = samples(once.select(*key, F.unhex(F.sha2("half", 256)).alias("sha"), F.explode(words(F.col("half"))).alias("word")), [*key, "sha"])
    rows = copies.withColumn("i", F.explode(F.sequence(F.lit(2), F.col("times").cast("int")))).join(sketch, key)
    return rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), shown(F.col("own")).alias("fingerprint"), shown(F.col("sketch")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("sketch")).alias("near_edited"), F.lit(1.0).alias("near_next"))
