"""Personal data: fixed-shape identifiers, and the terms that co-occurrence in the corpus ties to them.

The identifiers found by shape are the protected entities, each as its whole value and as what recurs of it: an
address's domain and holder, a number's leading digits, a network. How strongly a term t reveals an entity e is

    PMI(t; e) / IC(e),   PMI = log2(N n(t, e) / (n(t) n(e))),   IC = -log2(n(e) / N),

with N documents, n(t) of which hold t, n(e) hold e and n(t, e) both, all counted over whole texts. 1 means that whoever
sees t knows e. Whether the corpus shows that tie at all is a likelihood ratio: of the texts with t, the share that hold e
against the share among all, which must be beyond chance for as many terms as the vocabulary has. Texts that are
copies of each other, near ones as well, are one observation there. In documents that hold e, terms above a threshold
are generalised, above a higher one removed. Everything is DataFrame work; offsets are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import saved, sized_broadcast

KINDS = ("email", "ip", "card", "phone", "term")
# The shapes, written so that the engine never backtracks into a run: possessive runs that start where a run does
# (or where the last match ended) find the same leftmost matches in linear time.
_LOCAL = "A-Za-z0-9._%+-"
SHAPES = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
WORD = r"[\p{L}\p{N}]+"
#: Chance that any term of the vocabulary is tied to an entity wrongly, and the thresholds of disclosure.
ALPHA, GENERALISE, REMOVE = 0.01, 0.6, 0.9
#: Rows (an entity, a term or an id each) that may be broadcast.
BROADCAST_ROWS = 100_000
LABELS = {"email": "[email]", "ip": "[ip]", "card": "[card]", "phone": "[phone]"}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits, doubled at every second place from the right, sum to a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.expr("0") + F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP)
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, pattern: Column, kind: str) -> Column:
    """array<struct<s, k, e>> of the valid matches: lengths of the pieces between and of the matches add up to offsets."""
    found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    start = lambda acc, x: acc["at"] + x["gap"]

    def step(acc, x):
        end = start(acc, x) + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(start(acc, x).alias("s"), F.lit(KINDS.index(kind)).alias("k"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & _valid(kind, x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Spans of all four shapes, by start, then kind; a text without their characters is not searched."""
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    when = {"email": text.contains("@"), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9][\\x20-]?[0-9]"), "phone": text.rlike("\\+[0-9]")}
    return F.array_sort(F.concat(*(F.when(when[k], _spans(text, F.lit(SHAPES[k]), k)).otherwise(none) for k in SHAPES)))


def _outside(text: Column, spans: Column) -> Column:
    """The text with every span a space."""

    def step(acc, x):
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.array(gap)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text))))), " ")


def _entities(text: Column, spans: Column) -> Column:
    """array<string> of the distinct entities of the spans: whole values and what recurs of them."""

    def forms(x):
        value = F.lower(F.substring(text, x["s"] + 1, x["e"] - x["s"]))
        number = _digits(value)
        domain, holder = F.regexp_extract(value, "@(.*)$", 1), F.regexp_replace(F.regexp_extract(value, "^([^@]*)@", 1), "[^a-z]", "")
        of = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
        email = F.array(of("email", value), of("domain", domain), F.when(F.length(holder) > 1, of("holder", holder)))
        ip = F.array(of("ip", value), of("network", F.regexp_extract(value, r"^(.*)\.", 1)))
        card = F.array(of("card", number), of("issuer", F.substring(number, 1, 6)))
        phone = F.array(of("phone", number), of("prefix", F.substring(number, 1, 6)))
        return F.when(x["k"] == 0, email).when(x["k"] == 1, ip).when(x["k"] == 2, card).otherwise(phone)

    return F.array_compact(F.array_distinct(F.flatten(F.transform(spans, forms))))


def _terms(text: Column) -> Column:
    """array<string> of the distinct words of a text, lower-case, numbers left out."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), lambda t: ~t.rlike("^[0-9]+$"))


def _named(rows: DataFrame) -> DataFrame:
    """(pi_id, pi_hash, family, entities, terms) of the rows(pi_id, pi_hash, pi_text, pi_base) with base spans.

    family is the least hash of two neighbouring words, which copies and most near copies of a text share.
    """
    one = rows.where(F.size("pi_base") > 0).withColumn("outside", _outside(F.col("pi_text"), F.col("pi_base")))
    words = F.regexp_extract_all(F.lower("outside"), F.lit(WORD), F.lit(0))
    one = one.withColumn("words", words)
    pairs = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1)))
    return one.select("pi_id", "pi_hash", F.coalesce(F.array_min(pairs), F.lit(0)).alias("family"), _entities(F.col("pi_text"), F.col("pi_base")).alias("entities"), _terms(F.col("outside")).alias("terms"))


def disclosure(named: DataFrame, counts: DataFrame, n: int, vocabulary: int, alpha: float = ALPHA) -> DataFrame:
    """(entity, term, strength) of every pair that the corpus shows beyond chance.

    named(family, entities, terms), counts(term, nt), n documents. Entities and pairs in one family only are no evidence,
    whatever the corpus, and go before anything is paired.
    """
    held = named.select("family", "terms", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity", "family").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("ne"), F.count("*").alias("fe")).where("fe > 1").select("entity", "ne")
    entities = saved(entities, "entities")
    held = held.join(sized_broadcast(entities, entities.count(), BROADCAST_ROWS), "entity")
    pairs = held.select("entity", "ne", "family", F.explode("terms").alias("term")).groupBy("entity", "ne", "term", "family").agg(F.count("*").alias("n"))
    pairs = saved(pairs.groupBy("entity", "ne", "term").agg(F.sum("n").alias("nte"), F.count("*").alias("k")).where("k > 1"), "pairs")
    rows = pairs.join(counts, "term")
    share, whole = F.col("nte") / F.col("nt"), F.col("ne") / F.lit(float(n))
    independent = F.col("k") / share  # texts with the term, copies taken together as often as those with the entity are
    ln = lambda x: F.when(x > 0, F.log(x)).otherwise(F.lit(0.0))
    ratio = F.col("k") * F.log(share / whole) + (independent - F.col("k")) * (ln(F.lit(1.0) - share) - ln(F.lit(1.0) - whole))
    shown = (share > whole) & (ratio >= math.log(max(vocabulary, 1) / alpha))
    return rows.where(shown).select("entity", "term", (F.log(share / whole) / -F.log(whole)).alias("strength"))


def found(docs: DataFrame, alpha: float = ALPHA, generalise: float = GENERALISE) -> DataFrame:
    """docs with pi_text, pi_base (shapes), pi_spans (all spans) and pi_terms (term to strength of what is added)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("pi_text", text).withColumn("pi_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("pi_hash", F.xxhash64("pi_text")).withColumn("pi_base", base_spans(F.col("pi_text")))
    named = saved(_named(rows.select("pi_id", "pi_hash", "pi_text", "pi_base")), "named")
    counts = saved(rows.select(F.explode(_terms(F.col("pi_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("nt")), "counts")
    strong = saved(disclosure(named, counts, rows.count(), counts.count(), alpha).where(F.col("strength") >= generalise), "disclosing")
    each = named.select("pi_id", "pi_hash", "terms", F.explode("entities").alias("entity"))
    of = strong.select("entity").distinct()
    each = each.join(sized_broadcast(of, of.count(), BROADCAST_ROWS), "entity", "left_semi").select("pi_id", "pi_hash", "entity", F.explode("terms").alias("term"))
    held = each.join(sized_broadcast(strong, strong.count(), BROADCAST_ROWS), ["entity", "term"]).groupBy("pi_id", "pi_hash", "term").agg(F.max("strength").alias("strength"))
    held = saved(held, "held")
    terms = held.groupBy("pi_id", "pi_hash").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "strength")))).alias("pi_terms"))
    out = rows.join(sized_broadcast(terms, held.count(), BROADCAST_ROWS), ["pi_id", "pi_hash"], "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.map_keys("pi_terms"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    added = F.filter(_spans(F.col("pi_text"), pattern, "term"), lambda t: ~F.exists("pi_base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    return out.withColumn("pi_spans", F.when(F.col("pi_terms").isNull(), F.col("pi_base")).otherwise(F.array_sort(F.concat("pi_base", added))))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def sanitised(docs: DataFrame, alpha: float = ALPHA, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with identifiers replaced by their kind's label, disclosing terms generalised to [detail] or removed.

    Overlapping spans are replaced together, under the label of the first. A null text stays null, an empty one empty;
    null doc_ids and repeated rows are treated like others; an empty table gives an empty one. n_chars, where
    docs has it as a number, is that of the new text.
    """
    rows = found(docs, alpha, generalise)
    text, label = F.col("pi_text"), F.array(*(F.lit(LABELS[k]) for k in KINDS[:4]))

    def step(acc, x):
        word = F.lower(F.substring(text, x["s"] + 1, x["e"] - x["s"]))
        mark = F.when(x["k"] < 4, F.element_at(label, F.least(x["k"], F.lit(3)) + 1)).when(F.element_at("pi_terms", word) >= remove, F.lit("")).otherwise(F.lit("[detail]"))
        out = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), mark)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    new = F.aggregate("pi_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    rows = rows.withColumn("text", F.when(F.col("text").isNull() | (F.size("pi_spans") == 0), F.col("text")).otherwise(new))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("pi_spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_pii_sanitisation(spark, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts by shape, a digest of those spans, and all spans with the added terms."""
    rows = found(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pi_base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS[:4]), F.sha2(listed(F.col("pi_base")), 256).alias("base_sha256"), listed(F.col("pi_spans")).alias("spans"))
