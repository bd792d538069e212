"""Lists that come from outside: approved terms and detectors' candidates, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import REDACTED, TYPES
from ..functions.limits import Limits
from ..functions.text import is_label, is_searchable, is_recent_date, trimmed


def _string(field: str) -> Column:
    """A field of the variant v that is a JSON string; null if it is anything else."""
    part = F.try_variant_get("v", f"$.{field}", "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get("v", f"$.{field}", "string"))


def approved_terms(lists: DataFrame, raw: str = "terms_json") -> DataFrame:
    """(doc_id, ord, text, label) of lists(doc_id, raw): the first max_terms items, then those valid, then the first of equals.

    A text is valid if it is not blank and has at most max_term characters; an invalid label becomes REDACTED. What is not
    a JSON list gives no rows.
    """
    limits = Limits.of(lists.sparkSession)
    items = F.from_json(raw, "array<string>")
    rows = lists.select("doc_id", F.posexplode(F.slice(items, 1, limits.max_terms)).alias("ord", "item"))
    rows = rows.select("doc_id", "ord", F.try_parse_json("item").alias("v"))
    rows = rows.select("doc_id", "ord", trimmed(_string("text")).alias("text"), _string("label").alias("label"))
    rows = rows.where((F.length("text") > 0) & (F.length("text") <= limits.max_term))
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("ord"))
    return rows.withColumn("n", first).where("n = 1").select("doc_id", "ord", "text", F.when(is_label(F.col("label")), F.col("label")).otherwise(REDACTED).alias("label"))


def entity_candidates(answers: DataFrame, raw: str = "entities_json") -> DataFrame:
    """(doc_id, ord, type, text, refers_to) of a detector's answers(doc_id, raw).

    Blank texts go, an unknown type is OTHER, and a blank refers_to is the text itself.
    """
    found = F.from_json(raw, "struct<entities:array<struct<text:string,type:string,refers_to:string>>>")
    rows = answers.select("doc_id", F.posexplode(found["entities"]).alias("ord", "x"))
    text, refers = trimmed(F.col("x.text")), trimmed(F.col("x.refers_to"))
    kind = F.when(F.col("x.type").isin(*TYPES), F.col("x.type")).otherwise("OTHER")
    return rows.select("doc_id", "ord", kind.alias("type"), text.alias("text"), F.when(F.length(refers) > 0, refers).otherwise(text).alias("refers_to")).where(F.length("text") > 0)


def worth_looking_for(kind: Column, text: Column, as_of_year: int) -> Column:
    """The test of detectors' candidates (not of pattern hits)."""
    return is_searchable(text) & ~((kind == "DATE_OF_BIRTH") & is_recent_date(text, as_of_year))


def selected_terms(findings: DataFrame, ticked: DataFrame, manual: DataFrame) -> DataFrame:
    """(doc_id, ord, text, label): texts of the findings whose label is ticked, then the manual terms.

    findings(doc_id, label, texts), ticked(doc_id, label), manual(doc_id, ord, text) of 2 to max_term characters.
    """
    own = findings.join(ticked, ["doc_id", "label"], "left_semi").select("doc_id", "label", F.posexplode("texts").alias("i", "text"))
    own = own.select("doc_id", F.lit(0).alias("later"), "label", "i", "text")
    added = manual.withColumn("text", trimmed(F.col("text"))).where(F.length("text").between(2, Limits.of(findings.sparkSession).max_term))
    added = added.join(own, ["doc_id", "text"], "left_anti").select("doc_id", F.lit(1).alias("later"), F.lit(REDACTED).alias("label"), F.col("ord").cast("int").alias("i"), "text")
    place = Window.partitionBy("doc_id").orderBy("later", "label", "i", "text")
    return own.unionByName(added).select("doc_id", (F.row_number().over(place) - 1).alias("ord"), "text", "label")
