"""From occurrences to findings: verification, labels, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_name
from .match import matched, term_lists


def occurring(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, text) of the candidates(doc_id, ord, text) that occur in some unit of their document."""
    rows = candidates.select("doc_id", F.lit(0).alias("ord"), "text", F.col("text").alias("label"))
    found = matched(units, term_lists(rows)).select("doc_id", F.explode("hits").alias("h"))
    return found.select("doc_id", F.col("h.label").alias("text")).distinct()


def verified(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates that truly occur."""
    return candidates.join(occurring(candidates, units), ["doc_id", "text"], "left_semi")


def unverified(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates that do not."""
    return candidates.join(occurring(candidates, units), ["doc_id", "text"], "left_anti")


def labels(kind: Column, number: Column) -> Column:
    """[Name n]; the first date of birth has no number."""
    plain = (kind == "DATE_OF_BIRTH") & (number == 1)
    return F.when(plain, F.concat(F.lit("["), label_name(kind), F.lit("]"))).otherwise(F.concat(F.lit("["), label_name(kind), F.lit(" "), number.cast("string"), F.lit("]")))


def numbered(groups: DataFrame) -> DataFrame:
    """groups(doc_id, group_ord, type, ...) with its label: a running number per document and type."""
    number = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("group_ord"))
    return groups.withColumn("label", labels(F.col("type"), number))


def summarised(spans: DataFrame) -> DataFrame:
    """(doc_id, label, count, pages) of spans(doc_id, page, spans): occurrences and the distinct pages, ascending."""
    rows = spans.select("doc_id", "page", F.explode("spans").alias("x"))
    return rows.groupBy("doc_id", F.col("x.label").alias("label")).agg(F.count("*").alias("count"), F.array_sort(F.collect_set("page")).alias("pages"))


def findings(groups: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, label, type, texts, count, pages) of the labelled groups that occur."""
    return summarised(spans).join(groups.select("doc_id", "label", "type", "texts"), ["doc_id", "label"])


def by_type(found: DataFrame) -> DataFrame:
    """(doc_id, type, type_name, labels): the findings of a document under their types' list names."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("count", "label"))), lambda x: x["label"])
    return found.groupBy("doc_id", "type").agg(listed.alias("labels")).withColumn("type_name", label_name(F.col("type"), 1))
