"""Text that is stored in segments: where spans of the whole run fall, and replacing them in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .match import SPANS, masked


def placed(segments: DataFrame) -> DataFrame:
    """segments(doc_id, run_id, seg_ord, text) with s and e, their half-open place in the run."""
    upto = F.sum(F.length("text")).over(Window.partitionBy("doc_id", "run_id").orderBy("seg_ord").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return segments.withColumn("e", upto).withColumn("s", F.col("e") - F.length("text"))


#: Characters of a run that are joined at a time.
STRETCH = 4_096


def _stretches(rows: DataFrame, s: str, e: str, name: str) -> DataFrame:
    """rows once for every stretch of their run that [s, e) reaches into, as ``name``; an empty one lies where it stands."""
    last = F.greatest(F.col(e) - 1, F.col(s))
    of = lambda at: F.floor(at / STRETCH).cast("int")
    return rows.withColumn(name, F.explode(F.sequence(of(F.col(s)), of(last))))


def overlaps(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, run_id, seg_ord, text, a, z, label, first): spans(doc_id, run_id, s, e, label) met with placed segments.

    a and z are the span's part within the segment; first marks the earliest segment that a span touches. An interval join by
    stretches: a run of any length is many keys, and a pair is kept in the stretch in which the later of the two begins.
    """
    own = spans.select("doc_id", "run_id", F.col("s").alias("ps"), F.col("e").alias("pe"), "label").where("pe > ps")
    both = _stretches(segments, "s", "e", "stretch").join(_stretches(own, "ps", "pe", "stretch"), ["doc_id", "run_id", "stretch"])
    both = both.where((F.col("e") > F.col("ps")) & (F.col("s") < F.col("pe")) & (F.col("stretch") == F.floor(F.greatest("s", "ps") / STRETCH)))
    nth = F.row_number().over(Window.partitionBy("doc_id", "run_id", "ps", "pe", "label").orderBy("seg_ord"))
    low, high = F.greatest(F.col("ps") - F.col("s"), F.lit(0)), F.least(F.col("pe"), F.col("e")) - F.col("s")
    return both.select("doc_id", "run_id", "seg_ord", "text", low.alias("a"), high.alias("z"), "label", (nth == 1).alias("first"))


def replaced(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, run_id, seg_ord, text): a span's label goes into the first segment it touches, the span is cut from the others."""
    at = placed(segments)
    met = overlaps(at, spans)
    cut = F.struct(F.col("a").alias("s"), F.col("z").alias("e"), F.when(F.col("first"), F.col("label")).otherwise("").alias("label"))
    cuts = met.groupBy("doc_id", "run_id", "seg_ord").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    out = at.join(cuts, ["doc_id", "run_id", "seg_ord"], "left")
    return out.select("doc_id", "run_id", "seg_ord", masked(F.col("text"), F.coalesce("cuts", F.array().cast(SPANS))).alias("text"))
