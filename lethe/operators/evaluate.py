"""Scoring redacted output against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import GENERIC
from ..functions.text import digits, folded
from .match import matched, term_lists

GATED = ("PERSON", "ADDRESS", "ID")


def leak_terms(text: Column) -> Column:
    """array<string> of what must not occur: the whole of a string with six digits or no telling word, else its telling words."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~F.lower(w).isin(GENERIC))
    telling = F.when(F.size(words) > 1, F.filter(words, lambda w: F.length(w) >= 3)).otherwise(words)
    whole = (F.length(digits(text)) >= 6) | (F.size(telling) == 0)
    return F.when(whole, F.array(text)).otherwise(telling)


def leaks(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """(doc_id, ord, type, text, leaked) of truth(doc_id, ord, type, text) in outputs(doc_id, unit_id, text)."""
    parts = truth.select("doc_id", F.col("ord").alias("t"), F.explode(leak_terms(F.col("text"))).alias("text"))
    asked = parts.select("doc_id", F.lit(0).alias("ord"), "text", F.col("text").alias("label"))
    seen = matched(outputs, term_lists(asked)).select("doc_id", F.explode("hits").alias("h")).select("doc_id", F.col("h.label").alias("text")).distinct()
    leaked = parts.join(seen, ["doc_id", "text"], "left_semi").select("doc_id", F.col("t").alias("ord"), F.lit(True).alias("leaked")).distinct()
    return truth.join(leaked, ["doc_id", "ord"], "left").withColumn("leaked", F.coalesce("leaked", F.lit(False))).select("doc_id", "ord", "type", "text", "leaked")


def lost(keep: DataFrame, outputs: DataFrame) -> DataFrame:
    """The keep(doc_id, ord, text) strings that are in none of their document's outputs, compared folded."""
    both = keep.join(outputs.select("doc_id", folded(F.col("text")).alias("o")), "doc_id")
    kept = both.where(F.contains("o", folded(F.col("text")))).select("doc_id", "ord").distinct()
    return keep.join(kept, ["doc_id", "ord"], "left_anti")


def by_type(scored: DataFrame) -> DataFrame:
    """(type, total, leaked, removed_share) of each type and, as ALL, of everything."""
    rows = scored.rollup("type").agg(F.count("*").alias("total"), F.sum(F.col("leaked").cast("long")).alias("leaked"))
    share = F.round(F.lit(1.0) - F.try_divide(F.col("leaked"), F.col("total")), 4)
    return rows.select(F.coalesce("type", F.lit("ALL")).alias("type"), "total", F.coalesce("leaked", F.lit(0)).alias("leaked"), share.alias("removed_share"))


def gate(scored: DataFrame, least: float = 0.98) -> DataFrame:
    """(total, leaked, removed_share, passed) over the gated types; without any of them it passes."""
    own = scored.where(F.col("type").isin(*GATED)).agg(F.count("*").alias("total"), F.coalesce(F.sum(F.col("leaked").cast("long")), F.lit(0)).alias("leaked"))
    share = F.coalesce(F.lit(1.0) - F.try_divide(F.col("leaked"), F.col("total")), F.lit(1.0))
    return own.withColumn("removed_share", share).withColumn("passed", share >= least)


def keep_rate(keep: DataFrame, gone: DataFrame) -> DataFrame:
    """(kept_share, lost) of the strings to keep; the share is null without any."""
    n = keep.agg(F.count("*").alias("n")).crossJoin(F.broadcast(gone.agg(F.count("*").alias("lost"))))
    return n.select((F.lit(1.0) - F.try_divide("lost", "n")).alias("kept_share"), "lost")


def cost(calls: DataFrame, prompt_price: float, completion_price: float) -> DataFrame:
    """(calls, prompt, completion, cost) of calls(prompt, completion) tokens, prices a million."""
    sums = calls.agg(F.count("*").alias("calls"), F.coalesce(F.sum("prompt"), F.lit(0)).alias("prompt"), F.coalesce(F.sum("completion"), F.lit(0)).alias("completion"))
    return sums.withColumn("cost", (F.col("prompt") * prompt_price + F.col("completion") * completion_price) / 1_000_000)


def percent(share: Column) -> Column:
    """A share as it is shown: a percentage of one decimal, n/a without one."""
    return F.coalesce(F.format_string("%.1f%%", share * 100), F.lit("n/a"))
