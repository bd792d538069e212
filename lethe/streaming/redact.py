"""Detection and masking of a stream of text units; every step is row by row, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from ..functions.patterns import pattern_hits
from ..operators.match import redacted


def hits_stream(units: DataFrame) -> DataFrame:
    """Pattern hits of a stream of units(doc_id, unit_id, text)."""
    return pattern_hits(units)


def masked_stream(units: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc_id, unit_id, text, removed) of a stream of units, by static term lists."""
    return redacted(units, lists).select("doc_id", "unit_id", "text", "removed")
