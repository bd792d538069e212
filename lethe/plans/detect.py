"""From text units to findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import pattern_hits
from ..operators.chunk import chunks
from ..operators.findings import findings, verified
from ..operators.grouping import grouped, with_name_parts
from ..operators.match import matched, redacted, term_lists
from ..operators.terms import worth_looking_for
from ..sources.shared import staged


def candidates(*sources: DataFrame) -> DataFrame:
    """(doc_id, ord, type, text, refers_to): the sources one after the other, numbered through within a document."""
    all_rows = None
    for i, s in enumerate(sources):
        rows = s.select("doc_id", F.lit(i).alias("src"), F.col("ord").alias("o"), "type", "text", "refers_to")
        all_rows = rows if all_rows is None else all_rows.unionByName(rows)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("src", "o"))
    return all_rows.select("doc_id", number.alias("ord"), "type", "text", "refers_to")


def pattern_candidates(units: DataFrame) -> DataFrame:
    """Pattern hits in the order of units."""
    rows = pattern_hits(units)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_id", "ord"))
    return rows.select("doc_id", order.alias("ord"), "type", "text", F.col("text").alias("refers_to"))


def group_terms(groups: DataFrame) -> DataFrame:
    """(doc_id, ord, text, label): the texts of the groups as terms."""
    rows = groups.select("doc_id", "group_ord", "label", F.posexplode("texts").alias("i", "text"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("group_ord", "i")).alias("ord"), "text", "label")


def detect(units: DataFrame, detector: Callable[[DataFrame], DataFrame] | None = None, recall: bool = True, as_of_year: int = 2026) -> DataFrame:
    """(doc_id, label, type, texts, count, pages): who and what is named in units(doc_id, unit_id, page, text), and where.

    detector maps chunks(doc_id, chunk_id, text) to (doc_id, ord, type, text, refers_to); with ``recall`` it reads the chunks
    a second time with all that was found masked. Its candidates are kept only where the text has them. Every stage is written
    to the shared folder, so patterns are searched once and the detector sees each chunk once a pass.
    """
    patterns = staged(pattern_candidates(units), "patterns")
    if detector is None:
        groups = grouped(patterns)
    else:

        def asked(parts: DataFrame, name: str) -> DataFrame:
            found = detector(parts).select("doc_id", "ord", "type", "text", "refers_to")
            rows = staged(found.where(worth_looking_for(F.col("type"), F.col("text"), as_of_year)), f"{name}-candidates")
            return staged(verified(rows, units), name)

        parts = staged(chunks(units), "chunks")
        model = asked(parts, "model")
        groups = grouped(candidates(model, patterns))
        if recall:
            groups = staged(groups, "first-groups")
            hidden = redacted(parts, term_lists(group_terms(groups))).select("doc_id", "chunk_id", "text")
            groups = grouped(candidates(model, patterns, asked(staged(hidden, "hidden"), "recall")))
    groups = staged(with_name_parts(staged(groups, "groups"), units), "named-groups")
    return findings(groups, matched(units, term_lists(group_terms(groups))))
