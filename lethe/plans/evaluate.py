"""The whole evaluation of redacted documents against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import evaluate as score


def evaluate(truth: DataFrame, keep: DataFrame, outputs: DataFrame, least: float = 0.98, only: list | DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables leaks, lost, by_type, gate and keep_rate of truth and keep strings in outputs; ``only`` limits doc_id to a list or a table of them."""
    if isinstance(only, DataFrame):
        truth, keep, outputs = (t.join(only.select("doc_id"), "doc_id", "left_semi") for t in (truth, keep, outputs))
    elif only is not None:
        truth, keep, outputs = (t.where(t.doc_id.isin(only)) for t in (truth, keep, outputs))
    leaks, lost = score.leaks(truth, outputs), score.lost(keep, outputs)
    return {"leaks": leaks, "lost": lost, "by_type": score.by_type(leaks), "gate": score.gate(leaks, least), "keep_rate": score.keep_rate(keep, lost)}
