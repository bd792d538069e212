"""From approved terms to masked units, or a refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..operators.match import leftovers, redacted, term_lists, without
from ..sources.shared import staged


def masked_units(units: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc_id, unit_id, text, removed) of units(doc_id, unit_id, text)."""
    return redacted(units, lists).select("doc_id", "unit_id", "text", "removed")


def redact(units: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(result, refused) by terms(doc_id, ord, text, label).

    The masked text is searched again for every term; a document in which one is found is in ``refused``
    (doc_id, text, label, reason) and none of its units in ``result``. Lists, masked units and refusals are written once.
    """
    lists = staged(term_lists(terms), "lists")
    out = staged(masked_units(units, lists), "masked")
    refused = staged(leftovers(out, lists), "refused")
    return out.join(refused.select("doc_id").distinct(), "doc_id", "left_anti"), refused


def output_name(file_name: Column, terms: Column, ext: Column) -> Column:
    """The name without what the terms name: labels without brackets, other signs spaces, and a suffix."""
    bare = F.transform(terms, lambda t: F.struct(t["ord"].alias("ord"), t["text"].alias("text"), F.regexp_replace(t["label"], r"[\[\]]", "").alias("label")))
    name = without(base_name(file_name), bare)["text"]
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N} ._()-]+", " "), r"\s+", " "))
    return F.concat(F.when(name == "", "document").otherwise(name), F.lit(" - anonymised."), ext)
