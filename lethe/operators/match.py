"""Finding, merging and masking the occurrences of terms.

A document's terms are one array joined to its text units by doc_id, or one list for all units, which then travels with
the function. A unit is searched for all its terms at once in Arrow batches, long lists by an automaton: nothing is multiplied
out, nothing is shuffled but the join on doc_id, and the time grows with the text and not with the number of terms. There is no limit to
a document's terms: a refusal must know all of them. The search of one string is also what Word files are searched with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .search import Searcher, islands, searcher, spliced

TERM = "array<struct<ord:int,text:string,label:string>>"
SPANS = "array<struct<s:int,e:int,label:string>>"
FOUND = "struct<hits:array<struct<s:int,neg:int,ord:int,e:int,label:string>>,spans:array<struct<s:int,e:int,label:string>>>"
MASKED = "struct<text:string,removed:int>"
LEFT = "array<struct<text:string,label:string,reason:string>>"


def _found(text: str, terms: Searcher) -> tuple[list, list]:
    hits = terms.occurrences(text)
    return hits, islands(hits)


def _lists(rows: list[list[tuple]], kind: pa.ListType) -> pa.ListArray:
    """Lists of structs from lists of tuples, made column by column."""
    fields, flat = list(kind.value_type), [x for row in rows for x in row]
    columns = zip(*flat) if flat else [()] * len(fields)
    ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields))


def _made(rows: list, kind: str) -> pa.Array:
    """The results of a batch as Arrow."""
    if kind != FOUND:
        return pa.array(rows, _TYPES[kind])
    hits, spans = _TYPES[FOUND]
    return pa.StructArray.from_arrays([_lists([r[0] for r in rows], hits.type), _lists([r[1] for r in rows], spans.type)], fields=[hits, spans])


def _masked(text: str, terms: Searcher) -> dict:
    spans = islands(terms.occurrences(text))
    return {"text": spliced(text, spans), "removed": len(spans)}


def _left(text: str, terms: Searcher) -> list[dict]:
    """The terms that occur, each tested alone, and whether a label of the list holds them itself."""
    still = {h[2] for h in terms.occurrences(text)}
    if not still:
        return []
    own = terms.within_labels()
    return [{"text": term, "label": label, "reason": "label_collision" if order in own else "present"} for order, term, label in terms.terms if order in still]


def _search(work, kind: str, text: Column, terms: Column | list[tuple[int, str, str]]) -> Column:
    """work(text, terms) of each row; a null text is an empty one. terms is a column of TERM or one list for all rows."""
    if isinstance(terms, list):

        def same(texts: pa.Array) -> pa.Array:
            ready = searcher(tuple(terms))
            return _made([work(t or "", ready) for t in texts.to_pylist()], kind)

        return F.arrow_udf(same, kind)(text)

    def own(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out, last, ready = [], None, None
        for t, given in zip(texts.to_pylist(), lists, strict=True):
            if last is None or not given.equals(last):
                last, ready = given, searcher(tuple((x["ord"], x["text"], x["label"]) for x in given.as_py() or []))
            out.append(work(t or "", ready))
        return _made(out, kind)

    return F.arrow_udf(own, kind)(text, terms)


_SPAN = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("label", pa.string())]))
_TYPES = {
    FOUND: pa.struct([("hits", pa.list_(pa.struct([("s", pa.int32()), ("neg", pa.int32()), ("ord", pa.int32()), ("e", pa.int32()), ("label", pa.string())]))), ("spans", _SPAN)]),
    MASKED: pa.struct([("text", pa.string()), ("removed", pa.int32())]),
    LEFT: pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("reason", pa.string())])),
}


def term_lists(terms: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys..., terms TERM) of terms(keys..., ord, text, label): all non-blank ones of each key by ord, of equal texts and labels the first."""
    bare = terms.withColumn("text", trimmed("text")).where("text is not null and text <> ''")
    once = bare.groupBy(*keys, "text", "label").agg(F.min(F.col("ord").cast("int")).alias("ord"))
    return once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "text", "label"))).alias("terms"))


def without(text: Column, terms: Column) -> Column:
    """MASKED of a text by a column of terms (TERM)."""
    return _search(_masked, MASKED, text, terms)


def masked(text: Column, spans: Column) -> Column:
    """The text with every one of its sorted SPANS replaced by its label."""
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.get(spans, i - 1)["e"], F.lit(0)))
    pieces = F.transform(spans, lambda x, i: F.concat(F.substr(text, before(i) + 1, x["s"] - before(i)), x["label"]))
    end = F.coalesce(F.try_element_at(spans, F.lit(-1))["e"], F.lit(0))
    return F.concat(F.array_join(pieces, ""), F.substr(text, end + 1, F.greatest(F.length(text) - end, F.lit(0))))


def _listed(units: DataFrame, lists: DataFrame, how: str) -> tuple[DataFrame, Column | list[tuple[int, str, str]]]:
    """units with what is searched for: the column of the join on doc_id, or the one list for all, which has no doc_id."""
    if "doc_id" in lists.columns:
        return units.join(lists, "doc_id", how), F.col("terms")
    rows = lists.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("lists without doc_id must be one list")
    return units, [(t["ord"], t["text"], t["label"]) for t in (rows[0]["terms"] if rows else [])]


def matched(units: DataFrame, lists: DataFrame, how: str = "inner") -> DataFrame:
    """units with hits (s, neg, ord, e, label) and SPANS; lists is keyed by doc_id, or has one row for all units without a key."""
    rows, terms = _listed(units, lists, how)
    rows = rows.withColumn("found_", _search(_found, FOUND, F.col("text"), terms))
    return rows.withColumns({"hits": F.col("found_.hits"), "spans": F.col("found_.spans")}).drop("found_", "terms")


def redacted(units: DataFrame, lists: DataFrame, how: str = "left") -> DataFrame:
    """units with their text masked and ``removed``, the number of spans."""
    rows, terms = _listed(units, lists, how)
    rows = rows.withColumn("masked_", _search(_masked, MASKED, F.col("text"), terms))
    return rows.withColumns({"text": F.col("masked_.text"), "removed": F.col("masked_.removed")}).drop("masked_", "terms")


def leftovers(units: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc_id, text, label, reason) of terms that still occur in some unit, each tested alone.

    The reason is label_collision where a label of the list holds the term.
    """
    rows, terms = _listed(units, lists, "inner")
    return rows.select("doc_id", F.explode(_search(_left, LEFT, F.col("text"), terms)).alias("x")).select("doc_id", "x.*").distinct()
