"""Grouping the written forms of one entity.

The exact rules depend on the order of a document's candidates and on groups changing while they are compared, so the
candidates are sorted by document and order and read in one pass, which carries the groups of one document as its state and never
a list of its candidates. Whether a name lies within another is asked of an index of words. ``merge_fits`` is the order-free half of it as a join.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import FAMILY_WORDS, NOT_NAMES, PARTICLES, TITLES
from .findings import labels, occurring
from .match import redacted, term_lists


def _norm(s: str) -> str:
    return re.sub(r"(?:[^\w]|_)+", " ", unicodedata.normalize("NFKC", s).lower()).strip()


def _key(kind: str, s: str) -> str:
    n = _norm(s)
    return f"{kind}:" + (" ".join(w for w in n.split(" ") if w not in TITLES) if kind == "PERSON" else n)


def _shaped(s: str) -> bool:
    parts = s.split()
    return not re.search(r"[,;:()]", s) and 1 <= len(parts) <= 5 and all(p[0].isupper() or p.lower() in PARTICLES for p in parts)


def _words(texts: list[str]) -> tuple[set[str], set[str]]:
    """Full words and one-letter initials of the texts that look like names."""
    all_words = {w for t in texts if _shaped(t) for w in _norm(t).split(" ") if w and w not in TITLES}
    return {w for w in all_words if len(w) > 1}, {w for w in all_words if len(w) == 1}


class Groups:
    """The groups of one document, made of its candidates in order."""

    def __init__(self) -> None:
        self._groups: list[tuple[str, dict[str, None]]] = []
        self._known: dict[str, int] = {}

    def add(self, kind: str, text: str, refers: str) -> None:
        """A candidate joins the group of its text or else of the key of what it refers to, or begins one."""
        norm = _norm(text)
        if kind == "PERSON" and norm in FAMILY_WORDS:
            return
        key = _key(kind, refers)
        at = self._known.get(norm, self._known.get(key))
        if at is None:
            at = len(self._groups)
            self._groups.append((kind, {}))
        self._groups[at][1].setdefault(text)
        self._known.setdefault(norm, at)
        self._known.setdefault(key, at)

    def _merge(self) -> None:
        """In order, each person whose words lie within those of exactly one other joins them.

        Candidates are who holds the rarest of the words; two that fit are enough to know. A group that is joined gains no full
        words, so the index changes only where one is merged away.
        """
        people = [i for i, (kind, _) in enumerate(self._groups) if kind == "PERSON"]
        full, initials, first, holders = {}, {}, {}, {}
        for i in people:
            full[i], initials[i] = _words(list(self._groups[i][1]))
            first[i] = {w[0] for w in full[i]}
            for w in full[i]:
                holders.setdefault(w, {})[i] = None
        for i in people:
            if not full[i]:
                continue
            fits = []
            for j in min((holders[w] for w in sorted(full[i])), key=len):
                if j != i and len(full[j]) > len(full[i]) and full[i] <= full[j] and initials[i] <= first[j]:
                    fits.append(j)
                    if len(fits) > 1:
                        break
            if len(fits) == 1:
                into = fits[0]
                self._groups[into][1].update(self._groups[i][1])
                self._groups[i][1].clear()
                initials[into] = initials[into] | initials[i]
                for w in full[i]:
                    del holders[w][i]

    def result(self) -> list[tuple[str, list[str]]]:
        """(type, texts) in order; a merged-away group keeps its place with no texts."""
        self._merge()
        return [(kind, list(texts)) for kind, texts in self._groups]


def group_document(rows: list[tuple[str, str, str]]) -> list[tuple[str, list[str]]]:
    """(type, texts) groups of (type, text, refers_to) in order; a merged-away group keeps its place with no texts."""
    groups = Groups()
    for row in rows:
        groups.add(*row)
    return groups.result()


#: Groups that are passed on at a time.
_OUT = 4_096


def grouped(candidates: DataFrame) -> DataFrame:
    """(doc_id, group_ord, type, texts, label) of candidates(doc_id, ord, type, text, refers_to).

    Empty groups go and leave their order number. Rows without text are no candidates; a null type or refers_to is OTHER or the text.
    """
    rows = candidates.where("text is not null").select("doc_id", "ord", F.coalesce("type", F.lit("OTHER")).alias("type"), "text", F.coalesce("refers_to", "text").alias("refers_to"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        def out(doc, groups, ids):
            numbers: dict[str, int] = {}
            found = []
            for i, (type_, texts) in enumerate(groups.result()):
                if texts:
                    numbers[type_] = numbers.get(type_, 0) + 1
                    found.append((doc, i, type_, texts, numbers[type_]))
            for lo in range(0, len(found), _OUT):
                part = found[lo : lo + _OUT]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in part], t) for j, t in enumerate((ids, pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32()))], ["doc_id", "group_ord", "type", "texts", "number"])

        doc, groups, ids = None, None, None
        for batch in batches:
            ids = batch.schema.field(0).type
            for own, type_, text, refers in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "type", "text", "refers_to")), strict=True):
                if groups is None or own != doc:
                    if groups is not None:
                        yield from out(doc, groups, ids)
                    doc, groups = own, Groups()
                groups.add(type_, text, refers)
        if groups is not None:
            yield from out(doc, groups, ids)

    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "ord", "type", "text", "refers_to")
    found = ordered.mapInArrow(run, f"doc_id {kind}, group_ord int, type string, texts array<string>, number int")
    return found.select("doc_id", "group_ord", "type", "texts", labels(F.col("type"), F.col("number")).alias("label"))


def canonical_groups(candidates: DataFrame, key) -> DataFrame:
    """(doc_id, key, type, texts): groups by one key alone, texts in order of first appearance; joins and counts only."""
    rows = candidates.withColumn("key", key)
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]))
    return rows.groupBy("doc_id", "key").agg(F.min_by("type", "ord").alias("type"), listed.alias("texts"))


def merge_fits(names: DataFrame) -> DataFrame:
    """(doc_id, a, b): name a whose words are strictly within those of exactly one other name b of names(doc_id, name, words).

    Each name looks only among the holders of the word of its own that the fewest names of the document hold: an
    equi-join with inverted lists, in which sizes decide before the words are compared.
    """
    sets = names.select("doc_id", "name", F.array_distinct("words").alias("words")).where(F.size("words") > 0)
    held = sets.select("doc_id", F.explode("words").alias("word"), "name", "words")
    rare = held.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    ranked = held.join(rare, ["doc_id", "word"]).groupBy("doc_id", "name", "words").agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.count("*").alias("n"))
    # a row of names that is there several times counts as often
    asks = ranked.select("doc_id", "word", F.col("name").alias("a"), F.col("words").alias("aw"), F.expr("cast(n / size(words) as int)").alias("times"))
    lists = held.select("doc_id", "word", F.col("name").alias("b"), F.col("words").alias("bw"))
    pairs = asks.join(lists, ["doc_id", "word"]).where((F.size("aw") < F.size("bw")) & (F.size(F.array_except("aw", "bw")) == 0))
    single = pairs.groupBy("doc_id", "a").agg(F.sum("times").alias("n"), F.min("b").alias("b")).where("n = 1")
    return single.select("doc_id", "a", "b")


def with_name_parts(groups: DataFrame, units: DataFrame) -> DataFrame:
    """groups whose people also own the single words of their names that are still readable once all texts are masked."""
    terms = groups.select("doc_id", "group_ord", "label", F.posexplode("texts").alias("i", "text"))
    terms = terms.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("group_ord", "i")))
    hidden = redacted(units, term_lists(terms)).select("doc_id", "unit_id", "text")
    part = F.explode(F.flatten(F.transform("texts", lambda t: F.split(t, r"[\s,]+"))))
    parts = groups.where("type = 'PERSON'").select("doc_id", "group_ord", part.alias("part")).withColumn("part", F.regexp_replace("part", r"^[^\p{L}]+|[^\p{L}]+$", ""))
    parts = parts.where((F.length("part") >= 3) & F.col("part").rlike(r"^\p{Lu}") & ~F.lower("part").isin(*TITLES, *NOT_NAMES)).distinct()
    asked = parts.select("doc_id", F.col("part").alias("text")).distinct()
    seen = occurring(asked, hidden).withColumnRenamed("text", "part")
    more = parts.join(seen, ["doc_id", "part"], "left_semi").groupBy("doc_id", "group_ord").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    out = groups.join(more, ["doc_id", "group_ord"], "left")
    return out.withColumn("texts", F.array_distinct(F.concat("texts", F.coalesce("parts", F.array().cast("array<string>"))))).drop("parts")
