"""Near-duplicate documents by bottom-k sketches of one hash function.

1. A document's set is the hashes of its five-word shingles; its sketch the k smallest. Documents of equal
   sets form a class at once, represented by the smallest doc_id.
2. Inverted lists of the retained values give candidates. Two sets of the wanted similarity share about
   ``threshold * k`` retained values, at least half of them but for a chance of a few in a million, so a
   sketch needs to enter only the lists of its rarest half (plus one): common passages stay out of them.
3. Within a list every member is held against the list's first class, then, where classes of one list are
   still in different components, against the members of the other components: pair by pair in short lists,
   block by block in long ones, of sets of like size only. The similarity estimated from the sketch of the union filters the pairs, the
   exact similarity of the full sets decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .components import components
from .work import saved, sized_broadcast, trimmed

K = 64
#: An estimate below this is 4.6 standard deviations from the threshold of 0.75 for K = 64.
LEAST_ESTIMATE = 0.5
#: Ids (8 bytes each) that may be broadcast to pick the texts to verify.
BROADCAST_IDS = 1_000_000
#: Members of a list whose cross-component pairs are listed; longer lists go through cells of two blocks.
SMALL_LIST = 24
BLOCK_CLASSES = 1024
#: Flipped where hashes become signed, so that signed order is the order of the hashes.
_SIGN = np.uint64(1 << 63)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """Two order-free sums that identify a set of hashes."""
    return int(np.sum(hashing.mix(hashes), dtype=np.uint64).view(np.int64)), int(np.sum(hashing.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).view(np.int64))


def sketches(docs: DataFrame, k: int = K, shingle: int = 5) -> DataFrame:
    """(doc_id, n_shingles, key1, key2, sketch) of every row, the sketch in signed order; an empty or null text has an empty one."""

    def run(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for lo, hi, _, _, _, hashes, bounds in hashing.words(text):
                n, keys, sketch, sizes = [], [], [], []
                for i in range(hi - lo):
                    own = hashing.shingles(hashes[bounds[i] : bounds[i + 1]], shingle)
                    n.append(len(own))
                    keys.append(set_key(own))
                    sketch.append((own[:k] ^ _SIGN).view(np.int64))
                    sizes.append(min(k, len(own)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(sketch)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), lists], ["doc_id", "n_shingles", "key1", "key2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), "doc_id long, n_shingles long, key1 long, key2 long, sketch array<long>")


def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, own): the full set of each class representative among ids(id), one row an id however often its document is there."""
    wanted = saved(ids.join(classes.select(F.col("rep").alias("id"), "key1", "key2"), "id"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(sized_broadcast(wanted, wanted.count(), BROADCAST_IDS // 4), "id")

    def run(batches):
        for batch in batches:
            id_, text, key1, key2 = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "text", "key1", "key2"))
            for lo, hi, _, _, _, hashes, bounds in hashing.words(text):
                own = [hashing.shingles(hashes[bounds[i] : bounds[i + 1]], shingle) for i in range(hi - lo)]
                # a doc_id may have other texts than the one that stands for its class
                keep = [i for i in range(hi - lo) if set_key(own[i]) == (key1[lo + i].as_py(), key2[lo + i].as_py())]
                ends = np.concatenate([[0], np.cumsum([len(own[i]) for i in keep])]).astype(np.int32)
                values = np.concatenate([own[i].view(np.int64) for i in keep]) if keep else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([id_.take(pa.array([lo + i for i in keep], pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "own"])

    return saved(texts.mapInArrow(trimmed(run), "id long, own array<long>").dropDuplicates(["id"]), "sets")


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) of class representatives whose full sets reach the threshold."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"{x}s"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("as", "bs")), 1, k)
    both = both.withColumn("u", union)
    near = both.where(F.size(F.array_intersect(F.array_intersect("as", "bs"), "u")) >= LEAST_ESTIMATE * F.size("u")).select("a", "b")
    near = saved(near, "near")
    own = _sets(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), classes, docs, shingle)
    held = lambda x: own.select(F.col("id").alias(x), F.col("own").alias(f"{x}s"))
    both = near.join(held("b"), "b").join(held("a"), "a").withColumn("shared", F.size(F.array_intersect("as", "bs")))
    return both.where(F.col("shared") * threshold[1] >= (F.size("as") + F.size("bs") - F.col("shared")) * threshold[0]).select("a", "b")


def _cells(placed: DataFrame) -> DataFrame:
    """placed(g, band, block, ...) once for every cell (lo, i, hi, j) in which its block meets one of its own or a neighbouring band.

    Sets of bands further apart cannot reach the threshold. side is 0 in the cell's first block, 1 in its second, 2 where both are one.
    """
    sizes = saved(placed.select("g", "band", "blocks").distinct(), "bands")
    out = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    cells = out.select("*", F.col("band").alias("lo"), F.least("block", "other").alias("i"), F.col("band").alias("hi"), F.greatest("block", "other").alias("j"), side.alias("side"))
    for step in (1, -1):
        beside = sizes.select("g", (F.col("band") - step).alias("band"), F.col("blocks").alias("theirs"))
        out = placed.join(beside, ["g", "band"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1))).drop("theirs")
        own, their = (F.col("band"), F.col("block")), (F.col("band") + step, F.col("other"))
        first, second = (own, their) if step > 0 else (their, own)
        cells = cells.unionByName(out.select("*", first[0].alias("lo"), first[1].alias("i"), second[0].alias("hi"), second[1].alias("j"), F.lit(0 if step > 0 else 1).alias("side")))
    return cells.drop("other", "blocks", "block", "band")


def _shared(lists: pa.ListArray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many values the lists of the rows left and right have in common, by products of incidence matrices; the lists' lengths."""
    flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    _, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lists)), sizes)
    common = np.flatnonzero(counts > 1)
    at = np.full(len(counts), -1)
    at[common] = np.arange(len(common))
    col = at[where]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(common), 2048):
        a, b = np.searchsorted(col, [lo, lo + 2048])
        part = np.zeros((len(lists), 2048), np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        shared += part[left] @ part[right].T
    return shared, sizes


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = table["side"].to_numpy()
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _across(left: DataFrame, classes: DataFrame, docs: DataFrame, k: int, shingle: int, threshold: tuple[int, int]) -> DataFrame:
    """Links between components within the long lists of left(v, first, rep, n, c), with no pair left out.

    Classes that long lists hold together are a group. It is cut by the size of the sets into bands, of which only neighbours can hold links, and
    these into blocks of at most about BLOCK_CLASSES; every two blocks meet in a cell, one task's work of bounded size. There
    the sketches come first: pairs whose union of sketches is shared too little are none. Only for who is left in a cell are full sets made
    and sent to it; a cell returns no more links than it takes to connect the components it saw linked.
    """
    linked = components(left.select(F.col("first").alias("a"), F.col("rep").alias("b")))
    group = left.select("rep", "n", "c").distinct().join(linked, F.col("rep") == F.col("node")).withColumnRenamed("component", "g")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(threshold[1] / threshold[0]) * 1.000001)).cast("int")
    group = saved(group.select("rep", "c", "g", band.alias("band")), "groups")
    mixed = group.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g")
    sizes = group.groupBy("g", "band").agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("int").alias("blocks")).join(mixed, "g")
    placed = group.join(saved(sizes, "sizes"), ["g", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = saved(placed, "placed")
    at = ["g", "lo", "i", "hi", "j"]
    sketched = _cells(placed).join(classes.select("rep", "sketch"), "rep")

    def meet(table: pa.Table) -> pa.Table:
        comp, (one, two) = table["c"].to_numpy(), _sides(table)
        shared, sizes = _shared(table["sketch"].combine_chunks(), one, two)
        union = np.minimum(sizes[one][:, None] + sizes[two][None, :] - shared, k)
        x, y = np.nonzero((shared >= LEAST_ESTIMATE * union) & (comp[one][:, None] != comp[two][None, :]))
        kept = np.union1d(one[x], two[y])
        return table.select([*at, "rep", "c", "side"]).take(pa.array(kept, pa.int64()))

    shape = "g long, lo int, i int, hi int, j int, rep long, c long, side int"
    near = saved(sketched.select(*at, "rep", "c", "side", "sketch").groupBy(*at).applyInArrow(meet, shape), "cells")
    held = _sets(near.select(F.col("rep").alias("id")).distinct(), classes, docs, shingle).withColumnRenamed("id", "rep").join(near, "rep")

    def verify(table: pa.Table) -> pa.Table:
        rep, comp, (one, two) = table["rep"].to_numpy(), table["c"].to_numpy(), _sides(table)
        shared, sizes = _shared(table["own"].combine_chunks(), one, two)
        union = sizes[one][:, None] + sizes[two][None, :] - shared
        x, y = np.nonzero((threshold[1] * shared >= threshold[0] * union) & (comp[one][:, None] != comp[two][None, :]))
        root: dict[int, int] = {}

        def find(n):
            while root.get(n, n) != n:
                root[n] = n = root.get(root[n], root[n])
            return n

        out = []
        for p, q in zip(one[x], two[y], strict=True):
            a, b = find(int(comp[p])), find(int(comp[q]))
            if a != b:
                root[a] = b
                out.append((int(rep[p]), int(rep[q])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return held.select(*at, "rep", "c", "side", "own").groupBy(*at).applyInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = K, shingle: int = 5, threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...).

    Rows whose sets reach the threshold (a fraction) are linked; component_id is the smallest doc_id that
    links reach. Null and empty texts have no set and stay alone. A null doc_id is linked with nothing: its
    component_id is null and it is kept. Repeated rows are one document; rows that share a doc_id but not
    a text are joined through each text's own links. Other columns, whatever their names, are not read.
    """
    sketch = saved(sketches(docs, k, shingle), "sketches")
    real = sketch.where("doc_id is not null and n_shingles > 0")
    classes = saved(real.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "classes")
    same = lambda x, y: F.least(x, y) * threshold[1] >= F.greatest(x, y) * threshold[0]

    values = classes.select("rep", "n", F.explode("sketch").alias("v"))
    shared = saved(values.groupBy("v").count().where("count > 1"), "values")
    common = values.join(shared, "v").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("count", "v"))).alias("c"))
    size = F.least("n", F.lit(k))
    prefix = F.floor(size / 2).cast("int") + 1 - (size - F.size("c")).cast("int")
    lists = common.where(prefix > 0).select("rep", "n", F.explode(F.slice("c", F.lit(1), F.greatest(prefix, F.lit(1)))).alias("x")).select("rep", "n", F.col("x.v").alias("v"))
    lists = saved(lists, "lists")

    first = saved(lists.groupBy("v").agg(F.min(F.struct("rep", "n")).alias("p"), F.count("*").alias("c")).where("c > 1").select("v", F.col("p.rep").alias("a"), F.col("p.n").alias("na")), "first")
    pairs = lists.join(first, "v").where((F.col("a") < F.col("rep")) & same("n", "na")).select("a", F.col("rep").alias("b")).distinct()
    pairs = saved(pairs, "pairs")
    links = saved(_linked(pairs, classes, docs, k, shingle, threshold), "links")
    found = saved(components(links), "found")

    member = lists.join(found, lists.rep == found.node, "left").select("v", "rep", "n", F.coalesce("component", "rep").alias("c"))
    member = saved(member, "members")
    split = member.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("rep").alias("first"), F.count("*").alias("size"))
    split = saved(split.where("lo < hi").select("v", "first", "size"), "split")
    left = saved(member.join(split, "v"), "left")
    one, two = (left.where(F.col("size") <= SMALL_LIST).select("v", *(F.col(c).alias(f"{x}{c}") for c in ("rep", "n", "c"))) for x in "ab")
    rest = one.join(two, "v").where((F.col("arep") < F.col("brep")) & (F.col("ac") != F.col("bc")) & same("an", "bn"))
    rest = rest.select(F.col("arep").alias("a"), F.col("brep").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = saved(_linked(saved(rest, "rest"), classes, docs, k, shingle, threshold), "more")
    more = more.union(saved(_across(left.where(F.col("size") > SMALL_LIST), classes, docs, k, shingle, threshold), "across"))

    # a doc_id that has several texts joins their classes
    ties = real.select("doc_id", "key1", "key2").join(classes.select("key1", "key2", "rep"), ["key1", "key2"]).where("doc_id <> rep")
    edges = links.union(more).union(ties.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = saved(components(edges), "final")
    out = sketch.select("doc_id", "n_shingles").join(final, sketch.doc_id == final.node, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its component and whether it stays."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
