"""Nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by a codebook of its own, so that few centroids make many cells: a cell is a
pair of them. A query goes through the pairs in order of their summed distance, by a heap over the two sorted lists, until the cells
met hold as many vectors as the search asks for; what they hold is ranked by exact distance in double precision.

How many to ask for is measured, not guessed: for SAMPLE_QUERIES vectors the true neighbours are found by comparing them with all
vectors, and the search goes as deep as SHARE of those would have needed. Where vectors form clusters that is a small part of
the index; where they have no structure, no cell is much better than another and it is a large part. A table of no more than
LEAST vectors is looked through whole. Codebooks are fitted to at most about FIT_ROWS vectors drawn by hash; every row is indexed.

Equal vectors are one entry with the smallest ids that any answer can hold, so a vector of any number of copies is no hot
group; large cells and those that many queries visit are dealt over tasks in blocks of entries and of queries.

Vectors that are null, empty, zero, hold a null or non-finite component, or are not of the most frequent length (ties: the longer)
take no part. Rows without vec_id are no queries; as candidates they come last among equal distances.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import saved, sized_broadcast

#: Vectors that codebooks are fitted to, at most about; rounds of fitting.
FIT_ROWS, FIT_ROUNDS = 16_384, 12
#: Centroids a half: the root of the vectors over CELL, at most MOST_CENTROIDS, whose square bounds what is sent to tasks.
CELL, MOST_CENTROIDS = 64, 1_024
#: Vectors whose true neighbours set the depth of the search, the share of neighbours it must reach, its least depth.
SAMPLE_QUERIES, SHARE, LEAST = 128, 0.97, 2_000
#: Entries and queries of a cell that are compared in one task at a time; queries whose best a task keeps before it passes them on.
BLOCK, GROUP, HELD = 512, 2_048, 4_096
#: Rows of query vectors that may be broadcast; more are joined by shuffle.
BROADCAST_QUERIES = 20_000


def takes_part(vector: Column) -> Column:
    """Whether an array<double> is finite and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows by the product of matrices: fast, and exact but for rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def codebook(points: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k centroids by Lloyd's rounds; one that loses all its points stays where it is."""
    centres = points[np.sort(np.random.default_rng(seed).permutation(len(points))[:k])].copy()
    for _ in range(FIT_ROUNDS):
        own = squares(points, centres).argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def traversal(one: np.ndarray, two: np.ndarray):
    """(i, j) of all pairs by one[i] + two[j], through a heap; one and two are distances to the centroids of each half."""
    first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    a, b = one[first].tolist(), two[second].tolist()
    heap, done = [(a[0] + b[0], 0, 0)], [0] * len(a)
    while heap:
        _, x, y = heapq.heappop(heap)
        yield int(first[x]), int(second[y])
        done[x] = y + 1
        # a pair is ready once both that come before it have been met
        if y + 1 < len(b) and (x == 0 or done[x - 1] > y + 1):
            heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
        if x + 1 < len(a) and done[x + 1] == y:
            heapq.heappush(heap, (a[x + 1] + b[y], x + 1, y))


class Index:
    """Codebooks of the halves and the number of entries of each cell; small enough to travel with a task."""

    def __init__(self, halves: tuple[np.ndarray, np.ndarray], cut: int):
        self.halves, self.cut, self.sizes = halves, cut, np.zeros(0, np.int64)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squares(vectors[:, : self.cut], self.halves[0]), squares(vectors[:, self.cut :], self.halves[1])

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        one, two = self.distances(vectors)
        return one.argmin(1) * len(self.halves[1]) + two.argmin(1)

    def visited(self, one: np.ndarray, two: np.ndarray, depth: int):
        """(cell, entries met with it) in order until ``depth`` entries have been met; empty cells are passed over."""
        met = 0
        for i, j in traversal(one, two):
            cell = i * len(self.halves[1]) + j
            if self.sizes[cell]:
                met += int(self.sizes[cell])
                yield cell, met
                if met >= depth:
                    return


def best(entries: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows of entries, squared distances) for each query: its k nearest and all that tie with the last, by exact differences."""
    rough = squares(queries, entries)
    k = min(k, entries.shape[0])
    slack = 1e-9 * ((queries * queries).sum(1) + (entries * entries).sum(1).max())
    last = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
    out = []
    for q, line, most in zip(queries, rough, last, strict=True):
        rows = np.flatnonzero(line <= most)
        exact = np.cumsum((entries[rows] - q) ** 2, axis=1)[:, -1]  # from first to last component, on any machine
        keep = exact <= np.partition(exact, k - 1)[k - 1]
        out.append((rows[keep], exact[keep]))
    return out


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """(vid, vector, ids) of rows(vec_id, uid, vector): distinct vectors with their k smallest (vec_id, uid)."""
    by = Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    first = rows.withColumn("nth", F.row_number().over(by)).where(f"nth <= {k}")
    return first.groupBy("vector").agg(F.min("uid").alias("vid"), F.collect_list(F.struct("vec_id", "uid")).alias("ids")).select("vid", "vector", "ids")


def fitted(entries: DataFrame, n: int, seed: int) -> Index:
    """An index for n entries, fitted to a bounded sample of them."""
    span = 1 << 20
    drawn = entries.where(F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(span)) < int(min(1, FIT_ROWS / n) * span) + 1).select("vid", "vector")
    table = drawn.toArrow().sort_by("vid")
    points = matrix(table.column("vector").combine_chunks())
    k = max(1, min(MOST_CENTROIDS, round((n / CELL) ** 0.5), len(points)))
    cut = (points.shape[1] + 1) // 2
    return Index((codebook(points[:, :cut], k, seed), codebook(points[:, cut:], k, seed)), cut)


def depth_of(entries: DataFrame, index: Index, k: int, seed: int) -> int:
    """Entries to be met so that SHARE of the true neighbours of the sample queries are among them; entries have their cell."""
    sample = entries.orderBy(F.xxhash64("vid", F.lit(seed + 1)), "vid").limit(SAMPLE_QUERIES).select("vid", "vector").toArrow()
    ids, queries = sample.column("vid").to_numpy(), matrix(sample.column("vector").combine_chunks())

    def near(batches):
        held = [[] for _ in ids]
        for batch in batches:
            for lo in range(0, len(batch), 4 * BLOCK):
                part = batch.slice(lo, 4 * BLOCK)
                own, cells = part.column("vid").to_numpy(), part.column("cell").to_numpy()
                for i, (rows, d) in enumerate(best(matrix(part.column("vector")), queries, k + 1)):
                    held[i] = sorted([*held[i], *((float(x), int(own[r]), int(cells[r])) for r, x in zip(rows, d, strict=True) if own[r] != ids[i])])[:k]
        flat = [(i, *x) for i, own in enumerate(held) for x in own]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int64()))], ["i", "d", "vid", "cell"])

    found = entries.select("vid", "vector", "cell").mapInArrow(near, "i int, d double, vid long, cell long")
    order = Window.partitionBy("i").orderBy("d", "vid")
    wanted = found.withColumn("nth", F.row_number().over(order)).where(f"nth <= {k}").groupBy("i").agg(F.collect_set("cell").alias("cells"), F.collect_list("cell").alias("all")).collect()
    depths, (one, two) = [], index.distances(queries)
    for row in wanted:
        left, at = set(row["cells"]), {}
        for cell, met in index.visited(one[row["i"]], two[row["i"]], 1 << 62):
            if cell in left:
                at[cell] = met
                left.discard(cell)
                if not left:
                    break
        depths += [at[c] for c in row["all"]]
    depths.sort()
    return max(LEAST, depths[min(len(depths) - 1, int(SHARE * len(depths)))]) if depths else LEAST


def _visits(index: Index, depth: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.slice(lo, BLOCK)
                one, two = index.distances(matrix(part.column("vector")))
                cells = [[c for c, _ in index.visited(a, b, depth)] for a, b in zip(one, two, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("qid"), pa.array(cells, pa.list_(pa.int64()))], ["qid", "cells"])

    return run


def _ranked(k: int):
    """Rows sorted by (cell, block, share) come entries first; then each block of queries is compared with the entries held.

    A task keeps the best of at most HELD queries and passes on (qid, d, ids) when there are more, and at its end.
    """

    def out(held: dict) -> pa.RecordBatch:
        flat = [(q, d, x) for q, own in held.items() for d, _, x in own]
        kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("uid", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.float64()), pa.array([f[2] for f in flat], kind)], ["qid", "d", "ids"])

    def run(batches):
        held, mark, entries, ids = {}, None, None, []
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "share", "asks")], 1) if len(batch) else np.zeros((0, 4))
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(batch)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                now, asks = tuple(marks[lo, :3]), marks[lo, 3]
                if now != mark:
                    mark, entries, ids = now, None, []
                part = batch.slice(lo, hi - lo)
                if not asks:
                    own = matrix(part.column("vector"))
                    entries, ids = own if entries is None else np.concatenate([entries, own]), ids + part.column("ids").to_pylist()
                    continue
                for at in range(0, len(part), 64):
                    some = part.slice(at, 64)
                    for q, (rows, d) in zip(some.column("id").to_pylist(), best(entries, matrix(some.column("vector")), k), strict=True):
                        mine = held.get(q, []) + [(float(x), (ids[r][0]["vec_id"] is None, ids[r][0]["vec_id"], ids[r][0]["uid"]), ids[r]) for r, x in zip(rows, d, strict=True)]
                        held[q] = sorted(mine, key=lambda x: x[:2])[:k]
                    if len(held) > HELD:
                        yield out(held)
                        held = {}
        yield out(held)

    return run


def searched(entries: DataFrame, queries: DataFrame, index: Index, depth: int, k: int) -> DataFrame:
    """(qid, d, vec_id, uid): the k nearest rows of each of queries(qid, vector) that the index finds, d being squared."""
    found = queries.mapInArrow(_visits(index, depth), "qid long, cells array<bigint>")
    visits = saved(found.select("qid", F.explode("cells").alias("cell")), "visits")
    # at most MOST_CENTROIDS squared rows of three numbers
    asked = visits.groupBy("cell").agg(F.count("*").alias("asked"))
    cells = entries.groupBy("cell").agg(F.count("*").alias("size")).join(asked, "cell")
    parts = lambda n, by: F.expr(f"cast(({n} + {by - 1}) div {by} as int)")
    cells = F.broadcast(saved(cells.select("cell", parts("size", BLOCK).alias("blocks"), parts("asked", GROUP).alias("shares")), "cells"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    held = entries.join(cells, "cell").select("cell", deal("vid", "blocks").alias("block"), every("shares").alias("share"), F.lit(0).alias("asks"), F.col("vid").alias("id"), "vector", "ids")
    wide = visits.join(cells, "cell").join(sized_broadcast(queries, queries.count(), BROADCAST_QUERIES), "qid")
    asks = wide.select("cell", every("blocks").alias("block"), deal("qid", "shares").alias("share"), F.lit(1).alias("asks"), F.col("qid").alias("id"), "vector", F.lit(None).cast(held.schema["ids"].dataType).alias("ids"))
    both = held.unionByName(asks).repartition("cell", "block", "share").sortWithinPartitions("cell", "block", "share", "asks")
    near = both.mapInArrow(_ranked(k), "qid long, d double, ids array<struct<vec_id:bigint,uid:bigint>>").select("qid", "d", F.inline("ids"))
    order = Window.partitionBy("qid").orderBy("d", F.col("vec_id").asc_nulls_last(), "uid")
    return near.withColumn("nth", F.row_number().over(order)).where(f"nth <= {k}").drop("nth")


def neighbours(vectors: DataFrame, asks: Column, k: int = 10, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row of vectors(vec_id, embedding) for which ``asks`` holds.

    score is the Euclidean distance; nearest first, ties to the smaller vec_id.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = saved(rows.where(takes_part(F.col("vector"))).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.where(F.size("vector") == (length["length"] if length else 0))
    entries = saved(entries_of(rows, k + 1), "entries")
    n = entries.count()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    index = fitted(entries, n, seed)
    entries = saved(entries.mapInArrow(_assigned(index), "vid long, vector array<double>, ids array<struct<vec_id:bigint,uid:bigint>>, cell long"), "cells")
    index.sizes = np.zeros(len(index.halves[0]) * len(index.halves[1]), np.int64)
    for cell, size in entries.groupBy("cell").count().collect():  # at most MOST_CENTROIDS squared
        index.sizes[cell] = size
    depth = n if n <= LEAST else depth_of(entries, index, k, seed)
    own = rows.where("asks and vec_id is not null")
    queries = saved(own.select("vector").distinct().withColumn("qid", F.monotonically_increasing_id()).select("qid", "vector"), "queries")
    answers = saved(searched(entries, queries, index, depth, k + 1), "answers")
    named = own.select(F.col("vec_id").alias("query_id"), F.col("uid").alias("own"), "vector").join(sized_broadcast(queries, queries.count(), BROADCAST_QUERIES), "vector").drop("vector")
    order = Window.partitionBy("own").orderBy("d", F.col("vec_id").asc_nulls_last(), "uid")
    near = named.join(answers, "qid").where("uid <> own").withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return near.select("query_id", "rank", "vec_id", F.sqrt("d").alias("score"))


def _assigned(index: Index):
    def run(batches):
        for batch in batches:
            cells = [index.cells(matrix(batch.slice(lo, 4 * BLOCK).column("vector"))) for lo in range(0, len(batch), 4 * BLOCK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(cells) if cells else [], pa.int64())], [*batch.schema.names, "cell"])

    return run


def op13_multi_index_search(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all others."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


#: Comparing all; the index gives the same rows where it looks through all of a table (LEAST), and so many of them as SHARE says beyond.
ORACLE_SQL = """
WITH fine AS (SELECT row_number() OVER () AS uid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT * FROM fine WHERE len(v) = (SELECT len(v) FROM fine GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)),
d AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, c.uid AS other, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, x: a + x)) AS score
  FROM sized q JOIN sized c ON q.uid <> c.uid WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score, vec_id NULLS LAST, other) AS INT) AS rank, vec_id, score FROM d
QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score, vec_id NULLS LAST, other) <= 10
"""
