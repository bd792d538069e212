"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is the rows of equal texts. Groups of equal size are interchangeable, so the driver packs sizes with
their counts, of which there are at most the square root of twice the total size (250,000 for 30 GB), and every group is packed as
if alone. Items enter, by falling size, the shard of tightest remaining capacity that holds them, found in a balanced
tree; which groups of a size go where is then settled in Spark by their rank.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import saved, sized_broadcast

SHARDS = 40
#: A row's size beside its text's bytes.
ROW_BYTES = 16
BROADCAST_ROWS = 100_000


class Tree:
    """A treap of (free, bin): the least entry not below a key in logarithmic time."""

    def __init__(self) -> None:
        self.root = None

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, crc32(repr(key).encode()), None, None]), high)

    def take(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """Remove and return the least entry that is not below key."""
        low, high = self._split(self.root, key)
        if high is None:
            self.root = low
            return None
        node = high
        while node[2]:
            node = node[2]
        found = node[0]
        _, rest = self._split(high, (found[0], found[1] + 1))
        self.root = self._join(low, rest)
        return found

    def _split(self, node, key):
        """Trees of the entries below key and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] >= b[1]:
            return [a[0], a[1], a[2], self._join(a[3], b)]
        return [b[0], b[1], self._join(a, b[2]), b[3]]


def best_fit_decreasing(items: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(runs (size, bin, how many), number of bins) of items (size, count) by falling size; a size beyond the capacity has a bin of its own.

    A bin that takes one of a size stays the tightest for the next, so it takes as many as it holds at once. Given
    ``most``, packing stops with the first bin beyond it.
    """
    tree, bins, out = Tree(), 0, []
    for size, count in items:
        while count:
            got = tree.take((size, -1))
            if got is None:
                got, bins = (max(capacity, size), bins), bins + 1
                if most is not None and bins > most:
                    return out, bins
            n = min(count, got[0] // size)
            count -= n
            out.append((size, got[1], n))
            if got[0] > n * size:
                tree.add((got[0] - n * size, got[1]))
    return out, bins


def into(items: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs (size, bin, how many): best-fit-decreasing at the least capacity (to a ten-thousandth) that needs no more bins.

    A size above the fair share has a bin of its own and the others share the rest.
    """
    out, rest, total = [], list(items), sum(s * n for s, n in items)
    while rest and shards - len(out) > 1 and rest[0][0] * (shards - len(out)) > total:
        size, n = rest[0]
        out.append((size, len(out), 1))
        total -= size
        rest[0] = (size, n - 1)
        if n == 1:
            rest.pop(0)
    if not rest:
        return out
    alone, left = len(out), shards - len(out)
    fair = -(-total // left)
    low, high = fair - 1, fair + rest[0][0]  # low never fits, and at high it is below the fair share that a bin closes
    best, n = best_fit_decreasing(rest, high)
    while n > left:
        low, high = high, high * 2
        best, n = best_fit_decreasing(rest, high)
    while high - low > max(1, fair // 10000):
        mid = (low + high) // 2
        got, n = best_fit_decreasing(rest, mid, left)
        if n <= left:
            best, high = got, mid
        else:
            low = mid
    return out + [(size, alone + b, n) for size, b, n in best]


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, sh_group, sh_salt): a null text has no bytes and is in the group of the empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    return rows.select("doc_id", (F.octet_length("text").cast("long") + ROW_BYTES).alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text", F.length("text")).alias("sh_group"), F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias("sh_salt"))


def _numbered(rows: DataFrame, keys: list[str], order: list[str], n: int, name: str) -> DataFrame:
    """rows with ``name``, a gapless number from 0 within the keys; a key is numbered in about sqrt(n) parts, none of which grows with it alone."""
    parts = max(1, round(n**0.5))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = dealt.groupBy(*keys, "part").count()
    first = (F.sum("count").over(Window.partitionBy(*keys).orderBy("part")) - F.col("count")).alias("first")
    first = saved(counts.select(*keys, "part", first), "first")
    within = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(*order))
    out = dealt.withColumn("within", within).join(sized_broadcast(first, first.count(), BROADCAST_ROWS), [*keys, "part"])
    return out.withColumn(name, (F.col("first") + F.col("within") - 1).cast("long")).drop("part", "within", "first")


def _placed(groups: DataFrame, shards: int | None, capacity: int | None) -> DataFrame:
    """(sh_group, text_crc32, shard) of groups(sh_group, text_crc32, bytes)."""
    items = groups.groupBy("bytes").count().toArrow().sort_by([("bytes", "descending")])
    items = list(zip(*(c.to_pylist() for c in items.columns), strict=True))
    runs = into(items, shards) if shards else best_fit_decreasing(items, capacity)[0]
    upto: dict[int, int] = {}
    placed = []
    for size, b, n in runs:
        at = upto.get(size, 0)
        placed.append((size, at, at + n, b))
        upto[size] = at + n
    counts = dict(items)
    one = [(size, b) for size, lo, hi, b in placed if hi - lo == counts[size]]
    many = [p for p in placed if p[2] - p[1] != counts[p[0]]]
    spark, key = groups.sparkSession, ["sh_group", "text_crc32", "shard"]
    whole = groups.join(sized_broadcast(spark.createDataFrame(one, "bytes long, shard int"), len(one), BROADCAST_ROWS), "bytes").select(*key)
    if not many:
        return whole
    runs = spark.createDataFrame(many, "bytes long, lo long, hi long, shard int")
    cut = groups.join(sized_broadcast(runs.select("bytes").distinct(), len(many), BROADCAST_ROWS), "bytes", "left_semi")
    cut = _numbered(cut, ["bytes"], ["sh_group", "text_crc32"], groups.count(), "nth")
    return whole.unionByName(cut.join(sized_broadcast(runs, len(many), BROADCAST_ROWS), "bytes").where("nth >= lo and nth < hi").select(*key))


def sharded(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs(doc_id, text, ...).

    With ``shards`` their sizes are made near equal; with shards=None as few shards of ``capacity`` bytes as best fit
    finds. Rows of equal texts share a shard; a group beyond the fair share has one of its own. Slots
    count a shard's rows from 0 without gaps. Null texts go with empty ones, null doc_ids and repeated rows are placed
    like any others, other columns are not read; an empty table gives an empty one.
    """
    rows = saved(sized(docs), "sized")
    groups = saved(rows.groupBy("sh_group", "text_crc32").agg(F.sum("size").alias("bytes")), "groups")
    where = saved(_placed(groups, shards, capacity), "where")
    n_groups = where.count()
    placed = saved(rows.join(sized_broadcast(where, n_groups, BROADCAST_ROWS), ["sh_group", "text_crc32"]), "placed")
    out = _numbered(placed, ["shard"], ["doc_id", "sh_group", "sh_salt"], -(-placed.count() // (shards or SHARDS)), "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def op7_balanced_shards(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    rows = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
