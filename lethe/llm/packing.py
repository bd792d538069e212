"""Variable-capacity best-fit packing of documents into training sequences of several permitted lengths.

Documents are dealt by hash, and repeated rows by their number, to groups of about GROUP pieces, so a group's size does
not depend on the size of the input, and each group is packed on its own; all that the split costs is one part-filled bin a group. In
a group, pieces go by falling length into the fullest bin that has room. A bin is opened at the
permitted length of least cost that holds the piece, at or above a floor; the floors compete, each is packed
in full, and the one of least total cost after every bin has been reduced to the cheapest length that
still holds its contents wins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mixing import n_tokens
from .work import saved

#: Permitted sequence lengths in tokens, and what a sequence costs beside its length.
CAPACITIES = (256, 512, 1024, 2048, 4096)
OVERHEAD = 32
GROUP = 1024


def _fit(sizes: list[int], opened: list[int], floor: int) -> tuple[list[int], list[int]]:
    """Bin of each size (given by falling size) and what each bin holds; opened[s] is the length for a piece of s."""
    bins, used, room = [], [], []  # room: sorted (free, bin)
    for s in sizes:
        at = bisect_left(room, (s, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = opened[max(s, floor)], len(used)
            used.append(0)
        bins.append(b)
        used[b] += s
        if free > s:
            insort(room, (free - s, b))
    return bins, used


@lru_cache(maxsize=8)
def _cheapest(prices: tuple[tuple[int, float], ...]) -> list[int]:
    """The length of least cost (the shorter, of equals) that holds s tokens, for every s."""
    return [min((cost, c) for c, cost in prices if c >= s)[1] for s in range(prices[-1][0] + 1)]


def best_fit(sizes: list[int], capacities: tuple[int, ...], costs: tuple[float, ...]) -> tuple[list[int], list[int]]:
    """Bin of each size and the final length of each bin: the cheapest of the packings over all opening floors."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    falling = [sizes[i] for i in order]
    price = dict(zip(capacities, costs, strict=True))
    cheapest = _cheapest(tuple(sorted(price.items())))
    best = None
    for floor in capacities:
        bins, used = _fit(falling, cheapest, floor)
        total = sum(price[cheapest[u]] for u in used)
        if best is None or total <= best[0]:
            best = (total, bins, used)
    _, bins, used = best
    out = [0] * len(sizes)
    for i, b in zip(order, bins, strict=True):
        out[i] = b
    return out, [cheapest[u] for u in used]


def pieces(docs: DataFrame, longest: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, row, piece, start, n_tokens, [text]): a document's words and one end token, cut at the longest length; row numbers the rows of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("total", n_tokens(F.col("text")) + 1)
    # written, so that texts are read once and a row keeps its number
    rows = saved(rows.select("doc_id", "total", F.monotonically_increasing_id().alias("row"), *(["text"] if "text" in carry else [])), "pieces")
    last = F.expr(f"cast((total - 1) div {longest} as int)")
    start = F.col("piece").cast("long") * longest
    if "text" not in carry:
        rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
        return rows.withColumn("start", start).withColumn("n_tokens", F.least(F.col("total") - F.col("start"), F.lit(longest)).cast("long")).drop("total")
    # a long text is split once, below the generator, and only its pieces are copied
    words = F.when(F.col("total") > longest, F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"))
    rows = rows.withColumn("words", words).withColumn("text", F.when(F.col("words").isNull(), F.col("text")))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.slice("words", i * longest + 1, F.lit(longest)), "")))
    rows = rows.select("doc_id", "row", "total", F.posexplode(cut).alias("piece", "text"))
    return rows.select("doc_id", "row", "piece", start.alias("start"), F.least(F.col("total") - start, F.lit(longest)).cast("long").alias("n_tokens"), "text")


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, costs: tuple[float, ...] | None = None, carry: tuple[str, ...] = (), group: int = GROUP) -> DataFrame:
    """Place every token of docs(doc_id, text, ...): one row a piece with its bin, the bin's length and its offset there.

    Returns doc_id, piece, start (token of the document it begins at), n_tokens, bin_id, bin_length, bin_tokens
    and bin_offset; with carry=("text",) also the piece's text. A null or empty text is one end token. Repeated
    rows and null doc_ids are packed like any others, each in a group by its number; other columns are not read. An empty table gives
    an empty one. costs: of a sequence of each capacity; its length and OVERHEAD unless given.
    """
    capacities = tuple(sorted(capacities))
    costs = costs or tuple(float(c + OVERHEAD) for c in capacities)
    rows = pieces(docs, capacities[-1], carry)
    groups = max(1, -(-rows.count() // group))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)))
    texts = ["text"] if "text" in carry else []

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        sizes = table["n_tokens"].to_pylist()
        bins, lengths = best_fit(sizes, capacities, costs)
        used, offsets = [0] * len(lengths), []
        for b, s in zip(bins, sizes, strict=True):
            offsets.append(used[b])
            used[b] += s
        ids = np.array(bins, np.int64) + (np.int64(table["group"][0].as_py()) << np.int64(20))
        columns = [table["doc_id"], table["piece"], table["start"], table["n_tokens"], pa.array(ids), pa.array([lengths[b] for b in bins], pa.int64()), pa.array([used[b] for b in bins], pa.int64()), pa.array(offsets, pa.int64())]
        return pa.table(dict(zip(schema.names, [*columns, *(table[c] for c in texts)], strict=True)))

    schema = T.StructType.fromDDL("doc_id long, piece int, start long, n_tokens long, bin_id long, bin_length long, bin_tokens long, bin_offset long" + ", text string" * bool(texts))
    return rows.select("group", "doc_id", "row", "piece", "start", "n_tokens", *texts).groupBy("group").applyInArrow(run, schema)


def sequences(packed: DataFrame, end: str = "\n") -> DataFrame:
    """(bin_id, bin_length, bin_tokens, text): the texts of each bin of a packing that carries them, joined by its end mark."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("bin_offset", "text"))), lambda x: x["text"])
    return packed.groupBy("bin_id", "bin_length", "bin_tokens").agg(F.array_join(parts, end).alias("text"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Where every token of every document goes."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
