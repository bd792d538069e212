"""Quality selection by importance resampling with hashed n-gram models.

Two bag-of-n-grams models over hashed buckets are counted in one pass: one of the target (labelled good and
not toxic), one of the raw corpus. A document's log weight is the log ratio of its probabilities under the
two; adding Gumbel noise and keeping the k largest samples k documents without replacement in proportion
to their weights. n-grams are byte trigrams within the text and pairs of neighbouring words, where a word
followed by itself is one n-gram of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .work import saved, sized_broadcast, trimmed

BUCKETS = 1 << 16
#: Fixed-point unit of log weights and keys: sums are exact, whatever order they are made in.
UNIT = 1 << 16
SEED = 17
#: Labelled ids that may be broadcast; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000


def _grams(col: pa.Array, buckets: int):
    """(first row, row after the last, bucket of each n-gram, row bounds of the n-grams) block by block."""
    repeat = np.uint64(0x1234567)
    _, offsets = hashing.buffers(col)
    for lo, hi, data, _, _, hashes, bounds in hashing.words(col):
        data_at = offsets[lo : hi + 1] - offsets[lo]
        tri, pair = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(data) > 2:
            tri = data[:-2].astype(np.uint64)
            for more in (data[1:-1], data[2:]):
                tri <<= np.uint64(8)
                tri |= more
            tri = hashing.mix(tri)
            tri %= np.uint64(buckets)
        if len(hashes) > 1:
            pair = np.where(hashes[:-1] == hashes[1:], repeat, hashing.mix(hashes[:-1] * np.uint64(3) + hashes[1:]))
            pair %= np.uint64(buckets)
        tri, pair = tri.view(np.int64), pair.view(np.int64)
        out, sizes = [], np.zeros(hi - lo + 1, np.int64)
        for i in range(hi - lo):
            one, two = tri[data_at[i] : max(data_at[i], data_at[i + 1] - 2)], pair[bounds[i] : max(bounds[i], bounds[i + 1] - 1)]
            out += [one, two]
            sizes[i + 1] = len(one) + len(two)
        yield lo, hi, np.concatenate(out), np.cumsum(sizes)


def target_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of every labelled doc_id: good if all its rows say quality 1 and none says toxic 1; nulls are left out."""
    rows = labels.where("doc_id is not null and quality is not null")
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("good"), (F.max("quality") == 0).alias("bad"))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = saved(target_ids(labels), "labels")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.join(sized_broadcast(known, known.count(), BROADCAST_LABELS), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad"))


def log_ratios(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Fixed-point log ratio of target to raw probability of each bucket, from all of rows(text, good, ...).

    The counts are made in the tasks and summed in Spark; the driver gets one row a bucket.
    """

    def count(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, grams, bounds in _grams(batch.column(0), buckets):
                raw += np.bincount(grams, minlength=buckets)
                mask = np.repeat(good[lo:hi], np.diff(bounds))
                target += np.bincount(grams[mask], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    sums = rows.select("text", "good").mapInArrow(trimmed(count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.full(buckets, 0.5), np.full(buckets, 0.5)
    raw[sums["bucket"]] += sums["raw"]
    target[sums["bucket"]] += sums["target"]
    return np.round((np.log(target / target.sum()) - np.log(raw / raw.sum())) * UNIT).astype(np.int64)


def gumbel(seed: int, *cols: str) -> Column:
    """Fixed-point standard Gumbel noise, a function of the seed and the columns alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return F.floor(-F.log(-F.log(u)) * UNIT).cast("long")


def scored(docs: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """docs with the columns lw_ (fixed-point log weight), lw_n_ (n-grams) and lw_key_ (weight plus noise)."""
    names, fields = docs.columns, docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    plain = docs.withColumn("lw_text_", F.col("text").cast("string"))

    def run(batches):
        for batch in batches:
            weight, n = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for lo, hi, grams, bounds in _grams(batch.column(len(names)), len(shared.value)):
                sums = np.concatenate([[0], np.cumsum(shared.value[grams])])
                weight[lo:hi] = sums[bounds[1:]] - sums[bounds[:-1]]
                n[lo:hi] = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(weight), pa.array(n)], [*names, "lw_", "lw_n_"])

    added = [T.StructField("lw_", T.LongType()), T.StructField("lw_n_", T.LongType())]
    return plain.mapInArrow(trimmed(run), T.StructType([*fields.fields, *added])).withColumn("lw_key_", F.col("lw_") + gumbel(seed, "doc_id"))


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> tuple[int, int]:
    """(value of the k-th largest long of the column, how many are larger), by counting in ever narrower bins."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    above = 0
    k = min(k, n)
    while lo < hi:
        width = (hi - lo) // bins + 1
        counts = df.where(F.col(col).between(lo, hi)).groupBy(F.expr(f"cast(({col} - ({lo}L)) div {width}L as long)").alias("bin")).count().collect()
        for row in sorted(counts, key=lambda r: -r["bin"]):
            if above + row["count"] >= k:
                lo, hi = lo + row["bin"] * width, min(hi, lo + (row["bin"] + 1) * width - 1)
                break
            above += row["count"]
    return lo, above


def cutoff(weights: DataFrame) -> int:
    """The log weight that best parts good from bad among rows(lw_, good, bad): most true less false acceptances.

    Every distinct weight of a labelled document is tried as the least that is accepted, of equally good ones the lowest
    is taken. Running counts are made in ranges of weights and summed over the ranges, so no task sees all. The cutoff lies
    half-way between the labelled documents on its two sides, so that unlabelled ones near either are not cut.
    0 where a label is missing.
    """
    each = weights.where("good or bad").groupBy("lw_").agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b"))
    each = saved(each.repartitionByRange("lw_").withColumn("range", F.spark_partition_id()), "edges")
    good, bad = each.agg(F.sum("g"), F.sum("b")).first()
    if not good or not bad:
        return 0
    ranges = each.groupBy("range").agg(F.sum("g").alias("gs"), F.sum("b").alias("bs"), F.max("lw_").alias("top"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = ranges.select("range", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("gs", "bs")), F.max("top").over(upto).alias("top"))
    own = Window.partitionBy("range").orderBy("lw_")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c, s: F.col(s) + F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = each.join(F.broadcast(ranges), "range").select("lw_", below("g", "gs").alias("g"), below("b", "bs").alias("b"), F.coalesce(F.lag("lw_").over(own), "top").alias("under"))
    best = rows.select((F.col("b") * good - F.col("g") * bad).alias("gain"), (-F.col("lw_")).alias("low"), "under").agg(F.max(F.struct("gain", "low", "under")).alias("m")).first()["m"]
    return -best["low"] if best["under"] is None else (best["under"] - best["low"] + 1) // 2


def model(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> tuple[np.ndarray, int, int, DataFrame]:
    """(ratios, least key, least doc_id at that key, narrow scores) of a sample of k documents.

    Without k it is the number of documents whose log weight reaches the cutoff learned from the labels.
    """
    rows = _labelled(docs, labels)
    ratios = log_ratios(rows)
    narrow = saved(scored(rows, ratios, seed).drop("text"), "weights")
    if k is None:
        k = narrow.where(F.col("lw_") >= cutoff(narrow)).count()
    if k <= 0 or narrow.isEmpty():
        return ratios, (1 << 62), 0, narrow
    key, above = kth_largest(narrow, "lw_key_", k)
    tied = narrow.where(F.col("lw_key_") == key).select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id"))
    return ratios, key, kth_largest(tied, "id", k - above)[0], narrow


def _chosen(key: int, least: int) -> Column:
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)))
    return (F.col("lw_key_") > key) | ((F.col("lw_key_") == key) & (ids >= least))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs that a sample of k keeps, with their columns.

    Null and empty texts have log weight 0 and can be drawn. Noise is a function of doc_id, so equal rows
    stay or go together; rows tied at the last place beyond doc_id all stay. Rows with a null doc_id are
    scored like others. An empty table gives an empty one; without labels of both kinds the cutoff is 0.
    """
    ratios, key, least, _ = model(docs, labels, k, seed)
    return scored(docs, ratios, seed).where(_chosen(key, least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document with its log weight, its key with noise and whether the sample keeps it."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    _, key, least, narrow = model(docs, labels)
    return narrow.select("doc_id", F.col("lw_n_").alias("n_grams"), (F.col("lw_") / UNIT).alias("log_weight"), (F.col("lw_key_") / UNIT).alias("gumbel_key"), _chosen(key, least).alias("selected"))
