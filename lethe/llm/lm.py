"""A log-bilinear language model trained by noise-contrastive estimation, and the unigram baseline.

Tokens are words (A-Z lower-cased) and one end mark a text. The model predicts a token's class from the two
tokens before it and the token from its class. A frequent word is a class of its own; every other word belongs
to one of RARE classes by its last two bytes, and within the class has the probability (c + 1) / (N + V + 1) of the class's
training tokens N and distinct words V, one share being that of all unseen words. Class probabilities are the normalised
exponentials of (C1 r[w-1] + C2 r[w-2]) q[class] + b[class].

Texts become token classes once. Training is data-parallel over shards of about SHARD tokens, dealt by a hash of the documents and
not by how they are stored: in each round every shard of that round is passed over from the common parameters
and Adagrad sums, and both are averaged. Noise is the unigram distribution. Frequent words, and with them what is
learned, grow with the training tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .work import saved, sized_broadcast

END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: Words with their own class per fifth root of the training tokens, classes of the others, width of the vectors.
OWN, RARE, DIM = 76, 256, 32
#: Rounds of averaging, tokens of a shard, passes over it, noise samples a batch, tokens a batch, learning rate.
ROUNDS, SHARD, PASSES, NOISE, BATCH, RATE = 3, 1 << 22, 1, 256, 1024, 0.15
#: Fixed-point unit of averaged parameters, so that a sum does not depend on its order.
UNIT = 1 << 24
#: Shards whose states a task adds at a time.
SUMMED = 32
#: Words whose counts tasks hold; counts of the others are joined.
HELD = 1 << 16
#: Classes up to which a task holds the sums of all contexts (their square, 4 bytes each); beyond, contexts whose sums it keeps.
TABLED, CONTEXTS = 8_192, 1 << 21


def split(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out): held out are the documents whose id's CRC-32 leaves 2 by 7; a null id counts as an empty one."""
    shown = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.crc32(shown) % 7 == 2).alias("held_out"))


def _tokens(col: pa.Array):
    """(first row, row after the last, hashes, rare classes, row bounds): tokens block by block, an end mark after each text."""
    for lo, hi, data, starts, ends, hashes, bounds in hashing.words(col):
        low = hashing._LOWER[data]
        last = low[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
        prev = np.where(ends - starts > 1, low[ends - 2], 0).astype(np.uint64) if len(ends) else last
        rare = (hashing.mix(last << np.uint64(8) | prev) % np.uint64(RARE)).astype(np.int64)
        at = bounds[1:]
        yield lo, hi, np.insert(hashes, at, END), np.insert(rare, at, 0), bounds + np.arange(hi - lo + 1)


def counts(rows: DataFrame) -> DataFrame:
    """(h, c, cls): how often each token occurs in all of rows(text) and the class of rare words it would be in."""

    def run(batches):
        for batch in batches:
            for _, _, hashes, rare, _ in _tokens(batch.column(0)):
                h, at, c = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(rare[at].astype(np.int32))], ["h", "c", "cls"])

    return rows.select("text").mapInArrow(run, "h long, c long, cls int").groupBy("h").agg(F.sum("c").alias("c"), F.min("cls").alias("cls"))


def most_frequent(table: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and rare classes of the frequent words: as many as fit in n with all words as frequent.

    The count to reach is found from the number of words by count, so no task and no driver sorts the vocabulary.
    """
    by = table.groupBy(F.floor(F.log2("c") * 16).alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()
    least, total = None, 0
    for row in by:
        total += row["n"]
        if total > n:
            break
        least = row["least"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = table.where(F.col("c") >= least).select("c", "h", "cls").toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    c, h, cls = (x.to_numpy().astype(np.int64) for x in top.columns)
    return h.view(np.uint64), c, cls


class Lexicon:
    """What every task holds: frequent words' counts, which of them are classes, and how rare classes are filled."""

    def __init__(self, hashes, held, cls, own, rare_n, rare_v, n, v):
        order = np.argsort(hashes)
        self.hashes, self.count, self.cls = hashes[order], held[order], cls[order].copy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.cls[place[:own]] = RARE + np.arange(own)  # the most frequent have classes of their own
        self.own, self.n, self.v = own, n, v
        self.rare_n, self.rare_v = rare_n, rare_v
        mass = np.concatenate([rare_n + 1.0, held[:own].astype(float)])
        self.unigram = mass / mass.sum()

    def find(self, hashes, rare):
        """(count or -1 if not held, class) of each token."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64), rare
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        held = self.hashes[at] == hashes
        return np.where(held, self.count[at], -1), np.where(held, self.cls[at], rare)


def lexicon(table: DataFrame) -> Lexicon:
    """From the saved counts; the driver gets HELD words and one row a rare class. Not all of HELD words have vectors."""
    n, v = (x or 0 for x in table.agg(F.sum("c"), F.count("*")).first())
    hashes, held, cls = most_frequent(table, HELD)
    own = min(round(OWN * max(n, 1) ** 0.2), len(hashes))
    rare_n, rare_v = np.zeros(RARE), np.zeros(RARE)
    for row in table.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        rare_n[row["cls"]], rare_v[row["cls"]] = row["n"], row["v"]
    np.subtract.at(rare_n, cls[:own], held[:own])
    np.subtract.at(rare_v, cls[:own], 1)
    return Lexicon(hashes, held, cls, own, rare_n, rare_v, n, v)


def initial(lex: Lexicon, seed: int = 5) -> dict[str, np.ndarray]:
    m = RARE + lex.own
    rng = np.random.default_rng(seed)
    small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    # one more row of r1 and r2 for the start of a text
    return {"r1": small(m + 1, DIM), "r2": small(m + 1, DIM), "q": small(m, DIM), "b": np.log(lex.unigram).astype(np.float32)}


def _before(cls, bounds, start):
    """Classes one and two tokens before each token; start before the text."""
    one, two = np.concatenate([[start], cls[:-1]]), np.concatenate([[start, start], cls[:-2]])[: len(cls)]
    one[bounds[:-1]] = start
    two[bounds[:-1]] = start
    second = bounds[:-1] + 1
    two[second[second < bounds[1:]]] = start
    return one, two


def _add(target, ids, grads, rate, seen):
    """Adagrad step on the rows named by ids, gradients of one row summed first."""
    order = np.argsort(ids.astype(np.int16), kind="stable")  # there are fewer classes than that holds
    ids, grads = ids[order], grads[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    total = np.add.reduceat(grads, first, axis=0)
    at = ids[first]
    seen[at] += total * total
    target[at] -= rate * total / np.sqrt(seen[at] + 1e-6)


def _inverse(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place; a large x gives 0."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def train_part(p, seen, lex, stream, rng):
    """Passes of noise-contrastive estimation over blocks of (classes, one before, two before); parameters and Adagrad sums change in place."""
    cdf, log_noise = np.cumsum(lex.unigram), np.log(lex.unigram * NOISE).astype(np.float32)
    room, one_more = np.empty((BATCH, NOISE), np.float32), np.ones((BATCH, DIM + 1), np.float32)
    against = np.empty((NOISE, DIM + 1), np.float32)
    for cls, one, two in stream:
        order = rng.permutation(len(cls))
        for lo in range(0, len(cls), BATCH):
            i = order[lo : lo + BATCH]
            w, a, b = cls[i], one[i], two[i]
            wide = one_more[: len(i)]
            ctx = np.add(p["r1"][a], p["r2"][b], out=wide[:, :DIM])
            noise = np.minimum(np.searchsorted(cdf, rng.random(NOISE)), len(cdf) - 1)
            q, qn = p["q"][w], p["q"][noise]
            # minus the scores of the noise, biases being one more column
            np.negative(qn, out=against[:, :DIM])
            against[:, DIM] = log_noise[noise] - p["b"][noise]
            down = _inverse(np.matmul(wide, against.T, out=room[: len(i)]))  # d loss / d score
            up = -_inverse(np.einsum("ij,ij->i", ctx, q) + (p["b"][w] - log_noise[w]))
            grad = up[:, None] * q + down @ qn
            ids = np.concatenate([w, noise])
            _add(p["q"], ids, np.concatenate([up[:, None] * ctx, down.T @ ctx]), RATE, seen["q"])
            _add(p["b"], ids, np.concatenate([up, down.sum(0)]), RATE / 4, seen["b"])
            _add(p["r1"], a, grad, RATE, seen["r1"])
            _add(p["r2"], b, grad, RATE, seen["r2"])


def _flat(*tables: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([t[k].ravel() for t in tables for k in sorted(t)])


def _shaped(flat: np.ndarray, *like: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
    out, at = [], 0
    for table in like:
        out.append({})
        for k in sorted(table):
            out[-1][k] = flat[at : at + table[k].size].reshape(table[k].shape).astype(np.float32)
            at += table[k].size
    return out


def _blocks(lists: pa.ListArray, start: int, tokens: int = 1 << 17):
    """(classes, one before, two before) of whole texts, about so many tokens at a time."""
    flat, ends = lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    at = 0
    while at < len(lists):
        z = max(at + 1, int(np.searchsorted(ends, ends[at] + tokens, "right")) - 1)
        cls = flat[ends[at] : ends[z]]
        yield (cls, *_before(cls, ends[at : z + 1] - ends[at], start))
        at = z


def _shard_pass(now, shared_lex, seeds: tuple[int, ...]):
    """What a task does with a shard: passes from the common state, and its own state after them in fixed-point parts."""

    def run(table: pa.Table) -> pa.Table:
        own, sums = ({k: v.copy() for k, v in t.items()} for t in now.value)
        table = table.sort_by([("key", "ascending"), ("row", "ascending")])
        rng = np.random.default_rng([*seeds, table["shard"][0].as_py()])
        for _ in range(PASSES):
            train_part(own, sums, shared_lex.value, _blocks(table["cls"].combine_chunks(), len(own["q"])), rng)
        flat = np.rint(_flat(own, sums).astype(np.float64) * UNIT).astype(np.int64)
        parts = [flat[i : i + 4096] for i in range(0, len(flat), 4096)]
        slot = pa.array([table["shard"][0].as_py()] * len(parts), pa.int64())
        return pa.table({"part": pa.array(range(len(parts)), pa.int32()), "slot": slot, "n": pa.array([1] * len(parts), pa.int64()), "x": pa.array(parts, pa.list_(pa.int64()))})

    return run


def _summed(states: DataFrame, shards: int) -> DataFrame:
    """(part, slot, n, x): the arrays x of each part summed over all shards, SUMMED at a time, as a tree."""

    def add(table: pa.Table) -> pa.Table:
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1).sum(0)
        return pa.table({"part": table["part"][:1], "slot": pa.array([table["slot"][0].as_py() // SUMMED], pa.int64()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "x": pa.array([x], pa.list_(pa.int64()))})

    while True:
        states = states.groupBy("part", F.floor(F.col("slot") / SUMMED).alias("of")).applyInArrow(add, states.schema)
        shards = -(-shards // SUMMED)
        if shards <= 1:
            return states
        states = saved(states, "states")


def train(coded: DataFrame, lex: Lexicon, rounds: int = ROUNDS, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters from the training rows of coded(key, row, held_out, cls). Each text is in one shard of one round.

    A shard holds about SHARD tokens however many there are; equal rows, which have one key, are dealt by their number.
    """
    spark = coded.sparkSession
    p = initial(lex, seed)
    seen = {k: np.full_like(v, 1.0) for k, v in p.items()}
    shared_lex = spark.sparkContext.broadcast(lex)
    rows = coded.where("not held_out")
    each = max(1, round(lex.n / (SHARD * rounds)))
    often = saved(rows.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("often")), "often")
    rows = rows.join(sized_broadcast(often, often.count(), HELD), "key", "left")
    slot = F.pmod(F.when(F.col("often"), F.xxhash64("key", "row")).otherwise(F.col("key")), F.lit(each * rounds))
    rows = rows.select("key", "row", "cls", (slot % rounds).alias("turn"), F.floor(slot / rounds).alias("shard"))
    for turn in range(rounds):
        now = spark.sparkContext.broadcast((p, seen))
        got = rows.where(F.col("turn") == turn).groupBy("shard").applyInArrow(_shard_pass(now, shared_lex, (seed, turn)), "part int, slot long, n long, x array<long>")
        total = _summed(got, each).toArrow().sort_by("part")
        if len(total):
            p, seen = _shaped(total["x"].combine_chunks().flatten().to_numpy() / (total["n"][0].as_py() * UNIT), p, seen)
    return p


def context_sums(p, block: int = 512) -> np.ndarray:
    """log of the sum over all classes of the exponential of their score, by class one and class two before.

    A class's exponential is the product of a number of the one and a number of the other, so the sums of all contexts are
    one product of two matrices, here gathered over blocks of classes. A sum too small for single precision is NaN.
    """
    m, q, b = len(p["q"]), p["q"], p["b"]
    top1, top2 = np.full(m + 1, -np.inf, np.float32), np.full(m + 1, -np.inf, np.float32)
    for lo in range(0, m, block):
        part = q[lo : lo + block].T
        np.maximum(top1, (p["r1"] @ part).max(1), out=top1)
        np.maximum(top2, (p["r2"] @ part + b[lo : lo + block]).max(1), out=top2)
    sums = np.zeros((m + 1, m + 1), np.float32)
    for lo in range(0, m, block):
        part = q[lo : lo + block].T
        one = np.exp(p["r1"] @ part - top1[:, None])
        two = np.exp(p["r2"] @ part + b[lo : lo + block] - top2[:, None])
        for at in range(0, m + 1, 1024):
            sums[at : at + 1024] += one[at : at + 1024] @ two.T
    sums[sums < 1e-30] = np.nan
    np.log(sums, out=sums)
    sums += top1[:, None]
    sums += top2
    return sums


def _context_sums(p, one, two, block: int = 2048) -> np.ndarray:
    """The same for single contexts, a score a class."""
    fresh = np.empty(len(one))
    for lo in range(0, len(one), block):
        s = (p["r1"][one[lo : lo + block]] + p["r2"][two[lo : lo + block]]) @ p["q"].T + p["b"]
        top = s.max(1)
        fresh[lo : lo + block] = np.log(np.exp(s - top[:, None]).sum(1, dtype=np.float64)) + top
    return fresh


def class_scores(p, cls, one, two, cache: dict | None = None):
    """Normalised log probability of each token's class.

    cache keeps the sums of contexts for further calls: a table of all of them, or where classes are too many those seen so far.
    """
    m = len(p["q"])
    cache = {} if cache is None else cache
    if m <= TABLED:
        if "sums" not in cache:
            cache["sums"] = context_sums(p)
        norm = cache["sums"][one, two].astype(np.float64)
        small = np.flatnonzero(np.isnan(norm))
        norm[small] = _context_sums(p, one[small], two[small])
    else:
        known = cache.get("keys", np.zeros(0, np.int64))
        if len(known) > CONTEXTS:
            cache.clear()
            known = np.zeros(0, np.int64)
        key, where = np.unique(one * (m + 1) + two, return_inverse=True)
        at = np.searchsorted(known, key)
        new = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != key) if len(known) else np.arange(len(key))
        cache["sums"] = np.insert(cache.get("sums", np.zeros(0)), at[new], _context_sums(p, key[new] // (m + 1), key[new] % (m + 1)))
        cache["keys"] = known = np.insert(known, at[new], key[new])
        norm = cache["sums"][np.searchsorted(known, key)][where]
    dot = np.empty(len(cls), np.float64)
    for lo in range(0, len(cls), 1 << 16):
        sl = slice(lo, lo + (1 << 16))
        dot[sl] = np.einsum("ij,ij->i", p["r1"][one[sl]] + p["r2"][two[sl]], p["q"][cls[sl]])
    return dot + p["b"][cls] - norm


def coded(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """A row a document: the classes of its tokens, what is known of them without a model, and the list of words that the tasks do not hold."""
    shared_lex = rows.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        lex = shared_lex.value
        for batch in batches:
            for lo, hi, hashes, rare, bounds in _tokens(batch.column(3)):
                count, cls = lex.find(hashes, rare)
                base = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0)
                inner = np.where((cls < RARE) & (count >= 0), base, 0.0)
                spread = np.log10(lex.rare_n + lex.rare_v + 1)
                inner -= np.where(cls < RARE, spread[np.minimum(cls, RARE - 1)], 0)
                out = (cls < RARE) & (count < 0)
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds))[out]
                order = np.lexsort((hashes[out], doc))
                d, h = doc[order], hashes[out][order]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])) if len(d) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(d)))
                per = np.searchsorted(d[first], np.arange(hi - lo + 1)) if len(d) else np.zeros(hi - lo + 1, np.int64)
                lists = lambda ends, x: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x))
                known, sums, inside = (np.array([x[bounds[i] : bounds[i + 1]].sum() for i in range(hi - lo)]) for x in ((count >= 0).astype(np.int64), base, inner))
                kept = [c.slice(lo, hi - lo) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(bounds)), pa.array(known), pa.array(sums), pa.array(inside), lists(per, h[first].view(np.int64)), lists(per, times.astype(np.int64)), lists(bounds, cls.astype(np.int32))], [*batch.schema.names[:3], "n_tokens", "known", "base", "inner", "h", "times", "cls"])

    keyed = rows.select("doc_id", "held_out", F.xxhash64("doc_id", "text", F.length("text")).alias("key"), "text")
    return keyed.mapInArrow(run, "doc_id long, held_out boolean, key long, n_tokens long, known long, base double, inner double, h array<long>, times array<long>, cls array<int>")


def scored(coded: DataFrame, p: dict[str, np.ndarray]) -> DataFrame:
    """coded with ``part``, the sum of the model's class scores, instead of its classes."""
    shared = coded.sparkSession.sparkContext.broadcast((p, {}))  # a worker's cache lives as long as what it is sent
    names = [c for c in coded.columns if c != "cls"]

    def run(batches):
        p, cache = shared.value
        start = len(p["q"])
        for batch in batches:
            sums = []
            lists = batch.column(len(names))
            lengths = lists.value_lengths().to_numpy()
            for cls, one, two in _blocks(lists, start):
                logp = class_scores(p, cls, one, two, cache=cache) / np.log(10)
                z = len(sums) + int(np.searchsorted(np.cumsum(lengths[len(sums) :]), len(cls))) + 1
                ends = np.concatenate([[0], np.cumsum(lengths[len(sums) : z])])
                sums += [logp[a:b].sum() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.float64())], [*names, "part"])

    fields = [coded.schema[c] for c in names]
    return coded.select(*names, "cls").mapInArrow(run, T.StructType([*fields, T.StructField("part", T.DoubleType())]))


def language_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs(doc_id, text, ...).

    A null or empty text is its end mark. A null doc_id is that of an empty id and comes back null; repeated rows are
    scored alike and each counts in training. Without training texts every token is unseen. An empty table gives
    an empty one; other columns are not read.
    """
    rows = split(docs)
    table = saved(counts(rows.where("not held_out")), "counts")
    lex = lexicon(table)
    codes = saved(coded(rows, lex).withColumn("row", F.monotonically_increasing_id()), "coded")
    p = train(codes, lex)
    marked = saved(scored(codes.drop("key"), p), "scored")
    rare = marked.select("row", F.explode(F.arrays_zip("h", "times")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.times").alias("times"))
    less = table.where(F.col("c") < (int(lex.count.min()) if len(lex.count) else 1 << 62)).select("h", "c")
    log = F.coalesce(F.log10(F.col("c") + F.lit(1.0)), F.lit(0.0)) * F.col("times")
    joined = rare.join(less, "h").groupBy("row").agg(F.sum(log).alias("logs"), F.sum("times").alias("n"))
    out = marked.drop("h", "times").join(joined, "row", "left")
    logs, whole = F.coalesce("logs", F.lit(0.0)), F.lit(float(np.log10(lex.n + lex.v + 1.0)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("n", F.lit(0))).alias("n_known"), F.lit(int(lex.n)).cast("long").alias("train_tokens"), (F.col("base") + logs - F.col("n_tokens") * whole).alias("base_score"), (F.col("part") + F.col("inner") + logs).alias("score"))


def op6_log_bilinear_scores(spark, sf_dir: str) -> DataFrame:
    """Every document's score under the model and under the unigram baseline."""
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
