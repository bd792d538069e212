"""The Merkle manifest, the filter audit and the multi-index against plain versions."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.llm import audit, merkle, multiindex

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """Root and, for each leaf, its siblings as (left, right) from its level up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            path.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subs.append((own, *plain_tree([leaf_of(r) for r in own])))
    root, ups = plain_tree([s[1] for s in subs])
    out = []
    for (own, sub, paths), up in zip(subs, ups, strict=True):
        for r, path in zip(own, paths, strict=True):
            acc = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                acc = (*r[:4], r[4].replace("\n", ""))
            acc = leaf_of(acc)
            for left, right in path + up:
                acc = h(left, acc, right)
            out.append((r[0], leaf_of(r), sub, root, h(*(a + b for a, b in path + up)), acc, acc == root))
    return out


def shown(rows):
    return sorted(repr(tuple(r)) for r in rows)


def manifest(df, levels):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(df, (changed, F.replace(F.col("text"), F.lit("\n"), F.lit(""))), levels).collect()


@pytest.mark.parametrize("levels", [1, 6])
def test_manifest_is_that_of_the_plain_tree(spark, levels):
    rnd = random.Random(levels)
    rows = [(i, "hot" if i % 3 else rnd.choice(["a", "ä", "", "z"]), rnd.choice(["en", None]), i, rnd.choice(["x\ny", "plain", "", None, "é\n" * 40])) for i in range(100)]
    rows += [(None, None, None, None, None), (None, "hot", "en", 1, "a\nb"), (5, "hot", "en", 7, "other"), (5, "hot", "en", 7, "other"), (7, "one", "en", 3, "lone\n")]
    got = manifest(spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit("x"), "mk_key": F.lit(1)}), levels)
    want = plain_manifest(rows)
    # equal rows stand in any order, but each has a place of its own
    assert shown(got) == shown(want)


def test_manifest_of_runs_that_end_with_one_and_of_nothing(spark):
    for n in (1, 28):
        rows = [(i, "s", "en", 1, f"t{i}\n") for i in range(n)]
        assert shown(manifest(spark.createDataFrame(rows, DOCS), 1)) == shown(plain_manifest(rows))
    assert manifest(spark.createDataFrame([], DOCS), 2) == []


def test_a_very_long_text_has_a_leaf(spark):
    rows = [(1, "s", "en", 0, "wörd \n" * 300_000), (2, "s", "en", 0, "")]
    assert shown(manifest(spark.createDataFrame(rows, DOCS), 6)) == shown(plain_manifest(rows))


def plain_audit(docs, labels):
    import re

    fails, least = [], {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, x in labels if x == 1 and d is not None}
    for d, lang, text in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > least[t]]
        fails.append((lang or "", {x for x, y in zip("ABCDE", own, strict=True) if y}, d in good, d in bad))
    out = []
    for part in {f[0] for f in fails}:
        own, rows = [f for f in fails if f[0] == part], []
        for order in permutations("ABCDE"):
            for i, x in enumerate(order):
                before = set(order[:i])
                here = [f for f in own if x in f[1] and not f[1] & before]
                rows.append([part, "".join(order), i + 1, sum(not f[1] & {*before, x} for f in own), len(here), sum(x in f[1] and bool(f[1] & before) for f in own), sum(f[1] == {x} for f in own), sum(f[2] for f in here), sum(f[3] for f in here)])
        out += [(*r, sum(s[4] for s in rows if s[1][s[2] - 1] == r[1][r[2] - 1])) for r in rows]
    return out


LABELS = "doc_id long, quality int, toxic int"


def audited(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumns({"mask": F.lit("x"), "size": F.lit(0), "part": F.lit(3)})
    return audit.interaction(audit.masks(df, spark.createDataFrame(labels, LABELS))).collect()


def test_audit_is_that_of_all_orders_one_by_one(spark):
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "DELTA", "e", "x#y", "ß", " ", "\U0001f600"]
    base = [" ".join(rnd.choice(words[:k]) + str(rnd.randrange(200)) * (rnd.random() < p) for _ in range(rnd.choice([0, 3, 99, 100, 101, 150]))) for k in (1, 5, 6, 9) for p in (0, 0.9, 1) for _ in range(4)]
    long = "word " * 4_000
    base += [long, long + "x", long[:-1] + "y", "", "\n", None, "A" * 10 + "b" * 90, "A" * 11 + "b" * 89]
    docs = [(rnd.choice([None, *range(40)]) if i % 9 == 0 else i, rnd.choice(["en", "de", None, ""]), rnd.choice(base)) for i in range(400)]
    docs += docs[:5] + [(500 + i, "en", "the same text") for i in range(60)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 500, 2)] + [(4, 1, 1), (None, 1, 1)]
    assert shown(audited(spark, docs, labels)) == shown(plain_audit(docs, labels))


def test_audit_of_nothing_and_without_labels(spark):
    assert audited(spark, [], []) == []
    docs = [(1, "en", "a b"), (2, "en", "a b"), (None, "en", "a b")]
    assert shown(audited(spark, docs, [])) == shown(plain_audit(docs, []))


def test_texts_of_equal_hashes_are_told_apart(spark, monkeypatch):
    """With hashes that all agree, only lengths and full texts tell texts apart; a class may have several texts."""
    monkeypatch.setattr(audit, "block_hashes", lambda text, size: F.array(F.lit(1).cast("long")))
    monkeypatch.setattr(audit, "GROUP", 3)
    docs = [(i, "en", ["aa", "bb", "cc", "longer"][i * 7 % 4]) for i in range(40)] + [(0, "en", "bb")]
    assert shown(audited(spark, docs, [])) == shown(plain_audit(docs, []))


def test_refinement_drops_who_is_alone(spark):
    text = "same beginning " * 200
    docs = spark.createDataFrame([(1, "en", text + "a"), (2, "en", text + "b"), (3, "en", text + "a"), (4, "en", "short")], "doc_id long, lang string, text string")
    rows = audit.measured(docs)
    rows = rows.select("doc_id", "size", audit.block_hashes(F.col("text"), F.col("size")).alias("hashes"))
    assert [(r["lo"], r["many"]) for r in audit.refined(rows).collect()] == [(1, 2)]


VECTORS = "vec_id long, embedding array<float>"


def plain_neighbours(rows, asks, k):
    import math

    fine = [(v, e) for v, e in rows if e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    lengths = [len(e) for _, e in fine]
    common = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    fine = [(v, np.array(e, np.float32).astype(float)) for v, e in fine if len(e) == common]
    out = []
    for i, (v, e) in enumerate(fine):
        if v is not None and asks(v):
            near = sorted((float(np.sqrt(np.cumsum((e - o) ** 2)[-1])), w is None, w if w is not None else 0) for j, (w, o) in enumerate(fine) if j != i)[:k]
            out += [(v, r + 1, None if none else w, d) for r, (d, none, w) in enumerate(near)]
    return out


def test_search_through_a_small_table_is_exact(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    same = [0.5] * 6
    rows += [(1000 + i, same) for i in range(60)] + [(20, same), (20, same), (None, same), (None, rows[0][1])]
    rows += [(50, None), (60, []), (70, [0.0] * 6), (80, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (90, [float("nan")] * 6), (10, [float("inf")] * 6), (30, [1.0, 2.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"uid": F.lit(1), "cell": F.lit("x"), "vector": F.lit(2)})
    got = multiindex.neighbours(df, F.col("vec_id") % 10 == 0).collect()
    assert shown(got) == shown(plain_neighbours(rows, lambda v: v % 10 == 0, 10))


def test_search_of_nothing_and_of_few(spark):
    assert multiindex.neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).collect() == []
    rows = [(0, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0, 2.5])]
    assert shown(multiindex.neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0).collect()) == shown(plain_neighbours(rows, lambda v: v == 0, 10))
    assert multiindex.neighbours(spark.createDataFrame(rows[:1], VECTORS), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_beyond_what_is_looked_through_whole(spark, monkeypatch, clusters):
    monkeypatch.setattr(multiindex, "BLOCK", 50)
    monkeypatch.setattr(multiindex, "GROUP", 20)
    monkeypatch.setattr(multiindex, "HELD", 30)
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(max(1, clusters), 16)) * (3 if clusters else 0)
    x = (centres[rng.integers(len(centres), size=6000)] + rng.normal(size=(6000, 16)) * 0.5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(6000 + i, x[0].tolist()) for i in range(2000)]
    depth = []
    whole = multiindex.depth_of
    monkeypatch.setattr(multiindex, "depth_of", lambda *a: depth.append(whole(*a)) or depth[-1])
    monkeypatch.setattr(multiindex, "LEAST", 300)
    got = multiindex.neighbours(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0).collect()
    want = plain_neighbours(rows, lambda v: v % 50 == 0, 10)
    assert len(got) == len(want)
    assert len({tuple(r) for r in got} & set(want)) >= 0.9 * len(want)
    assert depth[0] < 6001 * (0.2 if clusters else 0.95)


def test_traversal_meets_all_pairs_in_order():
    rng = np.random.default_rng(1)
    for a, b in ((1, 1), (1, 7), (6, 5)):
        one, two = rng.integers(0, 5, a).astype(float), rng.random(b)
        pairs = list(multiindex.traversal(one, two))
        sums = [one[i] + two[j] for i, j in pairs]
        assert len(set(pairs)) == a * b == len(pairs) and sums == sorted(sums)
