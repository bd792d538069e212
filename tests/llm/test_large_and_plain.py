"""Scores, templates, votes and long texts against plain versions; large groups and hostile pages."""

import collections
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lethe.llm import html, lm, media, neardup, packing, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_scores_by_plain_code(spark, monkeypatch):
    """Every document's score from the trained parameters, token by token."""
    monkeypatch.setattr(lm, "OWN", 8)
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda codes, lex: kept.update(lex=lex, p=train(codes, lex)) or kept["p"])
    rng = random.Random(8)
    words = [f"{rng.choice('abc')}w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randint(0, 30)))) for i in range(80)] + [(900, None), (901, "Unseen Aw0 é"), (902, "x " * 3000)]
    got = {r["doc_id"]: r["score"] for r in lm.language_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    lex, p = kept["lex"], {k: v.astype(float) for k, v in kept["p"].items()}
    known = dict(zip(lex.hashes.tolist(), zip(lex.count.tolist(), lex.cls.tolist(), strict=True), strict=True))
    tokens = lambda t: [w.encode() for w in WORD.findall((t or "").translate(LOWER))]
    assert lex.n == sum(len(tokens(t)) + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)
    start = len(p["q"])

    def classes(text):
        out = []
        for w in [*tokens(text), None]:
            h = int(lm.END) if w is None else int(_hash(w))
            if h in known:
                out.append(known[h])
            else:
                last, prev = w[-1], w[-2] if len(w) > 1 else 0
                out.append((None, int(lm.hashing.mix(np.array([last << 8 | prev], np.uint64))[0] % lm.RARE)))
        return out

    table = {}

    def _hash(word):
        if word not in table:
            table[word] = next(lm.hashing.words(pa.array([word.decode()])))[5][0]
        return table[word]

    for i, text in rows:
        total, one, two = 0.0, start, start
        for count, cls in classes(text):
            scores = (p["r1"][one] + p["r2"][two]) @ p["q"].T + p["b"]
            top = scores.max()
            total += (scores[cls] - top - math.log(np.exp(scores - top).sum())) / math.log(10)
            if cls < lm.RARE:
                total += math.log10(((count or 0) + 1) / (lex.rare_n[cls] + lex.rare_v[cls] + 1))
            one, two = cls, one
        assert abs(total - got[i]) < 1e-5 * max(10, abs(total)), (i, total, got[i])


def test_sums_of_all_contexts_are_those_of_single_ones(monkeypatch):
    rng = np.random.default_rng(2)
    m = 70
    for size in (0.3, 5.0):  # with large ones many products are too small for single precision
        p = {k: (rng.standard_normal((m + (k != "q"), 4)) * size).astype(np.float32) for k in ("r1", "r2", "q")} | {"b": rng.standard_normal(m).astype(np.float32)}
        cls, one, two = (rng.integers(0, n, 500) for n in (m, m + 1, m + 1))
        table = lm.class_scores(p, cls, one, two)
        monkeypatch.setattr(lm, "TABLED", 0)
        cache = {}
        each = np.concatenate([lm.class_scores(p, cls[s], one[s], two[s], cache) for s in (slice(0, 250), slice(250, 500))])
        monkeypatch.undo()
        assert np.allclose(table, each, rtol=1e-5, atol=2e-3)


def test_shared_passages_link_nobody_else(spark, monkeypatch):
    """Long lists of documents of many sizes that share passages, with copies among them, in cells of a few."""
    monkeypatch.setattr(neardup, "SMALL_LIST", 3)
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 5)
    rng = random.Random(11)
    shared = [" ".join(f"p{n}x{i}" for i in range(40)) for n in range(3)]
    rows = []
    for i in range(90):
        own = [f"d{i}w{j}" for j in range(rng.choice([3, 9, 20, 45, 90, 130]))]
        text = " ".join([*own[: len(own) // 2], *rng.sample(shared, rng.randint(1, 3)), *own[len(own) // 2 :]])
        rows.append((i, text))
        if i % 4 == 0:
            edited = text.split()
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = "edited"
            rows.append((1000 + i, " ".join(edited)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in sets}


def test_blocks_of_neighbouring_bands_meet_once(spark):
    rows = [(1, band, block, blocks, 100 * band + block) for band, blocks in ((3, 2), (4, 3), (6, 1)) for block in range(blocks)]
    cells = neardup._cells(spark.createDataFrame(rows, "g long, band int, block int, blocks int, rep long")).collect()
    met = collections.defaultdict(list)
    for c in cells:
        met[c["lo"], c["i"], c["hi"], c["j"]].append((c["rep"], c["side"]))
    want = {}
    for _, a, i, _, r in rows:
        for _, b, j, _, s in rows:
            if (a, i) <= (b, j) and b - a <= 1:
                want[a, i, b, j] = [(r, 2)] if r == s else [(r, 0), (s, 1)]
    assert {k: sorted(v) for k, v in met.items()} == want


@pytest.mark.parametrize("bad", ["<a ", "<!-- ", '<a href="', "<a b=\" c=' ", "<script>", "</a ", "<p><b "])
@pytest.mark.parametrize("end", ["", ">", '">'])
def test_hostile_pages_take_no_longer_than_their_length(bad, end):
    began = time.process_time()
    page = html.Page("<p>kept</p>" + bad * (1_000_000 // len(bad)) + end)
    assert time.process_time() - began < 5 and page.blocks[0][0] == "kept"


def test_what_closes_is_not_cut():
    for fine in ("", "a < b", "<p>x</p>", "<a href='x>y' b=\"<\">z</a> <", "<!-- <a > --><p>", "<script>if (a<b) '<a '</script><p>x", "<style><a href=\"</style>x", "<TITLE>a < b</Title>", "<br/>", "<scripty>x", "<iframe/>x"):
        assert html.closed(fine) == fine
    assert html.closed("<p>x<a href='y>z") == "<p>x" and html.closed("x<!-- y") == "x" and html.closed("<script>x") == ""


def test_templates_by_plain_counting(spark):
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(n))
    parts = [f"<div>{words(5)}</div>" for _ in range(4)] + [f"<section><p>{words(3)}</p><p>{words(3)}</p></section>" for _ in range(3)]
    rows = []
    for i in range(150):
        inside = "".join(f"<p>{words(6)}</p>" for _ in range(rng.randint(1, 3))) + rng.choice(parts)
        body = f"<article>{inside}</article>" if i % 3 else f"<div>{inside}</div>"
        rows.append((i, f"http://h{i % 4}.org/{i}", "<html><body>" + "".join(rng.sample(parts, rng.randint(0, 4))) + body + "</body></html>"))
    rows += [(500 + i, f"http://h0.org/again{i}", rows[0][2]) for i in range(5)] + [(600, None, None), (601, "x", "")]
    pages = {i: html.Page(t or "") for i, _, t in rows}
    host = {i: re.sub(r"^\w+://([^/]*).*", r"\1", u) if u and "://" in u else "" for i, u, _ in rows}
    articles, seen = collections.defaultdict(set), collections.defaultdict(set)
    trees = {}
    for i, page in pages.items():
        articles[host[i]].add(page.article())
        main = [m for _, _, m in page.blocks]
        trees[i] = [(d, m, a, z) for d, m, a, z in page.trees if m or not any(main[a:z])]
        for d, m, _, _ in trees[i]:
            seen[host[i], d, m].add(page.article())
    bound = {True: (html.INNER_PAGES, html.INNER_SHARE), False: (html.LEAST_PAGES, html.LEAST_SHARE)}
    often = {k for k, v in seen.items() if len(v) >= bound[k[2]][0] and len(v) >= bound[k[2]][1] * len(articles[k[0]])}
    assert often
    want = {}
    for i, page in pages.items():
        gone = {b for d, m, a, z in trees[i] if (host[i], d, m) in often for b in range(a, z)}
        left = [(t, m) for b, (t, said, m) in enumerate(page.blocks) if b not in gone and not said]
        want[i] = "\n\n".join(t for t, m in left if m or not any(x for _, _, x in page.blocks))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for held in (html.HELD_TEMPLATES, 0):
        assert {r["page_id"]: r["text"] for r in html.main_text(df, held=held).collect()} == want


def plain_consensus(one, two):
    best = 0
    spots = [tuple(np.rint(o[:2] / 2)) for o in one]
    for o, t in zip(one, two, strict=True):
        turn, scale = t[3] - o[3], t[2] / o[2]
        agree = set()
        for p, q, spot in zip(one, two, spots, strict=True):
            dx, dy = p[0] - o[0], p[1] - o[1]
            x, y = scale * (math.cos(turn) * dx - math.sin(turn) * dy), scale * (math.sin(turn) * dx + math.cos(turn) * dy)
            wide = abs((q[3] - p[3] - turn + math.pi) % (2 * math.pi) - math.pi)
            if math.hypot(x + t[0] - q[0], y + t[1] - q[1]) <= media.PIXELS * max(1, t[2]) and wide <= media.TURN and abs(math.log(q[2] / p[2] / scale)) <= media.SCALING:
                agree.add(spot)
        best = max(best, len(agree))
    return best


def _votes(rng, n, good, size=400):
    one, two = (np.c_[rng.random((n, 2)) * size, 1.25 ** rng.integers(0, 6, n), rng.random(n) * 6.28] for _ in "ab")
    turn, scale, k = rng.random() * 6.28, math.exp(rng.normal() * 0.3), int(n * good)
    at = one[:k, 0] + 1j * one[:k, 1]
    to = at * scale * np.exp(1j * turn) + rng.normal(size=k) + 1j * rng.normal(size=k) + 50
    two[:k] = np.c_[to.real, to.imag, one[:k, 2] * scale, one[:k, 3] + turn + rng.normal(size=k) * 0.05]
    return one, two


def test_consensus_is_that_of_all_votes_against_all():
    rng = np.random.default_rng(3)
    for n in (1, 2, 6, 25, 60):
        for good in (0, 0.3, 0.9):
            one, two = _votes(rng, n, good)
            assert media.consensus(one, two) == plain_consensus(one, two)


def test_consensus_of_large_copies_is_quick():
    one, two = _votes(np.random.default_rng(4), 30_000, 0.95, 3000)
    began = time.process_time()
    assert media.consensus(one, two) > 14_000 and time.process_time() - began < 5


def test_pieces_of_very_long_texts(spark):
    rng = random.Random(13)
    texts = ["".join(f"w{i}" + rng.choice([" ", "\n", "\t ", "  "]) for i in range(n)) for n in (0, 1, 15, 16, 17, 33, 30_000)] + [None, " lead w1", "a" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in packing.pieces(df, 16, ("text",)).orderBy("doc_id", "piece").collect():
        assert r["start"] == 16 * r["piece"] and r["n_tokens"] <= 16
        got[r["doc_id"]].append((r["n_tokens"], r["text"]))
    for i, text in enumerate(texts):
        words = len(WORD.findall(text or ""))
        assert sum(n for n, _ in got[i]) == words + 1 and "".join(t for _, t in got[i]) == (text or "")
        assert all(len(WORD.findall(t)) == n for n, t in got[i][:-1])
    assert packing.pieces(df, 16).count() == packing.pieces(df, 16, ("text",)).count()


def test_planted_terms_disclose_and_no_others_do(spark):
    """Code words that stand beside an address in three to eight texts, in a whole table of other documents."""
    rng = random.Random(14)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = sorted({w.lower() for r in docs.limit(300).collect() for w in re.findall(r"[A-Za-z]{3,}", r["text"])})
    planted = []
    for e in range(25):
        for c in range(3 + e % 6):
            text = rng.choices(words, k=80)
            text[rng.randrange(40)], text[40 + rng.randrange(40)] = f"zqcode{e}", f"agent{chr(97 + e)}x@secret{e}.org"
            planted.append((1_000_000 + 100 * e + c, " ".join(text)))
    out = pii.found(docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))).select("doc_id", "pi_text", F.filter("pi_spans", lambda x: x["k"] == pii.KINDS.index("term")).alias("t"))
    hits = [(r["doc_id"], r["pi_text"][t["s"] : t["e"]].lower()) for r in out.collect() for t in r["t"]]
    right = [h for h in hits if h[0] >= 1_000_000 and h[1].startswith("zqcode")]
    assert len(right) >= 0.9 * len(planted) and len(hits) - len(right) <= 0.02 * len(planted)
