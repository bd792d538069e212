"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lethe.llm import fingerprint, lm, mixing, neardup, packing, pii, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest int, cut string, h long, row long"


def _docs(spark, rows):
    """rows of (doc_id, text[, lang, source]) with further columns whose names operators use inside."""
    full = [(*r, *("en", "src1")[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", 1, 2) for r in full], SCHEMA).repartition(3)


def _texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "de lta", "é", "die", "x1", "y", "the", "of", "and", "!!"]
    out = []
    for i in range(n):
        out.append(" ".join(rng.choices(words, k=rng.randint(0, 40))))
        if i % 7 == 3:
            out.append(out[-1])
        if i % 5 == 2 and len(out[-1].split()) > 12:
            w = out[-1].split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return [*out, "", None, "one", "word " * 3000, "\t\n ", "ONE"]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t) for i, t in enumerate(_texts())]
    return [*out, out[5], out[5], (out[6][0], "another text of the same document"), (None, "text without an id and with words"), (None, "text without an id and with words")]


def _components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.setdefault((i, t), {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = [k for k in sets if k[0] is not None and sets[k]]
    for a in keys:
        for b in keys:
            inter = len(sets[a] & sets[b])
            if a != b and 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    return {k: (len(v), find(k[0]) if k[0] is not None else None) for k, v in sets.items()}


def test_near_duplicates(spark, rows):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(_docs(spark, rows)).collect()), key=repr)
    want = _components(rows)
    full = sorted(((i, want[i, t][0], want[i, t][1], i == want[i, t][1]) for i, t in rows), key=repr)
    assert got == full
    assert neardup.near_duplicates(_docs(spark, [])).count() == 0


def test_near_duplicates_in_long_lists(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(80)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(_docs(spark, rows)).collect()}
    want = _components(rows)
    assert got == {i: want[i, t][1] for i, t in rows}


SHAPES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def test_near_duplicates_of_texts_and_their_beginnings(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        n = rng.randrange(65, 131)
        words = [f"t{i}w{j}" for j in range(n + 4)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: math.ceil(n * rng.uniform(0.75, 0.8)) + 4]))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(_docs(spark, rows)).collect()}
    want = _components(rows)
    assert got == {i: want[i, t][1] for i, t in rows} and set(got.values()) == set(range(0, 600, 2))


def _luhn(d):
    s = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in s) % 10 == 0


def _spans(text):
    out = []
    for k, (kind, shape) in enumerate(SHAPES):
        for m in re.finditer(shape, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "email") or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 12 <= len(d) <= 19 and _luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{SHAPES[k][0]}:{a}:{z}" for a, k, z in sorted(out))


def test_personal_data_spans(spark):
    rng = random.Random(7)
    bits = ["a", "b.c", "@", "x.org", ".", "1", "255", "256", "12.3", "4111 1111 1111 1111", "4111-1111", "+", "+1 (555) 123-4567", " ", "-", "_", "é", "😀", "(", "0001"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 14)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "1" * 30_000), (903, "a" * 30_000), (904, "a@" + "b." * 5_000), (905, "1 " * 20_000), (906, "1.1.1.1." * 500), (None, "x@y.org")]
    got = sorted((str(r["doc_id"]), r["s"]) for r in pii.found(_docs(spark, rows)).select("doc_id", pii.listed(F.col("pi_base")).alias("s")).collect())
    assert got == sorted((str(i), _spans(t)) for i, t in rows)


def _disclosing_rows():
    rng = random.Random(8)
    words = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    fill = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, f"{fill(9)} Zorblax {fill(5)} ann.{i}@quux.org {fill(6)} 10.2.{i}.7") for i in range(12)]
    rows += [(20 + i, f"Quantum {fill(12)} +44 20 7946 0{i:03d} {fill(3)}") for i in range(6)]
    rows += [(30 + i, "only copies tie Plonk to " + f"{fill(4)} bob@solo.net") for i in range(1)] * 9
    return rows + [(100 + i, fill(20)) for i in range(250)] + [(99, None), (98, ""), (None, "null@id.org Zorblax " + fill(4))]


def test_terms_that_disclose_an_entity(spark):
    rows = _disclosing_rows()
    out = {r["doc_id"]: r["text"] for r in pii.sanitised(_docs(spark, rows)).collect()}
    for i, t in rows[:12]:
        assert "@" not in out[i] and "Zorblax" not in out[i] and "[email]" in out[i] and "[ip]" in out[i]
        assert [w for w in out[i].split() if w[0] == "w"] == [w for w in t.split() if w[0] == "w"]
    assert all("Quantum" not in out[20 + i] and "[phone]" in out[20 + i] for i in range(6))
    assert out[30] == rows[18][1].replace("bob@solo.net", "[email]")  # nine copies are one observation
    assert out[150] == dict(rows[27:])[150] and out[99] is None and out[98] == ""
    assert pii.sanitised(_docs(spark, [])).count() == 0
    assert pii.sanitised(_docs(spark, rows)).columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def _disclosure(rows, generalise):
    """Strong (entity, term) pairs by plain counting."""

    def family(words):
        out = []
        for a, b in zip(words, [*words[1:], None], strict=True):
            h = xxhash.xxh64_intdigest(a.encode(), 42)
            h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
            out.append(h - (1 << 64) if h >> 63 else h)
        return min(out, default=0)

    docs, count = [], collections.Counter()
    for _, text in rows:
        text = text or ""
        words = lambda t: re.findall(r"[^\W_]+", t.lower())
        count.update({w for w in words(text) if not w.isdigit()})
        entities, outside, at = set(), [], 0
        for span in filter(None, _spans(text).split(",")):
            kind, a, z = span.split(":")
            a, z = int(a), int(z)
            v = text[a:z].lower()
            d = re.sub("[^0-9]", "", v)
            if kind == "email":
                holder = re.sub("[^a-z]", "", v.split("@")[0])
                entities |= {"email:" + v, "domain:" + v.split("@")[1]} | ({"holder:" + holder} if len(holder) > 1 else set())
            else:
                entities |= {"ip": {"ip:" + v, "network:" + v.rsplit(".", 1)[0]}, "card": {"card:" + d, "issuer:" + d[:6]}, "phone": {"phone:" + d, "prefix:" + d[:6]}}[kind]
            outside.append(text[at:a] if a > at else "")
            at = max(at, z)
        plain = " ".join([*outside, text[at:]])
        if entities:
            docs.append((family(words(plain)), entities, {w for w in words(plain) if not w.isdigit()}))
    n, out = len(rows), {}
    for e in {e for _, es, _ in docs for e in es}:
        own = [d for d in docs if e in d[1]]
        for t in {t for d in own for t in d[2]}:
            both = [d for d in own if t in d[2]]
            k = len({d[0] for d in both})
            share, whole = len(both) / count[t], len(own) / n
            if k < 2 or len({d[0] for d in own}) < 2 or share <= whole:
                continue
            size = k / share
            ln = lambda x: math.log(x) if x > 0 else 0.0
            ratio = k * math.log(share / whole) + (size - k) * (ln(1 - share) - ln(1 - whole))
            strength = math.log(share / whole) / -math.log(whole)
            if ratio >= math.log(len(count) / pii.ALPHA) and strength >= generalise:
                out[e, t] = round(strength, 9)
    return out


def test_disclosure_against_plain_counting(spark):
    rows = _disclosing_rows()
    want = _disclosure(rows, pii.GENERALISE)
    docs = _docs(spark, rows)
    held = pii.found(docs).where("pi_terms is not null").select("doc_id", "pi_terms", pii.listed(F.col("pi_spans")).alias("s")).collect()
    assert {("domain:quux.org", "zorblax"), ("prefix:442079", "quantum")} <= set(want) and len(held) >= 18
    by_term = collections.defaultdict(float)
    for (_, t), x in want.items():
        by_term[t] = max(by_term[t], x)
    for r in held:
        text = dict(rows)[r["doc_id"]]
        assert {t: round(x, 9) for t, x in r["pi_terms"].items()} == {t: x for t, x in by_term.items() if t in re.findall(r"[^\W_]+", text.lower())}
        assert [x for x in r["s"].split(",") if not x.startswith("term")] == _spans(text).split(",")
        assert {text[int(x.split(":")[1]) : int(x.split(":")[2])].lower() for x in r["s"].split(",") if x.startswith("term")} == set(r["pi_terms"])


def test_fingerprints(spark, rows):
    docs = [r for r in rows if r[0] is not None][:40] + [(1000, None), (1001, "a B a b"), (1001, "a B a b")]
    texts, ids = fingerprint.edited(_docs(spark, docs))
    order = sorted(set((i, t or "") for i, t in docs), key=lambda x: -x[0])
    ranks = {r["doc_id"]: (r["r"], r["times"]) for r in ids.collect()}
    assert sorted(r for r, _ in ranks.values()) == sorted({r for r, _ in ranks.values()}) and ranks[1001][1] == 2
    got = {(r["text"], r["new"]) for r in texts.collect()}
    by_rank = [r["doc_id"] for r in ids.orderBy("r").collect()]
    assert by_rank == sorted(by_rank, reverse=True) and len(by_rank) == len(order)
    once = {i: t for i, t in order if sum(1 for j, _ in order if j == i) == 1}
    for a, b in zip(by_rank, by_rank[1:], strict=False):
        if a in once and b in once:
            n = len(once[a])
            assert (once[a], once[a][: n - n // 2] + once[b][: n // 2]) in got
    signs = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(_docs(spark, [(1, "x y"), (2, "Y  x"), (3, None), (4, " "), (5, "x y y")])).collect()}
    assert signs[1] == signs[2] != signs[5] and signs[3] == signs[4]


def test_fingerprint_likeness_is_generalised_jaccard(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(12)], k=40))) for i in range(30)]
    got = {r["doc_id"]: r["sketch"] for r in fingerprint.fingerprints(_docs(spark, rows), 128).collect()}
    errors = []
    for i in range(29):
        a, b = (collections.Counter(rows[j][1].split()) for j in (i, i + 1))
        true = sum((a & b).values()) / sum((a | b).values())
        errors.append(np.mean(np.array(got[i]) == np.array(got[i + 1])) - true)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_shards(spark, rows):
    hot = rows + [(3000 + i, "hot " * 40) for i in range(80)] + [(4000 + i, f"same size {i % 10}") for i in range(60)]
    for rows in (rows, hot):
        got = sharding.sharded(_docs(spark, rows), 5).collect()
        assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 16 for _, t in rows)
        assert sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
        slots = collections.defaultdict(list)
        where = collections.defaultdict(set)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            where[r["text_crc32"]].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert sharding.sharded(_docs(spark, []), 5).count() == 0
    fixed = sharding.sharded(_docs(spark, rows), None, 3000).groupBy("shard").agg(F.sum("size").alias("s"), F.countDistinct("text_crc32").alias("n")).collect()
    assert all(r["s"] <= 3000 or r["n"] == 1 for r in fixed)
    groups = collections.Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 16
    assert sorted(r["s"] for r in fixed) == sorted(map(sum, _plain_bins(list(groups.values()), 3000)))


def _plain_bins(sizes, capacity):
    """Contents of the bins of best-fit-decreasing, by looking at every bin for every item."""
    free, bins = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(f, b) for b, f in enumerate(free) if f >= s]
        b = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(max(capacity, s))
            bins.append([])
        free[b] -= s
        bins[b].append(s)
    return bins


def _bins(runs):
    out = collections.defaultdict(list)
    for size, b, n in runs:
        out[b] += [size] * n
    return list(out.values())


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(4)
    for _ in range(80):
        sizes, capacity = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))], rng.randint(10, 60)
        items = sorted(collections.Counter(sizes).items(), reverse=True)
        runs, n = sharding.best_fit_decreasing(items, capacity)
        assert n == len(_bins(runs)) and sorted(map(sorted, _bins(runs))) == sorted(map(sorted, _plain_bins(sizes, capacity)))
        shards = rng.randint(1, 7)
        even = _bins(sharding.into(items, shards))
        assert len(even) <= shards and sorted(sum(even, [])) == sorted(sizes)
        if sizes and max(sizes) * shards <= sum(sizes):
            least = next(c for c in range(max(sizes), sum(sizes) + 1) if len(_plain_bins(sizes, c)) <= shards)
            assert max(map(sum, even)) <= 2 * least
    assert sorted(map(sum, _bins(sharding.into([(100, 1), (1, 30)], 4)))) == [10, 10, 10, 100]


def test_packing(spark, rows):
    got = packing.pack(_docs(spark, rows), (16, 64, 256), carry=("text",)).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for own in bins.values():
        total = sum(r["n_tokens"] for r in own)
        assert total == own[0]["bin_tokens"] <= own[0]["bin_length"] and own[0]["bin_length"] == min(c for c in (16, 64, 256) if c >= total)
        at = 0
        for r in sorted(own, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
    words = lambda t: len(WORD.findall(t or ""))
    assert sum(r["n_tokens"] for r in got) == sum(words(t) + 1 for _, t in rows)
    long = sorted((r["piece"], r["text"]) for r in got if r["text"] and r["doc_id"] is not None and dict(rows[:-5])[r["doc_id"]] == "word " * 3000)
    assert "".join(t for _, t in long) == "word " * 3000
    assert packing.pack(_docs(spark, [])).count() == 0


def test_packing_takes_the_cheapest_floor():
    sizes = [5, 5, 5, 5]
    assert packing.best_fit(sizes, (5, 20), (1.0, 20.0))[1] == [5] * 4
    assert packing.best_fit(sizes, (5, 20), (10.0, 20.0))[1] == [20]
    assert packing.best_fit([3], (4, 8), (9.0, 2.0))[1] == [8]


def _plain_best_fit(sizes, capacities, costs):
    """Total cost of the cheapest packing over the opening floors, by looking at every bin for every piece."""
    price = dict(zip(capacities, costs, strict=True))
    cheapest = lambda n: min((price[c], c) for c in capacities if c >= n)[1]
    totals = []
    for floor in capacities:
        bins = []
        for s in sorted(sizes, reverse=True):
            fits = [b for b in bins if b[0] >= s]
            b = min(fits, key=lambda b: b[0]) if fits else [cheapest(max(s, floor)), 0]
            if not fits:
                bins.append(b)
            b[0] -= s
            b[1] += s
        totals.append(sum(price[cheapest(b[1])] for b in bins))
    return min(totals)


def test_packing_against_a_plain_search():
    rng = random.Random(12)
    for _ in range(100):
        capacities = tuple(sorted(rng.sample(range(8, 80), 3)))
        costs = tuple(float(rng.randint(1, 90)) for _ in capacities)
        sizes = [rng.randint(1, capacities[-1]) for _ in range(rng.randint(1, 50))]
        bins, lengths = packing.best_fit(sizes, capacities, costs)
        held = collections.Counter()
        for b, s in zip(bins, sizes, strict=True):
            held[b] += s
        assert all(held[b] <= lengths[b] for b in held) and len(held) == len(lengths)
        assert sum(costs[capacities.index(c)] for c in lengths) == _plain_best_fit(sizes, capacities, costs)


def test_packing_splits_repeated_rows(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("three words here").alias("text"))
    got = packing.pack(docs, (16, 64)).groupBy(F.shiftright("bin_id", 20).alias("g")).count().collect()
    assert len(got) == 3 and max(r["count"] for r in got) < 1400 and sum(r["count"] for r in got) == 3000


def test_mixing_budgets(spark):
    weights = (F.when(F.col("mx_domain") == "a", 3).otherwise(1), F.lit(1), F.lit(1))
    docs = [(i, "t " * 10, "en", "a1") for i in range(4)] + [(10 + i, "t " * 10, "de", "a2") for i in range(20)] + [(50 + i, "t " * 10, None, None) for i in range(30)] + [(99, None, "en", "a1"), (98, "", "en", "b")]
    domain = F.when(F.col("source").startswith("a"), "a").otherwise("b")
    rows = mixing.decided(_docs(spark, docs), domain, weights, 240, 1, 3)
    taken = rows.groupBy("mx_domain", "mx_lang").agg(F.sum(F.col("mx_full") * F.col("mx_tokens") + F.col("mx_prefix")).alias("n"))
    got = {(r["mx_domain"], r["mx_lang"]): r["n"] for r in taken.collect()}
    # a should give 180: en has 40, so its sibling de makes up the shortage; b gives 60
    assert got[("a", "en")] == 40 and got[("a", "de")] == 140 and got[("b", "none")] == 60
    out = mixing.mixed(_docs(spark, docs), domain, weights, 235, 1, 3)
    assert sum(len(r["text"].split()) for r in out.collect()) == 235 and out.columns == _docs(spark, docs).columns
    twice = mixing.mixed(_docs(spark, docs[:4]), domain, weights, 70, 2, 3)
    assert sum(len(r["text"].split()) for r in twice.collect()) == 70
    assert mixing.mixed(_docs(spark, []), domain, weights, 10, 1, 3).count() == 0


def test_mixing_prefix_follows_the_seeded_order(spark):
    docs = [(i, "t " * (1 + i % 7)) for i in range(200)]
    rows = mixing.decided(_docs(spark, docs), F.lit("d"), (F.lit(1),) * 3, 300, 1, 5).collect()
    left, want = 300, {}
    for i, t in sorted(docs, key=lambda d: hashlib.md5(f"5:0:{d[0]}".encode()).hexdigest()):
        want[i] = min(left, len(t.split()))
        left -= want[i]
    assert {r["doc_id"]: r["mx_prefix"] for r in rows} == want


def test_quality(spark):
    rng = random.Random(1)
    good = ["the cat sat on the mat", "a dog ran in the park", "we read the long book"]
    docs = [(i, " ".join(rng.choices(good, k=3))) for i in range(60)] + [(100 + i, "BUY!! NOW!! $$$ " * 5) for i in range(15)] + [(200, None), (201, ""), (None, "the cat sat"), (3, "the cat sat on the mat")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(8)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    frame = _docs(spark, docs)
    kept = quality.resample(frame, labels)
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(60)) <= set(ids) and not {i for i in ids if i and 100 <= i < 115} and kept.columns == frame.columns
    _, key, least, narrow = quality.model(frame, labels, 10)
    scores = sorted(((r["lw_key_"], r["doc_id"] if r["doc_id"] is not None else -(1 << 62)) for r in narrow.collect()), reverse=True)
    assert (key, least) == scores[9]
    assert quality.resample(_docs(spark, []), labels).count() == 0
    assert quality.resample(frame, labels.limit(0)).count() >= 0


def test_cutoff_against_all_edges(spark):
    rng = random.Random(6)
    for n in (1, 2, 7, 60, 300):
        rows = [(round(rng.gauss(g * 40, 60)), bool(g), not g) for g in (rng.randrange(2) for _ in range(n))] + [(10**9, True, False), (-5, False, True), (3, False, False)]
        rows = rows[:-2] + [(rows[0][0], True, False)] + rows[-2:]
        labelled = [(w, g) for w, g, b in rows if g or b]
        good, bad = sum(g for _, g in labelled), sum(not g for _, g in labelled)
        gain = lambda e: sum(not g for w, g in labelled if w < e) * good - sum(g for w, g in labelled if w < e) * bad
        best = min({w for w, _ in labelled}, key=lambda e: (-gain(e), e))
        under = [w for w, _ in labelled if w < best]
        want = (max(under) + best + 1) // 2 if under else best
        frame = spark.createDataFrame(rows, "lw_ long, good boolean, bad boolean").repartition(3)
        assert quality.cutoff(frame) == want
    assert quality.cutoff(frame.where("not bad")) == 0 and quality.cutoff(frame.limit(0)) == 0


def test_quality_weights_by_hand(spark):
    docs = spark.createDataFrame([(1, "aab aab"), (2, "zz zz top"), (3, "aab")], "doc_id long, text string")
    rows = docs.select("doc_id", "text", (F.col("doc_id") == 1).alias("good"), F.lit(False).alias("bad"))
    ratios = quality.log_ratios(rows, 1 << 16)
    n = {1: 5 + 1, 2: 7 + 2, 3: 1}
    got = {r["doc_id"]: (r["lw_"], r["lw_n_"]) for r in quality.scored(docs, ratios).collect()}
    assert {i: x[1] for i, x in got.items()} == n and got[1][0] > got[2][0]
    raw, target = sum(n.values()) + 0.5 * (1 << 16), n[1] + 0.5 * (1 << 16)
    one = round((math.log(2.5 / target) - math.log(3.5 / raw)) * quality.UNIT)
    assert one in set(ratios.tolist())  # the trigram aab, twice in the target and three times in all


def test_language_model(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(w for _ in range(20) for w in rng.choice([("the", "cat"), ("a", "dog"), ("red", "house")]))) for i in range(300)]
    rows += [(1000 + i, f"Rare{i} Words{i} the cat") for i in range(40)] + [(2000, None), (2001, ""), (2002, "never seen here"), (None, "the cat"), (5, rows[5][1])]
    got = lm.language_scores(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    count = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))
    want = sorted((str(i), held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(base(t), 6)) for i, t in rows)
    assert want == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    out = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm.language_scores(_docs(spark, [])).count() == 0


def test_probabilities_of_all_words_sum_to_one(spark, monkeypatch):
    """Over every known word, the end mark and one unseen word of each rare class, after two contexts."""
    monkeypatch.setattr(lm, "OWN", 20)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    docs = _docs(spark, [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(400)], k=60))) for i in range(30)])
    table = lm.counts(docs.select("text"))
    lex = lm.lexicon(table)
    own, count, cls = lex.own, lex.count, lex.cls
    assert 0 < own < len(count) and lex.v == len(count)
    p = {k: v * 8 for k, v in lm.initial(lex).items()}
    start = len(p["q"])
    for one, two in ((start, start), (3, start - 1)):
        by_class = np.exp(lm.class_scores(p, np.arange(start), np.full(start, one), np.full(start, two)))
        spread = lex.rare_n + lex.rare_v + 1
        known = sum(by_class[c] * ((n + 1) / spread[c] if c < lm.RARE else 1) for n, c in zip(count, cls, strict=True))
        assert abs(known + (by_class[: lm.RARE] / spread).sum() - 1) < 1e-5


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "cat", "sat", f"x{i % 9}"], k=30))) for i in range(120)]
    shown = lambda n: sorted((r["doc_id"], r["score"]) for r in lm.language_scores(_docs(spark, rows).repartition(n)).collect())
    assert all(abs(a[1] - b[1]) < 1e-6 * abs(a[1]) for a, b in zip(shown(1), shown(5), strict=True))


def test_class_probabilities_sum_to_one():
    lex = lm.Lexicon(np.arange(5, dtype=np.uint64), np.arange(5)[::-1] + 1, np.zeros(5, np.int64), 5, np.ones(lm.RARE), np.ones(lm.RARE), 20, 9)
    p = lm.initial(lex)
    m = len(p["q"])
    s = lm.class_scores(p, np.arange(m), np.full(m, 3), np.full(m, m))
    assert abs(np.exp(s).sum() - 1) < 1e-5
