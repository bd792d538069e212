"""Forms of operators that must hold for one very large document, against plain versions."""

import random

from pyspark.sql import functions as F

from lethe.operators import segments
from lethe.operators.grouping import _key, _norm, _words, group_document, grouped, merge_fits
from lethe.functions.fixed import FAMILY_WORDS


def plain_groups(rows):
    """Grouping by comparing all people with all."""
    groups, known = [], {}
    for kind, text, refers in rows:
        norm = _norm(text)
        if kind == "PERSON" and norm in FAMILY_WORDS:
            continue
        at = known.get(norm, known.get(_key(kind, refers)))
        if at is None:
            at = len(groups)
            groups.append((kind, []))
        if text not in groups[at][1]:
            groups[at][1].append(text)
        for k in (norm, _key(kind, refers)):
            known.setdefault(k, at)
    people = [g for g in groups if g[0] == "PERSON"]
    for mine in people:
        full, initials = _words(mine[1])
        fits = [o for o in people if full and o is not mine and o[1] and full < _words(o[1])[0] and all(any(w.startswith(i) for w in _words(o[1])[0]) for i in initials)]
        if len(fits) == 1:
            fits[0][1].extend(t for t in mine[1] if t not in fits[0][1])
            mine[1].clear()
    return groups


def _names(rng, n):
    first, last = ["Ann", "Bo", "Cy", "Dee", "E.", "F", "Dr Gil"], ["Lee", "Ek", "Ray-Lee", "Oh", "van Ek", "L.", "Jones, A"]
    pick = lambda: " ".join(rng.choice(x) for x in rng.sample([first, last, first, last], rng.randint(1, 4)))
    return [(rng.choice(["PERSON"] * 4 + ["PLACE"]), t, rng.choice([t, pick()])) for t in (rng.choice([pick(), "Mum"]) for _ in range(n))]


def test_groups_are_those_of_comparing_all():
    rng = random.Random(4)
    for _ in range(400):
        rows = _names(rng, rng.randint(0, 25))
        assert group_document(rows) == plain_groups(rows), rows


def test_fifty_thousand_candidates_in_one_document(spark):
    rng = random.Random(5)
    made = [("PERSON", f"Anna Name{i // 2} {'Lee' if i % 2 else ''}".strip(), f"Anna Name{i // 2}" if i % 3 else f"ref {i}") for i in range(50_000)] + [("PERSON", "Anna", "Anna"), ("PERSON", "Lee", "Lee")]
    rng.shuffle(made)
    rows = [(1, i, *r) for i, r in enumerate(made)] + [(2, 0, "ID", "x", None), (None, 0, "ID", "x", "x"), (2, 1, "ID", None, "x")]
    got = grouped(spark.createDataFrame(rows, "doc_id long, ord int, type string, text string, refers_to string").repartition(5)).collect()
    want = [(i, kind, texts) for i, (kind, texts) in enumerate(group_document(made)) if texts]
    assert sorted((r["group_ord"], r["type"], r["texts"]) for r in got if r["doc_id"] == 1) == want
    assert {r["label"] for r in got if r["doc_id"] == 1} == {f"[Person {i + 1}]" for i in range(len(want))}
    assert [(r["label"], r["texts"]) for r in got if r["doc_id"] != 1] == [("[ID number 1]", ["x"])] * 2


def test_no_document_is_a_list(spark):
    rows = spark.createDataFrame([(1, 0, "ID", "x", "x")], "doc_id long, ord int, type string, text string, refers_to string")
    assert "collect_list" not in grouped(rows)._jdf.queryExecution().toString()


def _plain_fits(rows):
    out = []
    for doc, name, words in rows:
        fits = [b for d, b, w in rows if d == doc and words and set(words) < set(w)]
        out += [(doc, name, fits)]
    by = {}
    for doc, name, fits in out:
        by.setdefault((doc, name), []).extend(fits)
    return sorted((d, a, f[0]) for (d, a), f in by.items() if len(f) == 1)


def test_containment_is_that_of_comparing_all(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(4), f"n{rng.randrange(150)}", rng.sample("abcdefgh", rng.randint(0, 4)) + rng.choice([[], ["a", "a"]])) for _ in range(200)]
    got = merge_fits(spark.createDataFrame(rows, "doc_id long, name string, words array<string>"))
    assert sorted(map(tuple, got.collect())) == _plain_fits(rows)


def test_a_hundred_thousand_names_in_one_document(spark):
    n = 50_000
    rows = spark.range(2 * n).select(F.lit(1).alias("doc_id"), F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") < n, F.array(F.lit("anna"), F.concat(F.lit("w"), "id"))).otherwise(F.array(F.lit("anna"), F.concat(F.lit("w"), F.col("id") - n), F.lit("lee"))).alias("words"))
    got = merge_fits(rows).agg(F.count("*"), F.count_if(F.substring("b", 2, 9).cast("int") == F.substring("a", 2, 9).cast("int") + n)).first()
    assert tuple(got) == (n, n)


def test_overlaps_are_those_of_comparing_all(spark, monkeypatch):
    monkeypatch.setattr(segments, "STRETCH", 16)
    rng = random.Random(7)
    texts = [(d, r, i, "".join(rng.choices("abc", k=rng.choice([0, 1, 3, 40])))) for d in range(2) for r in range(3) for i in range(30)]
    spans, ends = [], {}
    for d, r, _, t in texts:
        ends[d, r] = ends.get((d, r), 0) + len(t)
    for (d, r), end in ends.items():
        cuts = sorted(rng.sample(range(end + 1), min(14, end + 1)))
        spans += [(d, r, s, e, f"[{s}]") for s, e in zip(cuts[::2], cuts[1::2])]
    at = segments.placed(spark.createDataFrame(texts, "doc_id int, run_id int, seg_ord int, text string"))
    got = segments.overlaps(at, spark.createDataFrame(spans, "doc_id int, run_id int, s int, e int, label string")).collect()
    want, offset = [], {}
    placed = []
    for d, r, i, t in texts:
        s = offset.get((d, r), 0)
        offset[d, r] = s + len(t)
        placed.append((d, r, i, s, s + len(t)))
    for d, r, ps, pe, label in spans:
        met = [(i, s, e) for dd, rr, i, s, e in placed if (dd, rr) == (d, r) and e > ps and s < pe]
        want += [(d, r, i, max(ps - s, 0), min(pe, e) - s, label, n == 0) for n, (i, s, e) in enumerate(met)]
    assert sorted((x["doc_id"], x["run_id"], x["seg_ord"], x["a"], x["z"], x["label"], x["first"]) for x in got) == sorted(want)


def test_a_run_of_a_million_segments(spark):
    n = 1_000_000
    at = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("run_id"), F.col("id").cast("int").alias("seg_ord"), F.lit("abc").alias("text"))
    spans = spark.range(n // 10).select(F.lit(1).alias("doc_id"), F.lit(0).alias("run_id"), (F.col("id") * 30 + 2).cast("int").alias("s"), (F.col("id") * 30 + 4).cast("int").alias("e"), F.lit("[x]").alias("label"))
    out = segments.replaced(at, spans).groupBy("text").count().collect()
    assert {r["text"]: r["count"] for r in out} == {"abc": n - n // 5, "ab[x]": n // 10, "bc": n // 10}


