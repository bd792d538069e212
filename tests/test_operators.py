import datetime as dt

from pyspark.sql import functions as F

from lethe.functions.text import base_name, is_label, is_name_shaped, is_number_like, is_recent_date, is_searchable, needs_ocr, normalised, url_decoded
from lethe.operators import admission, evaluate, findings, rects, terms
from lethe.operators.chunk import chunks
from lethe.operators.grouping import group_document, grouped, with_name_parts
from lethe.plans.detect import detect
from lethe.plans.evaluate import evaluate as evaluated
from lethe.sources.files import sniffed


def _one(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["v"] for r in rows.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def test_predicates(spark):
    assert _one(spark, is_searchable, "a", "ab", "[x y]", "123", "1234", "x" * 201) == [False, True, False, False, True, False]
    assert _one(spark, lambda c: is_recent_date(c, 2026), "3 May 2025", "1941", "no year") == [True, False, False]
    assert _one(spark, is_number_like, "07700 900123", "12345", "abcdef123456", "14/03/1941") == [True, False, False, True]
    assert _one(spark, is_label, "[Person 1]", "[ID number 12345]", "Person", "[1]", None) == [True, False, False, False, False]
    assert _one(spark, is_name_shaped, "Anna van Lee", "anna", "Lee, Anna", "A B C D E F") == [True, False, False, False]
    assert _one(spark, needs_ocr, "x" * 25, "x" * 24, "x" * 26 + "�" * 4, "") == [False, True, True, True]
    assert _one(spark, normalised, "Ｆoo--Bar!", " É ", "ﬁ") == ["foo bar", "é", "fi"]
    assert _one(spark, url_decoded, "a%20b", "a+b", "%zz") == ["a b", "a+b", "%zz"]
    assert _one(spark, base_name, "a/b\\c.pdf", "x.toolong1", ".bashrc1") == ["c", "x.toolong1", ".bashrc1"]


def test_sniff_order(spark):
    heads = [b"%PDF-1.7", b"xx%PDF-", b"PK\x03\x04", b"\xd0\xcf\x11\xe0", b"\x89PNG", b"\xff\xd8\xff", b"RIFF....WEBP", b"....ftypheic", b"GIF8", b""]
    got = _one(spark, lambda c: F.coalesce(sniffed(c)["kind"], sniffed(c)["error"]), *map(bytearray, heads), kind="binary")
    assert got == ["pdf", "pdf", "docx", "old_word", "image", "image", "image", "heic", "unknown_type", "unknown_type"]


def test_terms_and_entities(spark):
    raw = '[{"text":" Ann ","label":"[Person 1]"},{"text":"Ann"},{"text":""},{"text":5},{"text":"Bo","label":"bad"}]'
    rows = terms.approved_terms(spark.createDataFrame([(1, raw), (2, "nonsense"), (3, None)], "doc_id long, terms_json string")).orderBy("ord").collect()
    assert [(r["text"], r["label"]) for r in rows] == [("Ann", "[Person 1]"), ("Bo", "[Redacted]")]
    raw = '{"entities":[{"text":" Ann ","type":"PERSON","refers_to":" "},{"text":"x","type":"ROBOT","refers_to":"y"},{"text":" "}]}'
    rows = terms.entity_candidates(spark.createDataFrame([(1, raw), (2, "{}"), (3, "[")], "doc_id long, entities_json string")).orderBy("ord").collect()
    assert [(r["type"], r["text"], r["refers_to"]) for r in rows] == [("PERSON", "Ann", "Ann"), ("OTHER", "x", "y")]


def test_grouping_rules():
    rows = [("PERSON", "Margaret Jones", "Margaret Jones"), ("PERSON", "Mrs Jones", "Margaret Jones"), ("PERSON", "Dad", "Dad"), ("PERSON", "M. Jones", "M. Jones"), ("PLACE", "margaret jones", "x")]
    out = group_document(rows)
    assert out[0] == ("PERSON", ["Margaret Jones", "Mrs Jones", "margaret jones", "M. Jones"]) and out[1] == ("PERSON", [])
    # two people fit: nothing is merged
    two = group_document([("PERSON", n, n) for n in ("Ann Lee", "Bob Lee", "Lee")])
    assert [t for _, t in two] == [["Ann Lee"], ["Bob Lee"], ["Lee"]]


def test_labels_leave_gaps_and_name_parts_are_added(spark):
    rows = [(1, 0, "PERSON", "M. Jones", "M. Jones"), (1, 1, "PERSON", "Margaret Jones", "Margaret Jones"), (1, 2, "PERSON", "Bo Ek", "Bo Ek")]
    groups = grouped(spark.createDataFrame(rows, "doc_id long, ord int, type string, text string, refers_to string"))
    units = spark.createDataFrame([(1, 0, 1, "Margaret Jones. Margaret came. Bo Ek left.")], "doc_id long, unit_id int, page int, text string")
    out = {r["label"]: r["texts"] for r in with_name_parts(groups, units).collect()}
    assert "Margaret" in next(t for t in out.values() if "Margaret Jones" in t) and ["Bo Ek"] in out.values()


def test_chunks_by_hand(spark):
    long = "\n".join(["\n", "x" * 30, "y" * 9, "z" * 3])
    units = spark.createDataFrame([(1, 0, "aaaa"), (1, 1, "bbb"), (1, 2, "  "), (1, 3, long)], "doc_id long, unit_id int, text string")
    got = [r["text"] for r in chunks(units, 12).orderBy("chunk_id").collect()]
    assert got == ["aaaa\n\nbbb", "x" * 12, "x" * 12, "x" * 6, "y" * 9, "z" * 3] and all(len(c) <= 12 for c in got)


def test_rects(spark):
    box = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    rows = spark.createDataFrame([([(0.0, 0.0, 5.0, 10.0), None, (5.0, 1.0, 9.0, 9.0), (0.0, 20.0, 4.0, 30.0)],)], f"b {box}")
    got = rows.select(rects.span_rects(F.col("b"), F.lit(0), F.lit(4)).alias("r"), rects.span_rects(F.col("b"), F.lit(1), F.lit(2)).alias("none")).first()
    assert [tuple(r) for r in got["r"]] == [(0.0, -0.5, 9.0, 10.5), (0.0, 19.5, 4.0, 30.5)] and got["none"] == []


def test_budget_refuses_and_then_admits_less(spark):
    t = dt.datetime(2026, 1, 1, 12)
    rows = spark.createDataFrame([(1, t, 6), (2, t, 6), (3, t, 4), (4, t, 1), (5, t, 99), (6, t + dt.timedelta(days=1), 10)], "req_id long, ts timestamp, pages long")
    got = {r["req_id"]: r["admitted"] for r in admission.daily_budget(rows, 10).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True}


def test_rate_limit(spark):
    t = dt.datetime(2026, 1, 1, 12)
    rows = spark.createDataFrame([("k", t + dt.timedelta(minutes=50 * i), i) for i in range(6)], "key string, ts timestamp, req_id long")
    got = {r["req_id"]: r["admitted"] for r in admission.rate_limited(rows, 1, 4).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: False, 5: False}


def test_evaluation(spark):
    truth = spark.createDataFrame([(1, 0, "PERSON", "Ann Lee"), (1, 1, "ADDRESS", "12 High Street"), (1, 2, "ID", "943 476 5919")], "doc_id long, ord int, type string, text string")
    keep = spark.createDataFrame([(1, 0, "the plan"), (1, 1, "gone")], "doc_id long, ord int, text string")
    out = spark.createDataFrame([(1, 0, "Lee went. The  Plan. 943-476-5919 12 ")], "doc_id long, unit_id int, text string")
    t = evaluated(truth, keep, out)
    assert {r["type"]: r["leaked"] for r in t["by_type"].collect()} == {"PERSON": 1, "ADDRESS": 1, "ID": 1, "ALL": 3}
    assert not t["gate"].first()["passed"] and [r["text"] for r in t["lost"].collect()] == ["gone"]
    assert t["keep_rate"].first()["kept_share"] == 0.5
    assert evaluated(truth, keep, out, only=[7])["gate"].first()["passed"]


def test_detect_with_a_detector_and_recall(spark):
    units = spark.createDataFrame([(1, 0, 1, "Ann Lee rang 07700 900123. Bo was out."), (1, 1, 2, "Ann slept.")], "doc_id long, unit_id int, page int, text string")

    def detector(parts):
        found = parts.select("doc_id", F.explode(F.array(F.lit("Ann Lee"), F.lit("Nobody Here"), F.when(F.col("text").contains("[Person 1]"), F.lit("Bo")))).alias("text")).where("text is not null")
        return found.select("doc_id", F.lit(0).alias("ord"), F.lit("PERSON").alias("type"), "text", F.col("text").alias("refers_to"))

    got = {r["label"]: (r["count"], r["pages"]) for r in detect(units, detector).collect()}
    assert got == {"[Person 1]": (2, [1, 2]), "[Phone number 1]": (1, [1]), "[Person 2]": (1, [1])}


def test_empty_tables(spark):
    units = spark.createDataFrame([], "doc_id long, unit_id int, page int, text string")
    assert detect(units).count() == 0 and chunks(units).count() == 0
    assert findings.summarised(units.select("doc_id", "page", F.expr("array(named_struct('s', 1, 'e', 2, 'label', 'x'))").alias("spans"))).count() == 0
    assert evaluate.gate(spark.createDataFrame([], "type string, leaked boolean")).first()["passed"]


def test_budget_of_null_pages_and_null_days(spark):
    t = dt.datetime(2026, 1, 1, 12)
    rows = spark.createDataFrame([(1, t, None), (2, t, 6), (3, None, 9), (4, None, 9), (None, t, 5)], "req_id long, ts timestamp, pages long")
    got = {r["req_id"]: r["admitted"] for r in admission.daily_budget(rows, 10).collect()}
    assert got[1] is False and sorted((got[3], got[4])) == [False, True] and sorted((got[2], got[None])) == [False, True]
    assert admission.daily_budget(rows.limit(0), 10).count() == 0


def test_limits_of_the_session(spark):
    for name, value in {"max_chunk": 12, "day_pages": 5, "per_hour": 1, "max_terms": 1, "max_file": 3}.items():
        spark.conf.set(f"spark.lethe.{name}", str(value))
    try:
        t = dt.datetime(2026, 1, 1, 12)
        rows = spark.createDataFrame([("k", t, i, 3) for i in range(5)], "key string, ts timestamp, req_id long, pages long")
        assert sum(r["admitted"] for r in admission.rate_limited(rows).collect()) == 1
        assert sum(r["admitted"] for r in admission.redaction_limited(rows).collect()) == 4
        assert sum(r["admitted"] for r in admission.daily_budget(rows).collect()) == 1
        units = spark.createDataFrame([(1, 0, "aaaa bbbb"), (1, 1, "cccc dddd"), (None, 0, "e"), (None, 1, None)], "doc_id long, unit_id int, text string")
        assert sorted(r["text"] for r in chunks(units).collect()) == ["aaaa bbbb", "cccc dddd", "e"]
        raw = spark.createDataFrame([(1, '[{"text":"Ann"},{"text":"Bo"}]')], "doc_id long, terms_json string")
        assert [r["text"] for r in terms.approved_terms(raw).collect()] == ["Ann"]
        from lethe.plans.extract import extract

        files = spark.createDataFrame([(1, "a", bytearray(b"%PDF-1.4"))], "doc_id long, file_name string, content binary")
        assert [r["error"] for r in extract(files)[1].collect()] == ["too_large"]
    finally:
        for name in ("max_chunk", "day_pages", "per_hour", "max_terms", "max_file"):
            spark.conf.unset(f"spark.lethe.{name}")


def test_chunks_against_a_plain_fold(spark):
    import random

    rng = random.Random(1)
    line = lambda: "".join(rng.choices("ab ", k=rng.choice([0, 3, 9, 25, 60])))
    rows = [(d, u, "\n".join(line() for _ in range(rng.randint(0, 6)))) for d in range(12) for u in range(rng.randint(1, 8))]
    want = []
    for d in range(12):
        parts = []
        for _, _, text in sorted(r for r in rows if r[0] == d):
            cur, out = "", []
            for piece in text.split("\n") if len(text) > 20 else [text]:
                if len(piece) > 20:
                    out += [cur] * bool(cur) + [piece[i : i + 20] for i in range(0, len(piece), 20)]
                    cur = ""
                elif len(cur) + len(piece) + 1 > 20:
                    out += [cur] * bool(cur)
                    cur = piece
                else:
                    cur = cur + "\n" + piece if cur else piece
            parts += [p for p in [*out, cur] if p.strip()]
        cur, n = "", 0
        for p in [*parts, None]:
            if p is not None and cur and len(cur) + len(p) + 2 <= 20:
                cur += "\n\n" + p
                continue
            if cur:
                want.append((d, n, cur))
                n += 1
            cur = p or ""
    got = chunks(spark.createDataFrame(rows, "doc_id long, unit_id int, text string").repartition(5), 20)
    assert sorted(map(tuple, got.collect())) == want
