"""Whole plans: files opened once, detectors asked once, streams equal to batches, logs without content."""

import datetime as dt
import json

import pyarrow as pa
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lethe.functions.limits import Limits
from lethe.operators import admission
from lethe.plans.detect import detect
from lethe.plans.extract import PAGES, extract
from lethe.sources import events, files
from lethe.streaming.admission import daily_budget_stream, rate_limited_stream
from lethe.streaming.progress import Progress

from test_files import _file


def _counting_reader(counter):
    def read(contents: pa.Array) -> pa.Array:
        counter.add(sum(c is not None for c in contents.to_pylist()))
        return pa.array([None if c is None else [{"page": i + 1, "text": t, "ocr": not t} for i, t in enumerate(c.decode()[8:].split("|"))] for c in contents.to_pylist()], pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string()), ("ocr", pa.bool_())])))

    return lambda content: F.arrow_udf(read, PAGES)(content)


def test_each_file_is_opened_once(spark):
    counter = spark.sparkContext.accumulator(0)
    rows = [(1, "in/One.pdf", bytearray(b"%PDF-1.7first|second|")), (2, "two.docx", _file()), (3, "3", bytearray(b"%PDF-1.7 | ")), (4, "4", bytearray(b"%PDF-1.7" + b"x|" * 60)), (5, "5", bytearray(b"??")), (6, "6", None), (None, "7.pdf", bytearray(b"%PDF-1.7seventh"))]
    inputs = spark.createDataFrame(rows, "doc_id long, file_name string, content binary").withColumns({"kind": F.lit("x"), "pages": F.lit(1)})
    out = extract(inputs, {"pdf": _counting_reader(counter)})
    for _ in range(2):
        units = sorted((r["doc_id"] or 0, r["unit_id"], r["page"], r["text"]) for r in out.units.collect() if r["doc_id"] != 2)
        assert units == [(0, 0, 1, "seventh"), (0, 1, None, "7"), (1, 0, 1, "first"), (1, 1, 2, "second"), (1, 2, 3, ""), (1, 3, None, "One")]
        assert {r["doc_id"]: r["error"] for r in out.refused.collect()} == {3: "no_text", 4: "too_many_pages", 5: "unknown_type", 6: "unknown_type"}
        meta = {r["doc_id"]: (r["kind"], r["pages"], r["ocr_pages"], r["notices"]) for r in out.meta.collect()}
        assert meta == {1: ("pdf", 3, 1, []), 2: ("docx", 0, 0, ["media_not_checked"]), None: ("pdf", 1, 0, [])}
    assert counter.value == 4
    assert out.meta.where("doc_id = 2").first()["unpacked"] > 500
    for table in out:
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Python" not in plan and "Arrow" not in plan
    assert [t.count() for t in extract(inputs.limit(0))] == [0, 0, 0]


def test_files_that_are_too_large_are_refused_and_not_lost(spark, tmp_path):
    (tmp_path / "small.bin").write_bytes(b"%PDF-1.7")
    (tmp_path / "large.bin").write_bytes(b"%PDF-1.7" + b"x" * 1000)
    spark.conf.set("spark.lethe.max_file", "100")
    try:
        found = files.binary_files(spark, f"file://{tmp_path}").withColumn("doc_id", F.length("path").cast("long")).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
        assert {r["file_name"]: (r["content"] is None, r["error"]) for r in found.collect()} == {"small.bin": (False, None), "large.bin": (True, "too_large")}
        assert sorted(r["error"] for r in extract(found.withColumn("doc_id", F.hash("file_name"))).refused.collect()) == ["no_reader", "too_large"]
    finally:
        spark.conf.unset("spark.lethe.max_file")
    assert Limits.of(spark).max_file > 100


def test_a_detector_is_asked_once_a_chunk_and_pass(spark):
    counter = spark.sparkContext.accumulator(0)
    spark.conf.set("spark.lethe.max_chunk", "40")
    units = spark.createDataFrame([(d, u, 1, f"Ann Lee{u} rang Bo Ek{u}.") for d in (1, 2) for u in range(3)], "doc_id long, unit_id int, page int, text string")

    def seen(texts: pa.Array) -> pa.Array:
        counter.add(len(texts))
        import re

        return pa.array([(re.findall(r"Ann \w+", t) or re.findall(r"Bo \w+", t)) + ["Not There"] for t in texts.to_pylist()], pa.list_(pa.string()))

    def detector(parts):
        found = parts.select("doc_id", "chunk_id", F.posexplode(F.arrow_udf(seen, "array<string>")("text")).alias("i", "text"))
        return found.select("doc_id", (F.col("chunk_id") * 100 + F.col("i")).alias("ord"), F.lit("PERSON").alias("type"), "text", F.col("text").alias("refers_to"))

    try:
        got = detect(units, detector).collect()
    finally:
        spark.conf.unset("spark.lethe.max_chunk")
    assert counter.value == 2 * 6
    assert sorted((r["doc_id"], *r["texts"]) for r in got) == sorted((d, f"{n}{u}") for d in (1, 2) for u in range(3) for n in ("Ann Lee", "Bo Ek"))


def _run(spark, tmp_path, make, name):
    stream = spark.readStream.schema("key string, ts timestamp, req_id long, pages long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = make(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}").option("checkpointLocation", f"file://{tmp_path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_admission_on_a_stream_is_that_of_the_batch(spark, tmp_path):
    events_ = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id").collect()
    rows = [(None if e["user_id"] % 50 == 0 else f"u{e['user_id'] % 7}", e["ts"], e["event_id"], None if e["event_id"] % 9 == 0 else e["event_id"] % 5) for e in events_]
    schema = "key string, ts timestamp, req_id long, pages long"
    cuts = [0, 300, 650, len(rows)]
    makes = {"rate": lambda s: rate_limited_stream(s, 1, 3).drop("key", "ts"), "budget": lambda s: daily_budget_stream(s.select("req_id", "ts", "pages"), 40).select("req_id", "admitted")}
    (tmp_path / "in").mkdir()
    for lo, hi in zip(cuts[:-1], cuts[1:]):  # each part is a new run, which goes on from the checkpoint
        spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        for name, make in makes.items():
            _run(spark, tmp_path, make, name)
    whole = spark.createDataFrame(rows, schema)
    want = {"rate": admission.rate_limited(whole, 1, 3), "budget": admission.daily_budget(whole, 40)}
    for name, table in want.items():
        got = {r["req_id"]: r["admitted"] for r in spark.read.parquet(f"file://{tmp_path}/{name}").collect()}
        assert got == {r["req_id"]: r["admitted"] for r in table.collect()}
        assert {True, False} == set(got.values())


def test_progress_rises_to_the_total_and_ends(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("k", dt.datetime(2026, 1, 1), i * 4 + j, 1) for j in range(4)], "key string, ts timestamp, req_id long, pages long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    for name, broken in (("fine", False), ("broken", True)):
        said = []
        listener = Progress(name, 12, said.append, lambda: '{"type":"findings"}')
        spark.streams.addListener(listener)
        try:
            stream = spark.readStream.schema("key string, ts timestamp, req_id long, pages long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
            rows = stream.withColumn("x", F.raise_error(F.concat(F.lit("secret "), "key"))) if broken else stream
            q = rows.writeStream.format("noop").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
            try:
                q.awaitTermination(120)
            except Exception:
                assert broken
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        finally:
            spark.streams.removeListener(listener)
        found = [json.loads(x) for x in said]
        if broken:
            assert found[0]["done"] == 0 and found[-1]["type"] == "error" and "secret" not in said[-1]
        else:
            assert [x.get("done") for x in found] == [0, 4, 8, 12, None] and all(x["total"] == 12 for x in found[:-1])
            assert found[-1] == {"type": "findings"}


def test_a_torn_last_line_is_dropped_and_no_other(spark, tmp_path):
    line = lambda i: '{"doc_id":' + str(i) + ',"type":"progress","done":' + "1" * (i % 4 + 1) + "}"
    whole, torn, long = ([line(i + k) for i in range(40)] for k in (0, 1000, 2000))
    (tmp_path / "whole").write_text("\n".join(whole) + "\n")
    (tmp_path / "torn").write_text("\n".join(torn) + "\n" + torn[-1])
    (tmp_path / "long").write_text("\n".join([*long, "", "no event"]) + "\n" + '{"doc_id":7,"name":"' + "é" * 400)
    (tmp_path / "one").write_text(line(1))
    (tmp_path / "same").write_text(f"{line(2)}\n{line(2)}")
    (tmp_path / "none").write_text("")
    for size in ("300", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = sorted(r["value"] for r in events.ended_lines(spark, f"file://{tmp_path}").collect())
            read = events.read_events(spark, f"file://{tmp_path}")
            assert read.count() == 122 and read.where("doc_id is null").count() == 1
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == sorted([*whole, *torn, *long, "", "no event", line(2)])


def test_no_text_reaches_a_log(spark):
    rows = spark.createDataFrame([(1, "Ann Lee", None, 3), (2, "Bo Ek", "damaged", None), (3, "Cy", "Ann Lee was here", 2)], "doc_id long, text string, error string, removed int")
    log = Observation()
    kept = events.logged(rows, log, F.col("error"), F.col("removed")).collect()
    assert len(kept) == 3
    out = events.log_rows(spark, log)
    assert {r["measure"]: r["n"] for r in out.where("n > 0").collect()} == {"rows": 3, "damaged": 1, "other": 1, "removed": 5}
    assert {r["measure"] for r in out.collect()} == {"rows", "other", "removed", *events.ERRORS} and dict(out.dtypes)["n"] == "bigint"
    log = Observation()
    assert events.logged(rows.limit(0), log).count() == 0 and log.get["rows"] == 0


def test_selected_terms_follow_the_ticked_ones_whatever_their_number(spark):
    from lethe.operators.terms import selected_terms

    found = spark.createDataFrame([(1, "[A 1]", ["x1", "x2"]), (1, "[B 1]", ["y1"])], "doc_id long, label string, texts array<string>")
    ticked = spark.createDataFrame([(1, "[A 1]")], "doc_id long, label string")
    manual = spark.createDataFrame([(1, 0, "x2"), (1, 5, " zz "), (2, 0, "yy"), (1, 9, "z")], "doc_id long, ord int, text string")
    got = sorted((r["doc_id"], r["ord"], r["text"]) for r in selected_terms(found, ticked, manual).collect())
    assert got == [(1, 0, "x1"), (1, 1, "x2"), (1, 2, "zz"), (2, 0, "yy")]
