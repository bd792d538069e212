import io
import zipfile

from pyspark.sql import functions as F

from lethe.sources import docx, events
from lethe.streaming.admission import daily_budget_stream, hourly_counts
from lethe.streaming.redact import hits_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOC = f"""<w:document {W} xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><w:body>
<w:p><w:r><w:t>Mrs Marga</w:t></w:r><w:r><w:t>ret Jo</w:t><w:tab/></w:r></w:p>
<w:p><w:ins w:author="Margaret Jo" w:initials="MJ"><w:r><w:t>Margaret</w:t></w:r><w:r><w:br/><w:t>Jo, again</w:t></w:r></w:ins><w:r><wp:docPr id="1" descr="Photo of Margaret Jo"/></w:r></w:p>
<w:p><w:r><w:t> </w:t></w:r></w:p></w:body></w:document>"""
TYPES = '<Types><Override ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
CORE = '<c:coreProperties xmlns:c="c" xmlns:d="d"><d:creator>Margaret Jo</d:creator><d:title>Plan for Margaret Jo</d:title></c:coreProperties>'
RELS = '<Relationships xmlns="r"><Relationship Id="1" TargetMode="External" Target="mailto:Margaret%20Jo@x.org"/></Relationships>'


def _file(**extra) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in {"[Content_Types].xml": TYPES, "word/document.xml": DOC, "docProps/core.xml": CORE, "word/_rels/document.xml.rels": RELS, "word/media/a.png": "x"}.items():
            z.writestr(name, extra.get(name, data))
    return bytearray(out.getvalue())


def test_units_and_errors(spark):
    rows = spark.createDataFrame([(1, _file()), (2, bytearray(b"PK no")), (3, _file(**{"[Content_Types].xml": "<x/>"})), (4, None)], "doc_id long, content binary")
    got = docx.docx_units(rows).orderBy("doc_id", "unit_id").collect()
    assert [(r["kind"], r["text"]) for r in got if r["doc_id"] == 1] == [("paragraph", "Mrs Margaret Jo\t"), ("paragraph", "Margaret\nJo, again"), ("attribute", "Photo of Margaret Jo"), ("loose", "Margaret Jo"), ("loose", "Plan for Margaret Jo")]
    assert [r["error"] for r in got if r["doc_id"] > 1] == ["damaged", "not_word", "damaged"]


def test_redaction(spark):
    rows = spark.createDataFrame([(1, _file())], "doc_id long, content binary")
    terms = spark.createDataFrame([(1, 0, "Margaret Jo", "[Client 1]")], "doc_id long, ord int, text string, label string")
    r = docx.docx_redacted(rows, terms).first()
    assert r["error"] is None and r["removed"] == 5 and r["notices"] == ["media_not_checked"]
    with zipfile.ZipFile(io.BytesIO(r["content"])) as z:
        names = {n: z.read(n).decode() for n in z.namelist()}
    assert "Margaret" not in "".join(names.values()) and 'author="Author"' in names["word/document.xml"] and 'initials="A"' in names["word/document.xml"]
    assert 'Target="mailto:"' in names["word/_rels/document.xml.rels"]
    texts = [t for _, _, t in docx.units(bytes(r["content"]))[0]]
    assert texts == ["Mrs [Client 1]\t", "[Client 1]\n, again", "Photo of [Client 1]", "Plan for [Client 1]"]


def test_a_rewritten_part_keeps_its_declarations(spark):
    head = f'<w:document {W} xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="urn:w14" xmlns:w15="urn:w15" mc:Ignorable="w14 w15">'
    doc = head + '<w:body xmlns:own="urn:own"><w:p w14:paraId="1"><w:r><w:t>Ann &amp; Bob</w:t></w:r></w:p><x:p xmlns:x="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><x:r><x:t>Ann</x:t></x:r></x:p></w:body></w:document>'
    rows = spark.createDataFrame([(1, _file(**{"word/document.xml": doc}))], "doc_id long, content binary")
    terms = spark.createDataFrame([(1, 0, "Ann", "[P 1]")], "doc_id long, ord int, text string, label string")
    r = docx.docx_redacted(rows, terms).first()
    with zipfile.ZipFile(io.BytesIO(r["content"])) as z:
        new = z.read("word/document.xml").decode()
    want = doc.replace("<w:t>Ann", '<w:t xml:space="preserve">[P 1]').replace("<x:t>Ann", '<x:t xml:space="preserve">[P 1]')
    assert new.partition("?>\n")[2] == want and r["removed"] == 2


def test_damaged_parts_are_reported(spark):
    cut = bytearray(_file())
    cut[60:70] = b"0123456789"
    rows = spark.createDataFrame([(1, _file(**{"word/document.xml": "<w:p"})), (2, _file(**{"docProps/core.xml": "<a><b></a>"})), (3, _file(**{"word/_rels/document.xml.rels": ""})), (4, cut), (5, _file())], "doc_id long, content binary")
    terms = spark.createDataFrame([(i, 0, "Margaret Jo", "[Client 1]") for i in range(6)], "doc_id long, ord int, text string, label string")
    got = {r["doc_id"]: (r["error"], r["content"] is None) for r in docx.docx_redacted(rows, terms).collect()}
    assert [got[i] for i in (1, 2, 3, 5)] == [("damaged", True)] * 3 + [(None, False)] and got[4][1]
    units = docx.docx_units(rows.withColumn("size", F.length("content")), ("size",)).where("error is not null").collect()
    assert {r["doc_id"] for r in units} >= {1, 2} and all(r["size"] > 0 for r in units)


def test_a_label_word_is_refused(spark):
    rows = spark.createDataFrame([(1, _file())], "doc_id long, content binary")
    terms = spark.createDataFrame([(1, 0, "Margaret", "[Margaret 1]")], "doc_id long, ord int, text string, label string")
    r = docx.docx_redacted(rows, terms).first()
    assert r["error"] == "leak" and r["content"] is None and r["leftovers"] == ["Margaret"]


def test_events_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "n", "text/plain", bytearray(b"abc"), 2)], "doc_id long, name string, mime string, content binary, removed long")
    events.write_events(events.file_events(rows), f"file://{tmp_path}/e")
    got = events.read_events(spark, f"file://{tmp_path}/e").first()
    assert (got["type"], got["base64"], got["removed"]) == ("file", "YWJj", 2)


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")


def _all(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2026, 1, 1, 12)
    rows = [(1, "k", t, 6), (2, "k", t, 6), (3, "k", t + dt.timedelta(hours=1), 4), (4, "k", t + dt.timedelta(days=2), 1)]
    reqs = _stream(spark, tmp_path, rows, "req_id long, key string, ts timestamp, pages long")
    got = {r["req_id"]: r["admitted"] for r in _all(spark, daily_budget_stream(reqs.select("req_id", "ts", "pages"), 10), "budget")}
    assert got == {1: True, 2: False, 3: True, 4: True}
    counts = {(r["hour"], r["n"]) for r in _all(spark, hourly_counts(reqs), "hours")}
    assert (t, 2) in counts
    (tmp_path / "u").mkdir()
    units = _stream(spark, tmp_path / "u", [(1, 0, "a@b.org")], "doc_id long, unit_id int, text string")
    assert [r["text"] for r in _all(spark, hits_stream(units), "hits")] == ["a@b.org"]


def test_extract_sorts_out_what_it_cannot_read(spark):
    from lethe.functions.limits import Limits
    from lethe.plans.extract import doc_meta, extract
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "in/Margaret Jo.docx", _file()), (2, "a.pdf", bytearray(b"%PDF-1.4")), (3, "b", bytearray(b"??")), (4, "c.docx", bytearray(b"PK\x03\x04"))], "doc_id long, file_name string, content binary")
    units, refused, _ = extract(rows)
    assert [(r["page"], r["text"]) for r in units.orderBy("unit_id").collect()][-1] == (None, "Margaret Jo")
    assert {r["doc_id"]: r["error"] for r in refused.collect()} == {2: "no_reader", 3: "unknown_type", 4: "damaged"}
    meta = doc_meta(units.select("doc_id").distinct().withColumn("kind", F.lit("docx")), units).first()
    assert (meta["pages"], meta["ocr_pages"]) == (0, 0)
    assert Limits.of(spark).max_pages == 50
    spark.conf.set("spark.lethe.per_hour", "x")
    try:
        Limits.of(spark)
        raise AssertionError
    except ValueError:
        spark.conf.unset("spark.lethe.per_hour")
