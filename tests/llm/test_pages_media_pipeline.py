"""Pages, images and the pipeline."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lethe.llm import html, media
from lethe.llm.components import components
from lethe.llm.quality import op3_quality_resampling as quality_op
from lethe.llm.work import saved, shared_dir
from test_text_operators import WORD, _components, _spans

PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body class="page"><header><h2>Site</h2></header><nav><ul><li>Home</ul></nav>
<div class="notice-bar">We use cookies</div><div class=ad>Buy</div><div><span>Everywhere</span></div>
<article class="post"><h1>T%d &amp;  caf&eacute;</h1><p>One <b>bold</b>
 word&nbsp;here<br>and &lt;more&gt;.<p>Two %d</p><aside>side</aside><form>f</form><script>var a="</p>";</script><div class="share">s</div></article>
<section id="comments"><article class="comment">nice</article></section><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, "http://h.org/%d" % i, PAGE % (i, i), 1) for i in range(4)]
    bare = "<body><div>Everywhere</div><div><p>Only %d</p></div></body>"
    rows += [(10 + i, "http://g.org/", bare % i, 1) for i in range(4)]
    rows += [(20, None, None, 1), (21, "", "", 1), (22, "x", "plain &am", 1), (23, "x", "<p>cut <b", 1), (0, "http://h.org/0", PAGE % (0, 0), 1), (24, "x", "<div>" * 3000 + "deep", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row int").repartition(3)
    got = {}
    for r in html.main_text(pages).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i in range(4):
        assert set(got[i]) == {f"T{i} & café\n\nOne bold word here and <more>.\n\nTwo {i}"}
        assert got[10 + i] == [f"Only {i}"]  # what recurs on the host is template
    assert len(got[0]) == 2 and got[20] == got[21] == [""] and got[22] == ["plain &am"] and got[23] == ["cut"] and got[24] == ["deep"]
    assert html.main_text(pages.limit(0)).count() == 0


def test_main_text_of_repeated_pages(spark):
    frame = "<html><body><nav>at %d</nav><div>Everywhere</div><div class=wrap>%s<h1>T%d</h1><p>Text %d</p>%s</div></body></html>"
    rows, want = [], {}
    for m, (a, z) in enumerate([("<article>", "</article>"), ("", ""), ("<div>", "</div>")]):
        for i, copies in enumerate([1, 1, 2, 3, 5, 12]):
            for c in range(copies):
                for same, host in ((True, f"http://same{m}"), (False, f"http://other{m}")):
                    rows.append((len(rows), f"{host}/{i}?utm={c}", frame % (0 if same else c, a, i, i, z)))
                    want[len(rows) - 1] = f"T{i}\n\nText {i}"
        for c in range(4):  # a host of one page
            rows.append((len(rows), f"http://one{m}/{c}", frame % (c, a, 0, 0, z)))
            want[len(rows) - 1] = "T0\n\nText 0" if m == 0 else "Everywhere\n\nT0\n\nText 0"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in html.main_text(pages).collect()} == want


def test_templates_without_names(spark):
    """Pages that name nothing come right by the counts alone, menus with labels of their own as well."""
    rows, want = [], {}
    for i in range(30):
        menu = "".join(f"<li><a href=/{i}{j}>label {i} {j}</a></li>" for j in range(5))
        rows.append((i, f"http://plain.org/{i}", f"<html><head><title>x</title></head><body><div><ul id=m{i}>{menu}</ul></div><div>We use cookies</div><div><h1>Title {i}</h1><p>Text {i} about this <a href=x>one</a> thing</p></div><div><p>&copy; nobody<p>Imprint</div></body></html>"))
        want[i] = f"Title {i}\n\nText {i} about this one thing"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for names in (False, True):
        got = html.main_text(pages, names).collect()
        assert {r["page_id"]: r["text"] for r in got} == want and {(r["n_template"], r["n_named"]) for r in got} == {(9, 0)}
    assert {r["page_id"]: r["text"] for r in html.main_text(pages, held=0).collect()} == want  # templates joined instead of held


def test_small_tables_of_main_text_are_few_files(spark):
    """However many partitions a shuffle has: in a local folder executors start processes for each file."""
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.org/", PAGE % (i, i)) for i in range(400)], "page_id long, url string, html string").repartition(3)
    folder = Path(shared_dir(spark).removeprefix("file:"))
    texts = lambda: sorted(map(tuple, html.main_text(pages).collect()))
    want, before = texts(), set(folder.iterdir())
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        assert texts() == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    files = {p.name.split("-")[1]: len([*p.glob("part-*")]) for p in set(folder.iterdir()) - before}
    assert files.keys() == {"parsed", "hosts", "seen", "templates"}
    assert files["parsed"] == 3 and files["hosts"] == files["seen"] == files["templates"] == 1


def test_image_copies(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 60)], "vec_id long, embedding array<float>")
    images = media.rendered(vectors).unionByName(spark.createDataFrame([(500, None), (501, bytearray(b"P5 junk")), (None, bytearray(b"x"))], "media_id long, image binary"))
    images = images.unionByName(images.where("media_id = 7").withColumn("media_id", F.lit(600).cast("long"))).withColumn("key", F.lit(1))
    got = {r["media_id"]: r for r in media.copies(images, lambda c: c % 50 == 0).collect()}
    for q in (0, 50):
        found = {int(m.split(":")[0]) for m in got[q]["matches"].split(",")}
        assert found == {q + 3, q + 6, q + 9}
    assert got[600]["class_id"] == 7 and got[600]["matches"] == "" and got[1]["matches"] is None and got[500]["class_id"] is None
    assert media.copies(images.limit(0), lambda c: c % 50 == 0).count() == 0


def _pictures():
    """Large pictures and, from each, a crop of a quarter, one of half the side enlarged, a strong reduction and a darker copy."""
    out = {}
    for i in range(6):
        rng = np.random.default_rng(i)
        img = sum(media.resized(rng.uniform(0, 255, (n, n)).astype(np.float32), 260, 320) * w for n, w in ((12, 0.3), (30, 0.4), (70, 0.3)))
        edits = [img, img[40:180, 60:220], media.resized(img[60:200, 50:210], 210, 240), media.resized(img, 120, 148), img * 0.6 + 10]
        out |= {10 * i + k: media.decode(media.encode(e)) for k, e in enumerate(edits)}
    return out


def test_image_table_against_all_pairs(spark):
    pictures = _pictures()
    found = {}
    for k, img in pictures.items():
        _, place, d = media.features(img[None])
        found[k] = place, np.unpackbits(d.astype(">i8").view(np.uint8).reshape(len(d), 32), axis=1).astype(np.float32)
    want = set()
    for q in range(0, 60, 10):
        for k in pictures:
            (one, a), (two, b) = found[q], found[k]
            far = a @ (1 - b).T + (1 - a) @ b.T
            near = far.min(1) <= media.NEAR
            if k != q and near.any() and media.consensus(one[near], two[far.argmin(1)[near]]) >= media.LEAST:
                want.add((q, k))
    planted = {(q, q + k) for q in range(0, 60, 10) for k in range(1, 5)}
    assert want == planted
    images = spark.createDataFrame([(k, media.encode(p)) for k, p in pictures.items()], "media_id long, image binary").repartition(3)
    for limit in (media.BROADCAST_FEATURES, 0):  # the table in the tasks, and by shuffle
        before, media.BROADCAST_FEATURES = media.BROADCAST_FEATURES, limit
        rows = media.copies(images, lambda c: c % 10 == 0).where("is_query").collect()
        media.BROADCAST_FEATURES = before
        got = {(r["media_id"], int(m.split(":")[0])) for r in rows for m in r["matches"].split(",") if m}
        assert got <= want and len(got) >= 0.9 * len(want)


def test_image_formats():
    img = np.arange(12, dtype=np.float32).reshape(3, 4) * 20
    assert (media.decode(media.encode(img)) == img).all()
    assert media.decode(b"P6 1 1 255\n\x00\x03\x06").tolist() == [[3.0]] and media.decode(b"P5 2 2 255\n\x00") is None and media.decode(None) is None


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(30)}


def test_pipeline_stages_keep_their_promises(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    empty = docs.limit(0)
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "src1", 0)], docs.schema))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, sf)
        assert out.columns == columns or i == 4, name
        assert out.count() > 0 and stage(spark, empty, sf).count() == 0, name


def test_pipeline_keeps_documents_that_share_an_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "one text of an id that two sources gave away", "a"), (1, "and quite another text under the same id", "b"), (2, long, "a"), (3, long + " end", "a"), (3, "a third text that looks like neither of them", "b"), (None, long, "c"), (None, "text without an id", "c"), (None, "text without an id", "c"), (5, "same row", "a"), (5, "same row", "a"), (6, None, "a"), (7, "", "a")]
    frame = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], docs.schema).repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()), key=repr)
    assert got == sorted({(i, t) for i, t, _ in rows} - {(3, long + " end"), (None, long)}, key=repr)


def test_pipeline_against_plain_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], sf), "plain"))
    chosen = {r["doc_id"] for r in quality_op(spark, sf).where("selected").collect()}
    assert sorted(pairs(out[1])) == sorted((i, t) for i, t in pairs(docs) if i in chosen)
    groups = _components(pairs(out[1]))
    assert sorted(pairs(out[2])) == sorted((i, t) for i, t in pairs(out[1]) if groups[i, t][1] == i)
    before = dict(pairs(out[2]))
    for i, t in pairs(out[3]):
        assert _spans(t) == "" and (t == before[i]) == (_spans(before[i]) == "")
    words = lambda rows: sum(len(WORD.findall(t or "")) for _, t in rows)
    clean, drawn = dict(pairs(out[3])), pairs(out[4])
    assert words(drawn) == words(clean.items()) // 2 and all(clean[i].startswith(t) for i, t in drawn)
    packed = out[5].collect()
    assert sum(r["n_tokens"] for r in packed) == words(drawn) + len(drawn)
    joined = {}
    for r in sorted(packed, key=lambda r: r["piece"]):
        joined.setdefault(r["doc_id"], []).append(r["text"])
    twice = {i for i, _ in drawn if sum(j == i for j, _ in drawn) > 1}
    assert {i: "".join(t) for i, t in joined.items() if i not in twice} == {i: t for i, t in drawn if i not in twice}
    assert sorted(corpus_pipeline.run(spark, sf).drop("bin_id", "bin_length", "bin_tokens", "bin_offset").collect()) == sorted(out[5].drop("bin_id", "bin_length", "bin_tokens", "bin_offset").collect())
