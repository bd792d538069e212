"""Main text of web pages by removal of site templates.

Each page is parsed once into blocks of text and element subtrees, a subtree being a hash of its tag, its names without
their digits and everything in it, and the range of blocks it covers. A list of links is hashed a second time without
the links' own text, since menus differ in it. Subtrees are counted per host in Spark; one that recurs on many different
pages of its host is template and its blocks go. Pages with the same article are one page, however
often and under whatever URLs they are there. Where a page marks its article, recurring text inside it is only
template if most pages of the host have it, since articles quote and repeat; what is around an article is none. For what
cannot be counted, as on hosts of a few pages, the names of elements stand in (nav, footer, class="ad", ...).
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import parts, saved, sized_broadcast

#: Different pages (and share of the host's different pages) on which a subtree must recur to be template, outside and inside an article.
LEAST_PAGES, LEAST_SHARE = 3, 0.01
INNER_PAGES, INNER_SHARE = 10, 0.5
#: Templates (8 bytes each) that tasks may hold, and hosts and hashes that may be broadcast.
HELD_TEMPLATES, BROADCAST_ROWS = 1_000_000, 100_000

#: Links that a list must have to be known by its shape.
LEAST_LINKS = 3

# Fixed names: element types and words of class, id and role that mark what is not the article.
SKIP = {"head", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "select", "button", "textarea", "dialog", "nav", "header", "footer", "aside", "form", "menu"}
UNSEEN = {"head", "script", "style", "noscript", "template"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "complementary", "header", "masthead", "footer", "contentinfo", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "dialog", "overlay", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "widget", "comment", "comments", "commentlist", "reply", "replies", "respond", "discussion", "disqus", "pagination", "pager", "toolbar", "skip"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | SKIP
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSED_BY_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _hash(parts) -> bytes:
    return blake2b(b"\x00".join(parts), digest_size=8).digest()


_OPENS = re.compile(r"<(?:!--|[a-zA-Z/!?])")
_INSIDE = re.compile(r">|=\s*([\"'])")
_RAW = re.compile(r"<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?![^\s/>])", re.I)


def closed(source: str) -> str:
    """The source up to the first tag, comment or script that never closes, found in one pass, so that no parser looks for their ends again and again."""
    at, low = 0, source.lower()
    low = low if len(low) == len(source) else None  # a letter that is longer in lower case
    while m := _OPENS.search(source, at):
        start = m.start()
        if m.group() == "<!--":
            end = source.find("-->", start + 2)
            at = end + 3
        elif source[start + 1] in "!?":
            end = source.find(">", start)
            at = end + 1
        else:
            at, end = m.end(), -1
            while end < 0 and (n := _INSIDE.search(source, at)):
                if n.group() == ">":
                    end = n.start()
                    at = end + 1
                elif (at := source.find(n.group(1), n.end()) + 1) == 0:
                    break
            raw = _RAW.match(source, start) if end >= 0 and source[end - 1] != "/" else None
            if raw:
                name = raw.group(1).lower()
                end = low.find(f"</{name}", at) if low is not None else next((x.start() for x in re.compile(f"</{name}", re.I).finditer(source, at)), -1)
                at = end
        if end < 0:
            return source[:start]
    return source


class Page(HTMLParser):
    """Collects blocks (text, said, main) and subtrees (hash, main, first block, block after the last)."""

    def __init__(self, source: str, names: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool, bool]] = []
        self.trees: list[tuple[bytes, bool, int, int]] = []
        self.open: list[list] = []  # tag, names, said, main, first block, hashes, hashes without links' text, links or -1
        self.count: dict[str, int] = {}
        self.text: list[str] = []
        self.links, self.link, self.plain, self.names = 0, False, False, names
        self.feed(closed(source))
        self.close()
        while self.open:
            self._end()
        self._flush()

    def article(self) -> int:
        """Hash of the text that may be the article: the marked blocks, or all that no element's name rules out."""
        own = [t for t, _, m in self.blocks if m] or [t for t, said, _ in self.blocks if not said]
        return int.from_bytes(_hash(t.encode("utf-8", "replace") for t in own), "big", signed=True)

    def outside(self, host: str) -> list[tuple[int, bool, int, int]]:
        """The subtrees but for those around an article, their hashes made those of the host."""
        before = [0, *accumulate(m for _, _, m in self.blocks)]
        mask, salt = (1 << 64) - 1, int.from_bytes(_hash([host.encode("utf-8", "replace")]), "big") | 1
        out = []
        for digest, main, a, z in self.trees:
            if main or before[a] == before[z]:
                key = (int.from_bytes(digest, "big") + main) * salt & mask
                out.append((key - (1 << 64) if key >> 63 else key, main, a, z))
        return out

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        links = -1 if self.plain else self.links
        self.text.clear()
        self.links, self.plain = 0, False
        if text:
            self.blocks.append((text, bool(self.open and self.open[-1][2]), bool(self.open and self.open[-1][3])))
            if self.open:
                up = self.open[-1]
                up[5].append(text.encode("utf-8", "replace"))
                self._linked(up, b"", links)

    @staticmethod
    def _linked(up: list, shape: bytes, links: int) -> None:
        up[6].append(shape)
        up[7] = -1 if links < 0 or up[7] < 0 else up[7] + links

    def _end(self) -> None:
        self._flush()
        tag, names, _, main, first, parts, shapes, links = self.open.pop()
        self.count[tag] -= 1
        head = [tag.encode(), names.encode("utf-8", "replace")]
        digest = _hash([*head, *parts])
        shape = _hash([b"links", *head, *shapes]) if links >= 0 else b""
        if self.open:
            self.open[-1][5].append(digest)
            if len(self.blocks) > first:
                self._linked(self.open[-1], shape, links)
        if len(self.blocks) > first:
            self.trees.append((digest, main, first, len(self.blocks)))
            if links >= LEAST_LINKS:
                self.trees.append((shape, main, first, len(self.blocks)))

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag == "a":
            self.link = True
            self.links += 1
        if tag not in BLOCK:
            return
        closes = CLOSED_BY_ITSELF.get(tag, set())
        while self.open and (self.open[-1][0] == "p" or self.open[-1][0] in closes):
            self._end()
        self._flush()
        if tag in VOID:
            return
        values = {k: v or "" for k, v in attrs}
        names = " ".join(values.get(k, "") for k in ("class", "id", "role"))
        said, main = self._named(tag, values, names)
        self.open.append([tag, re.sub("[0-9]+", "", names), said, main, len(self.blocks), [], [], 0])
        self.count[tag] = self.count.get(tag, 0) + 1

    def _named(self, tag: str, values: dict[str, str], names: str) -> tuple[bool, bool]:
        """Whether an element is no article by what it and those around it are called, and whether it is one."""
        up = self.open[-1] if self.open else [None, "", False, False]
        if not self.names:
            return up[2] or tag in UNSEEN, False
        inner_header = tag == "header" and up[3]
        said = up[2] or (tag in SKIP and not inner_header) or "hidden" in values or values.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", values.get("style", "")))
        if not said and tag not in ("html", "body", "main", "article"):
            marks = WORDS - {"header"} if up[3] else WORDS  # an article's own header holds its title
            said = bool(marks & set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))) and not inner_header
        if not said and tag == "article":  # readers' comments are often articles
            said = bool({"comment", "comments", "reply"} & set(re.findall(r"[a-z]+", names.lower())))
        return said, not said and (up[3] or tag in ("article", "main") or values.get("role") in ("main", "article"))

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if tag == "a":
            self.link = False
        if tag not in BLOCK or not self.count.get(tag):
            return
        while self.open[-1][0] != tag:
            self._end()
        self._end()

    def handle_data(self, data) -> None:
        self.text.append(data)
        if not self.link and not data.isspace():
            self.plain = True


def parsed(pages: DataFrame, names: bool = True) -> DataFrame:
    """(page_id, url, host, article, blocks, trees) of every page."""

    def run(batches):
        for batch in parts(batches):
            article, blocks, trees = [], [], []
            for host, html in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page = Page(html or "", names)
                article.append(page.article())
                blocks.append([{"text": t, "said": s, "main": m} for t, s, m in page.blocks])
                trees.append([{"h": h, "main": m, "a": a, "z": z} for h, m, a, z in page.outside(host)])
            block = pa.list_(pa.struct([("text", pa.string()), ("said", pa.bool_()), ("main", pa.bool_())]))
            tree = pa.list_(pa.struct([("h", pa.int64()), ("main", pa.bool_()), ("a", pa.int32()), ("z", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(article, pa.int64()), pa.array(blocks, block), pa.array(trees, tree)], ["page_id", "url", "host", "article", "blocks", "trees"])

    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, host string, article long, blocks array<struct<text:string,said:boolean,main:boolean>>, trees array<struct<h:long,main:boolean,a:int,z:int>>")


def templates(rows: DataFrame) -> DataFrame:
    """(h): the subtrees of rows(host, article, trees) that recur on enough different pages of their host."""
    host = F.xxhash64("host").alias("host")
    trees = rows.select(host, "article", F.explode("trees").alias("t")).select("host", "article", "t.h", "t.main")
    hosts = saved(rows.select(host, "article").distinct().groupBy("host").agg(F.count("*").alias("pages")), "hosts", rows)
    # a subtree counts once an article, nested in its like or on repeated pages
    seen = saved(trees.groupBy("h").agg(F.count("*").alias("times")).where(F.col("times") >= LEAST_PAGES).select("h"), "seen", rows)
    often = trees.join(sized_broadcast(seen, seen.count(), BROADCAST_ROWS), "h", "left_semi").distinct().groupBy("host", "h", "main").agg(F.count("*").alias("n"))
    bound = lambda least, share: (F.col("n") >= least) & (F.col("n") >= F.col("pages") * share)
    often = often.join(sized_broadcast(hosts, hosts.count(), BROADCAST_ROWS), "host")
    return often.where(F.when(F.col("main"), bound(INNER_PAGES, INNER_SHARE)).otherwise(bound(LEAST_PAGES, LEAST_SHARE))).select("h")


def _merged(first: np.ndarray, last: np.ndarray) -> list[dict]:
    """The ranges of blocks that ranges cover, without those inside others, so that many nested templates are one cut."""
    out: list[dict] = []
    for i in np.lexsort((-last, first)):
        if out and first[i] <= out[-1]["z"]:
            out[-1]["z"] = max(out[-1]["z"], int(last[i]))
        else:
            out.append({"a": int(first[i]), "z": int(last[i])})
    return out


def _cut(rows: DataFrame, found: DataFrame, held: int) -> DataFrame:
    """rows with cuts, the ranges of blocks that are template: looked up in the tasks while they may hold all templates, else by joins."""
    if found.count() > held:
        trees = rows.select("row", F.explode("trees").alias("t")).select("row", "t.*")
        cuts = trees.join(found, "h", "left_semi").groupBy("row").agg(F.collect_list(F.struct("a", "z")).alias("cuts"))
        return rows.drop("trees").join(cuts, "row", "left")
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(found.toArrow()["h"].to_numpy()))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("trees")
            trees, known = batch.column(at), shared.value
            flat = trees.flatten()
            h = flat.field("h").to_numpy(zero_copy_only=False)
            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
            ends = np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(trees.value_lengths().to_numpy(zero_copy_only=False))])]
            chosen = flat.filter(pa.array(hit))
            first, last = (chosen.field(c).to_numpy(zero_copy_only=False) for c in "az")
            cuts = [_merged(first[lo:hi], last[lo:hi]) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *batch.columns[at + 1 :], pa.array(cuts, kind)], [*(n for n in batch.schema.names if n != "trees"), "cuts"])

    fields = [f for f in rows.schema.fields if f.name != "trees"]
    spans = T.StructField("cuts", T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("z", T.IntegerType())])))
    return rows.mapInArrow(run, T.StructType([*fields, spans]))


def main_text(pages: DataFrame, names: bool = True, held: int = HELD_TEMPLATES) -> DataFrame:
    """(page_id, url, text, n_chars, n_template, n_named) of every row of pages(page_id, url, html, ...).

    White space in a block is one space, blocks are joined by an empty line. n_template blocks went because they recur
    on their host, n_named others for the names of elements; with names=False no names are looked at but those of scripts
    and styles. A null or empty html, or one without an article, gives an empty text; a null url is a host of its own
    name ''. Repeated rows come back repeated, other columns are not read, an empty table gives an empty one.
    """
    rows = saved(parsed(pages, names).withColumn("row", F.monotonically_increasing_id()), "parsed")
    found = saved(templates(rows).distinct(), "templates", rows)
    out = _cut(rows, found, held)
    cut = lambda i: F.coalesce(F.exists("cuts", lambda c: (c["a"] <= i) & (i < c["z"])), F.lit(False))
    out = out.withColumn("left", F.filter("blocks", lambda b, i: ~cut(i)))
    kept = F.filter("left", lambda b: ~b["said"])
    chosen = F.when(F.exists("blocks", lambda b: b["main"]), F.filter(kept, lambda b: b["main"])).otherwise(kept)
    out = out.withColumn("chosen", F.transform(chosen, lambda b: b["text"]))
    out = out.select("page_id", "url", F.array_join("chosen", "\n\n").alias("text"), (F.size("blocks") - F.size("left")).cast("long").alias("n_template"), (F.size("left") - F.size("chosen")).cast("long").alias("n_named"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template", "n_named")


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
