"""From files to text units, by what the files are."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import SPACE
from ..functions.limits import Limits
from ..functions.text import base_name, needs_ocr
from ..sources import docx, files
from ..sources.shared import staged

PAGES = "array<struct<page:int,text:string,ocr:boolean>>"
ROWS = "tag string, unit_id int, page int, text string, kind string, error string, pages int, ocr_pages int, notices array<string>, unpacked long"
_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int64()]


class Extracted(NamedTuple):
    """units(doc_id, unit_id, page, text), refused(doc_id, error), meta(doc_id, kind, pages, ocr_pages, notices, unpacked) of what is not refused."""

    units: DataFrame
    refused: DataFrame
    meta: DataFrame


def _rows(kind: str | None, error: str | None, content: bytes | None, pages: list | None, name: str, most: int) -> list[tuple]:
    """The rows of one file without its id: its units, if it is not refused, and one for itself."""
    said, size, found = [], 0, []
    if kind == "docx" and not error:
        own, error, said, size = docx.read(content or b"")
        found = [(None, text, False) for _, _, text in own]
    elif not error:
        found = [(p["page"], p["text"], p["ocr"]) for p in pages or []]
        error = "too_many_pages" if len(found) > most else None
    if not error and not any(re.search(f"[^{SPACE}]", text or "") for _, text, _ in found):
        error = "no_text"
    units = [] if error else [*found, (None, name, False)]
    numbers = {page for page, _, _ in found if page is not None}
    seen = {page for page, _, ocr in found if ocr}
    return [*(("unit", i, page, text, None, None, None, None, None, None) for i, (page, text, _) in enumerate(units)), ("file", None, None, None, kind, error, len(numbers), len(seen), said, size)]


def extract(inputs: DataFrame, readers: dict[str, Callable[[Column], Column]] | None = None) -> Extracted:
    """The units of inputs(doc_id, file_name, content) and, if there is one, error, the reason why a file was not read.

    Units are those of Word files, what ``readers`` (those registered, unless given) give for other kinds, and last each file's name, without a page.
    Refused is what cannot be read, is too large, has too many pages or no text at all. One pass opens each file once and
    writes tagged rows to the shared folder; the three tables are parts of what was written.
    """
    limits, readers = Limits.of(inputs.sparkSession), files.READERS if readers is None else readers
    known = F.col("error") if "error" in inputs.columns else F.lit(None).cast("string")
    large = F.coalesce(F.length("content") > limits.max_file, F.lit(False))
    rows = inputs.withColumn("x", files.sniffed(F.col("content"))).withColumn("e", F.coalesce(known, F.when(large, F.lit("too_large")), F.col("x.error")))
    kind = F.col("x.kind")
    read = F.lit(None).cast(PAGES)
    for name, reader in readers.items():
        own = (kind == name) & F.col("e").isNull()
        read = F.when(own, reader(F.when(own, F.col("content")))).otherwise(read)  # a reader in Python sees other rows too, as nulls
    unread = kind.isin("pdf", "image") & ~kind.isin(list(readers))
    error = F.coalesce("e", F.when(unread, F.lit("no_reader")))
    rows = rows.select("doc_id", kind.alias("kind"), error.alias("error"), F.when((kind == "docx") & error.isNull(), F.col("content")).alias("content"), read.alias("pages"), base_name(F.col("file_name")).alias("name"))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                doc_id, *own = (batch.column(c)[i].as_py() for c in batch.schema.names)
                made = _rows(*own, limits.max_pages)
                ids = pa.array([doc_id] * len(made), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[j] for r in made], t) for j, t in enumerate(_TYPES))], ["doc_id", *(c.split(" ")[0] for c in ROWS.split(", "))])

    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ROWS}"
    tagged = staged(rows.mapInArrow(run, shape), "extracted")
    own = tagged.where("tag = 'file'")
    return Extracted(
        tagged.where("tag = 'unit'").select("doc_id", "unit_id", "page", "text"),
        own.where("error is not null").select("doc_id", "error"),
        own.where("error is null").select("doc_id", "kind", "pages", "ocr_pages", "notices", "unpacked"),
    )


def doc_meta(kinds: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, kind, pages, ocr_pages) of kinds(doc_id, kind) and the pages of units(doc_id, page, text), by how the texts look."""
    pages = units.where("page is not null").groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.count_if(needs_ocr(F.col("text"))).alias("ocr_pages"))
    return kinds.join(pages, "doc_id", "left").select("doc_id", "kind", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("ocr_pages", F.lit(0)).alias("ocr_pages"))
