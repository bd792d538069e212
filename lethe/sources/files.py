"""Files by content: type, limits, names, and what needs a library that is not part of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.limits import Limits
from ..functions.text import base_name

#: Readers of other formats by kind: content BINARY -> array<struct<page:int,text:string,ocr:boolean>>. None are built in.
READERS: dict[str, Callable[[Column], Column]] = {}
#: Detectors by name: (chunks DataFrame) -> DataFrame(doc_id, ord, type, text, refers_to). None are built in.
CANDIDATE_SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content and error of all files: one above the size limit is not read, and has no content but the error too_large."""
    found, most = spark.read.format("binaryFile").load(path), Limits.of(spark).max_file
    plain = ["path", "modificationTime", "length"]
    fits = found.where(F.col("length") <= most).select(*plain, "content", F.lit(None).cast("string").alias("error"))
    return fits.unionByName(found.where(F.col("length") > most).select(*plain, F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("error")))


def sniffed(content: Column) -> Column:
    """struct<kind, mime, ext, error> from the first bytes, never from the name."""
    head = F.hex(F.substring(content, 1, 1024))
    latin = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    word = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    kind = lambda k, mime, ext: F.struct(F.lit(k).alias("kind"), F.lit(mime).alias("mime"), F.lit(ext).alias("ext"), F.lit(None).cast("string").alias("error"))
    error = lambda e: F.struct(*(F.lit(None).cast("string").alias(c) for c in ("kind", "mime", "ext")), F.lit(e).alias("error"))
    return (
        F.when(latin.contains("%PDF-"), kind("pdf", "application/pdf", "pdf"))
        .when(head.startswith("504B0304"), kind("docx", word, "docx"))
        .when(head.startswith("D0CF11E0"), error("old_word"))
        .when(head.startswith("89504E47"), kind("image", "image/png", "png"))
        .when(head.startswith("FFD8FF"), kind("image", "image/jpeg", "jpg"))
        .when(latin.startswith("RIFF") & (F.substring(latin, 9, 4) == "WEBP"), kind("image", "image/webp", "webp"))
        .when(F.substring(latin, 5, 12).rlike("ftyp(heic|heix|mif1|hevc)"), error("heic"))
        .otherwise(error("unknown_type"))
    )


def file_name_units(files: DataFrame, unit_id: Column | int = 0) -> DataFrame:
    """(doc_id, unit_id, page, text): the name of files(doc_id, file_name) as a text unit without a page."""
    at = F.lit(unit_id) if isinstance(unit_id, int) else unit_id
    return files.select("doc_id", at.alias("unit_id"), F.lit(None).cast("int").alias("page"), base_name(F.col("file_name")).alias("text"))


def text_units(table: DataFrame, doc_id: str, unit_id: Column, page: Column, text: str) -> DataFrame:
    """units(doc_id, unit_id, page, text) from a table of texts."""
    return table.select(F.col(doc_id).alias("doc_id"), unit_id.cast("int").alias("unit_id"), page.cast("int").alias("page"), F.col(text).alias("text"))
