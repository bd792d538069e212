"""Progress and results as one JSON object a line, and a log that holds counts and error classes only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .shared import staged

EVENT = "doc_id long, type string, stage string, done int, total int, position int, findings string, name string, mime string, base64 string, removed long, message string"
#: Stages of a job, in order.
STAGES = ("reading", "detecting", "applying", "checking")
#: Why a file or document is refused.
ERRORS = ("unknown_type", "old_word", "heic", "no_reader", "too_large", "too_large_unpacked", "too_complex", "too_many_pages", "not_word", "damaged", "no_text", "leak")


def file_events(results: DataFrame) -> DataFrame:
    """(value): the result event of results(doc_id, name, mime, content, removed)."""
    fields = [F.col("doc_id"), F.lit("file").alias("type"), F.col("name"), F.col("mime"), F.base64("content").alias("base64"), F.col("removed")]
    return results.select(F.to_json(F.struct(*fields)).alias("value"))


def finding_events(findings: DataFrame) -> DataFrame:
    """(value): one event a document with its findings(doc_id, label, type, texts, count, pages)."""
    own = F.array_sort(F.collect_list(F.struct("label", "type", "texts", "count", "pages")))
    return findings.groupBy("doc_id").agg(own.alias("findings")).select(F.to_json(F.struct("doc_id", F.lit("findings").alias("type"), "findings")).alias("value"))


def progress_events(chunks: DataFrame, recall: bool) -> DataFrame:
    """(value): the event that opens a document's detection, with the number of chunks to be read in one or two passes."""
    total = chunks.groupBy("doc_id").agg((F.count("*") * (2 if recall else 1)).cast("int").alias("total"))
    return total.select(F.to_json(F.struct("doc_id", F.lit("progress").alias("type"), F.lit(STAGES[1]).alias("stage"), F.lit(0).alias("done"), "total")).alias("value"))


def error_events(failed: DataFrame) -> DataFrame:
    """(value): the error event of failed(doc_id, error)."""
    return failed.select(F.to_json(F.struct("doc_id", F.lit("error").alias("type"), F.col("error").alias("message"))).alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").text(path)


def ended_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the lines of uncompressed files, without a last one that no line feed ends, which its writer may still be at.

    Files are read in whatever ranges Spark cuts them into. A file's lines with their line feeds are as long as the file, or
    one byte longer if the last is not ended; that one is the line that begins furthest back.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    rows = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        (F.octet_length("value") + 1).cast("long").alias("bytes"),
        "value",
    )
    rows = staged(rows, "lines")
    whole = rows.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.max("size").alias("size"), F.max(F.struct("block", "at")).alias("last"))
    torn = whole.where("bytes > size").select("file", F.col("last.at").alias("at"))
    return rows.join(torn, ["file", "at"], "left_anti").select("file", "value")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of ended lines; a line that is no event is a row of nulls, a blank one none."""
    lines = ended_lines(spark, path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", EVENT).alias("e")).select("e.*")


def logged(results: DataFrame, log: Observation, error: Column | None = None, removed: Column | None = None) -> DataFrame:
    """results, of which an action leaves counts in the log: rows, rows by error class, and what was removed.

    Only the classes in ERRORS are counted by name, others together, so no text or name of a document can become part of the log.
    """
    kind = F.lit(None).cast("string") if error is None else error
    each = [F.count_if(kind == e).alias(e) for e in ERRORS]
    other = F.count_if(kind.isNotNull() & ~kind.isin(*ERRORS)).alias("other")
    total = F.coalesce(F.sum(F.lit(0) if removed is None else removed), F.lit(0)).cast("long").alias("removed")
    return results.observe(log, F.count(F.lit(1)).alias("rows"), *each, other, total)


def log_rows(spark: SparkSession, log: Observation) -> DataFrame:
    """(measure, n) of a log whose action has ended."""
    return spark.createDataFrame([(k, int(v)) for k, v in log.get.items()], "measure string, n long")
