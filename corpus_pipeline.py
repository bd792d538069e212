"""A training corpus in five stages: quality, near-duplicates, personal data, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import mixing, neardup, packing, pii, quality
from lethe.llm.work import saved


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling towards the good labelled ones draws."""
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near-duplicates the document of the smallest doc_id (nulls last); of rows equal in doc_id and text one.

    Rows are told apart by doc_id and text, so neither a doc_id that several texts share nor a null one loses a text.
    """
    keyed = docs.withColumn("nd_key", F.xxhash64("doc_id", "text", F.col("doc_id").isNull(), F.col("text").isNull()))
    second = F.xxhash64(F.lit(1), "doc_id", "text", F.length("text"))
    ids = saved(keyed.groupBy("nd_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("nd_id"), F.min(second) == F.max(second), F.count("*").alias("times")).toDF("nd_key", "nd_id", "one", "times"), "ids")
    groups = neardup.near_duplicates(keyed.select(F.col("nd_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("nd_key"), "component_id").distinct()
    first = groups.join(ids, "nd_key").groupBy("component_id").agg(F.min(F.struct("nd_id", "nd_key")).alias("first")).select(F.col("first.nd_key").alias("nd_key"))
    # a key of two texts (their hashes being equal by chance) keeps all its rows
    kept = saved(ids.join(first.union(ids.where("not one").select("nd_key")).distinct(), "nd_key").select("nd_key", (F.col("one") & (F.col("times") > 1)).alias("again")), "kept")
    again = saved(kept.where("again").select("nd_key"), "again")
    once = kept.where("not again").select("nd_key")
    held = lambda keys: keyed.join(neardup.sized_broadcast(keys, keys.count(), neardup.BROADCAST_IDS), "nd_key", "left_semi")
    return held(once).unionByName(held(again).dropDuplicates(["nd_key"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace identifiers and what discloses them."""
    return pii.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw half of the tokens by the target weights of domains, languages and sources."""
    return mixing.mixed(docs, mixing.source_domain(), tuple(w() for w in mixing.WEIGHTS), mixing.half, mixing.MAX_EPOCHS, mixing.SEED)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences of the permitted lengths; a row a piece, with its text."""
    return packing.pack(docs, carry=("text",))


STAGES = [
    ("quality classifier", select_quality),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", remove_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first two stages cannot be stated in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each over a written table of what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs, f"stage{i}") if i < len(STAGES) - 1 else docs
    return docs
