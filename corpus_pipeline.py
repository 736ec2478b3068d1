"""The corpus pipeline: documents through five stages, each stage's rows written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact, near, packing, pii, quality
from tessera.llm.common import broadcast_if_small, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows that are not held out, does not reject. Null and empty
    texts get the score of the bias; repeated rows are judged each; nulls in other columns and rows without an id stay as
    they are; very long texts are scored whole; an empty table gives an empty table; other columns go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs.select(COLUMNS), model)


def _without(docs: DataFrame, ids: DataFrame, how: str = "left_anti") -> DataFrame:
    ids = broadcast_if_small(ids.select(F.col("doc_id").alias("listed")))
    return docs.select(COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("listed")), how).select(COLUMNS)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id. Rows that share an id are told apart by the digests of their texts, and
    of rows that share both, one stays. Null texts equal empty ones; null ids are the smallest; long texts are compared
    whole; an empty table gives an empty table; other columns go."""
    judged = written(exact.exact_duplicates(docs).select("doc_id", "kept", "text_sha256"), "judged")
    ids = written(judged.groupBy("doc_id").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n")), "judged-ids")
    once = _without(docs, ids.where("NOT stays OR n > 1"))
    shared = ids.where("stays AND n > 1")
    again = _without(docs, shared, "left_semi").withColumn("sha", F.sha2(F.translate(F.coalesce("text", F.lit("")), exact.UPPER, exact.LOWER), 256))
    kept = judged.where("kept").join(shared.select(F.col("doc_id").alias("shared")), F.col("doc_id").eqNullSafe(F.col("shared")), "left_semi").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    again = again.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")), "left_semi").dropDuplicates(["doc_id", "sha"])
    return once.unionByName(again.select(COLUMNS))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates. Null and empty texts, and rows without an
    id, are no one's duplicates and stay; rows that share an id stay or go together; long texts are compared whole; an
    empty table gives an empty table; other columns go."""
    return _without(docs, near.groups(docs).where("NOT kept").select("doc_id").distinct())


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers masked in every text; n_chars follows the text. Null texts stay null and empty ones empty; every row
    stays, repeated ones too; long texts are read whole; an empty table gives an empty table; other columns go."""
    return pii.redact(docs.select(COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of every document in length buckets and batches. Null and empty texts are one sequence without tokens,
    long ones several; repeated rows and rows without an id are packed each; ties of length share a bucket; an empty table
    gives an empty table; other columns are not read."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("exact_dedup", no_copies),
    ("near_dedup", no_near_copies),
    ("pii", no_personal_data),
    ("packing", packed),
]

#: A trained classifier, near duplicates and tokens are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
