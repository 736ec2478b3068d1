"""The queries of this subpackage: each operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, counts, exact, html_text, near, packing, pii, quality, records, vectors


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents")).withColumn("own", F.filter("found", lambda x: x["base"]))
    counted = [F.expr(f"CAST(size(filter(own, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counted, F.sha2(_listed("own"), 256).alias("base_sha256"), _listed("found").alias("spans"))


def base_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 5 tells of the base detectors, which SQL can say."""
    return op5_pii(spark, sf_dir).drop("spans")


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked(_table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks, public_tokenizers.PATTERN).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), common.shared_folder(spark, "token-cache"))


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_folder(spark, "records")
    records.write(_table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"))
    rows = records.read(spark, path).select("shard", "offset", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(records.starts(spark, path), ["shard", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_html_text": op2_html_text,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii": op5_pii,
    "op6_embedding_links": op6_embedding_links,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_records": op10_records,
    "base_identifiers": base_identifiers,
}

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": exact.ORACLE, "op6_embedding_links": vectors.ORACLE, "base_identifiers": pii.BASE_ORACLE}
