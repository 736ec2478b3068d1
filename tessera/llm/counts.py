"""Operator 9: token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, count). A call joins the digests of its
documents to it, encodes one document of each digest that is missing, appends those counts and joins again.
Content is digested exactly as it is encoded (null as empty): any other normal form would change counts.

Defined results: null and empty texts have 0 tokens; texts of any length are counted whole; repeated rows each get
their own output row; null ids stay null; an empty table gives an empty table; columns other than id and text are not
read.

At scale: copies of a text collapse to digests before any text moves. Where the missing digests are few enough to
broadcast, texts are encoded where they are read and nothing moves; none missing, no text is read again. Beyond, texts
shuffle by document id and digest. Digests that a large part of all rows have are joined without a shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import BROADCAST_ROWS, arrow_map, join_counted, text_or_empty, written

CACHE = "digest string, tokenizer string, n_tokens long"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        found = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)
    return found


def token_counts(docs: DataFrame, tokenizer: str, cache: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens); appends what it had to encode to ``cache``."""
    spark = docs.sparkSession
    spec = tokens.load_spec(tokenizer, pattern)
    version, shipped = tokens.spec_digest(spec), tokens.ship(spark, spec)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    keyed = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"))
    digests = written(keyed, "digests")
    distinct = written(digests.groupBy("digest").agg(F.min("doc_id").alias("chosen"), F.count("*").alias("n")), "digest-keys")

    known = lambda: read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    misses = written(distinct.join(known().select("digest"), "digest", "left_anti").select("chosen", F.col("digest").alias("wanted")), "misses")
    n_misses = misses.count()
    if n_misses:
        by_id = misses.where("chosen IS NOT NULL").select("chosen")
        by_id = F.broadcast(by_id) if n_misses <= BROADCAST_ROWS else by_id.hint("shuffle_hash")
        digested = texts.select("doc_id", "text").withColumn("wanted", F.sha2("text", 256))
        # rows that share an id with a chosen one are encoded too; rows without an id are found by their digests
        to_do = texts.join(by_id, F.col("doc_id") == F.col("chosen")).select(F.sha2("text", 256).alias("wanted"), "text")
        to_do = to_do.unionByName(digested.where("doc_id IS NULL").join(misses.where("chosen IS NULL").select("wanted"), "wanted").select("wanted", "text"))

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            enc = tokens.encoder(shipped)
            n = [len(x) for x in enc.encode(part.column(1).to_pylist())]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

        counted = arrow_map(to_do, run, "digest string, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        counted = counted.join(misses.select(F.col("wanted").alias("digest")), "digest", "left_semi")
        counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    told = written(distinct.join(known(), "digest").select("digest", "n_tokens", "n"), "token-counts")
    return join_counted(digests, told, "digest", "n").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
