"""Operator 1: packing into optimal length buckets.

Documents are cut into sequences of at most ``longest`` tokens. The global histogram of sequence lengths has
``longest`` + 1 bars at most; dynamic programming over it chooses the upper bounds of ``buckets`` buckets so that
the padding over all sequences is least. Inside a bucket sequences are batched to a token budget.

Defined results: every document has a sequence, an empty or null text one of no tokens; rows that share an id are
packed each; null ids come first; a text of any length is cut into sequences; an empty table gives an empty table; other columns are not read. Only the last
batch of a bucket may be short.

At scale: the driver sees the histogram, bounded by ``longest``. Batches are numbered without a global sort: ranks
inside hash shards of a bucket, plus the sizes of the shards before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, parts_for, text_or_empty, written

LONGEST, BUCKETS, BUDGET = 2048, 16, 32_768


def bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over ascending distinct lengths, with the least total padding."""
    if not lengths:
        return []
    size, many = np.array(lengths, np.float64), np.array(counts, np.float64)
    below, tokens_below = np.r_[0, np.cumsum(many)], np.r_[0, np.cumsum(many * size)]
    # cost[i, j]: padding of lengths i..j-1 in one bucket that is as long as the last of them
    cost = np.r_[0, size][None, :] * (below[None, :] - below[:, None]) - (tokens_below[None, :] - tokens_below[:, None])
    cost[np.tril_indices(len(size) + 1)] = np.inf
    best, choices = cost[0], []
    best[0] = 0
    for _ in range(min(buckets, len(size)) - 1):
        total = best[:, None] + cost
        before = total.argmin(axis=0)
        new = total[before, np.arange(len(best))]
        before[0], new[0] = 0, 0
        keep = best <= new  # one bucket less does as well
        before = np.where(keep, -1, before)
        choices.append(before)
        best = np.where(keep, best, new)
    ends, j = [], len(size)
    for before in reversed(choices):
        if j and before[j] >= 0:
            ends.append(lengths[j - 1])
            j = int(before[j])
    if j:
        ends.append(lengths[j - 1])
    return ends[::-1]


def token_lengths(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every document."""
    shipped = tokens.ship(docs.sparkSession, tokens.load_spec(tokenizer))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        enc = tokens.encoder(shipped)
        n = [len(x) for x in enc.encode(part.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, "doc_id long, n_tokens long")


def pack(lengths: DataFrame, *, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per sequence of ``lengths`` (doc_id, n_tokens): doc_id, piece, start, n_tokens, bucket_len (what it
    is padded to), batch_id, slot (place in the batch)."""
    pieces = F.greatest(F.ceil(F.col("n_tokens") / longest), F.lit(1)).cast("long")
    cut = lengths.select("doc_id", F.col("n_tokens").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    cut = cut.select("doc_id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.col("whole") - F.col("piece") * longest, F.lit(longest)).cast("long").alias("n_tokens"))
    bars = sorted((r.n_tokens, r.n) for r in cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    tops = bounds([x for x, _ in bars], [n for _, n in bars], buckets)

    bucket = F.lit(None).cast("int")
    for k in reversed(range(len(tops))):
        bucket = F.when(F.col("n_tokens") <= tops[k], k).otherwise(bucket)
    length = F.element_at(F.array(*[F.lit(t).cast("long") for t in tops] or [F.lit(0).cast("long")]), F.col("bucket") + 1)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(parts_for(lengths)))
    placed = cut.withColumn("bucket", bucket).withColumn("shard", shard)
    sizes = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens")) - 1
    ranked = placed.withColumn("inside", inside).join(before, ["bucket", "shard"]).withColumn("rank", F.col("before") + F.col("inside")).withColumn("bucket_len", length)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    return ranked.select("doc_id", "piece", "start", "n_tokens", "bucket_len", (F.col("bucket").cast("long") * (1 << 44) + F.floor(F.col("rank") / room)).cast("long").alias("batch_id"), F.pmod("rank", room).cast("long").alias("slot"))


def pack_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    return pack(written(token_lengths(docs, tokenizer), "lengths"), **options)
