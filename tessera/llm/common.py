"""What the operators of this subpackage share: shared folders, Arrow slices, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..frames import remove, shared_path
from ..shipping import ship_package

#: Rows of text handled at once inside a Python task; bounds its memory whatever the Arrow batch holds.
SLICE_ROWS = 256


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, in this application's folder, which ``frames.clean`` removes."""
    return shared_path(spark, name)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``fn`` applied to slices of at most ``rows`` rows, in Arrow form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            yield fn(part)

    return arrow_batches(df, run, schema)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of long texts are held several times over, in the executor and in Python: where the session has
    Spark's own limits, lower ones are set."""
    for key, usual, wanted in (("spark.sql.execution.arrow.maxRecordsPerBatch", ("10000",), "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b",), "4194304b")):
        if spark.conf.get(key) in usual:
            spark.conf.set(key, wanted)


def arrow_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Arrow's own pools keep what is freed, and workers live on
        pa.set_memory_pool(pa.system_memory_pool())
        return fn(batches)

    return df.mapInArrow(run, schema)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def parts_for(df: DataFrame, name: str = "spark.sql.shuffle.partitions") -> int:
    return int(df.sparkSession.conf.get(name))


#: Rows of one or two longs up to which a side is broadcast: 32 MB.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` (a few longs a row), written, and broadcast if its count allows; larger ones are joined by shuffling."""
    df = written(df, "keys")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: A key that holds more than this part of a partition's share of rows is joined where its rows are.
HOT_PART = 4


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` to ``keyed``, which has one row a key and in ``weight`` how many rows that key has. Hot
    keys, of which there can be HOT_PART for each partition at most, are broadcast, so that no task gets all rows of one;
    the rest shuffles. Both sides are read twice: hand in written tables."""
    parts = parts_for(rows)
    total, most = keyed.agg(F.sum(weight), F.max(weight)).first()
    limit = max(1, (total or 0) // (HOT_PART * parts))
    if (most or 0) <= limit:
        return rows.join(keyed, key)
    hot = keyed.where(F.col(weight) > limit)
    keys = hot.select(key)
    cold = rows.join(F.broadcast(keys), key, "left_anti").join(keyed.join(F.broadcast(keys), key, "left_anti"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate from file sizes; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least point that each of ``n`` points reaches over the edges (u, v), inside one task."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        if not len(u):
            break
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label != (up := label[label])).any():
            label = up
    return label


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Alternates large-star and small-star: each round only rewires edges towards smaller nodes, so there are
    never more edges than at first, and no neighbourhood is gathered in one row. Each round is written to the
    shared folder. Raises if ``rounds`` (logarithmic in practice) do not suffice, rather than give a wrong answer.
    """
    spark = edges.sparkSession

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_folder(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema("u long, v long").parquet(path), path

    now, path = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    sums = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    before = now.agg(*sums).first()
    for _ in range(rounds):
        # nodes are at most twice as many as edges; a hub has many, and a join by nodes would bring them to one task
        side = F.broadcast if 2 * before["n"] <= BROADCAST_ROWS else lambda df: df
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(side(least), "u")
        now = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now, new = keep(now)
        remove(spark, path)
        path, after = new, now.agg(*sums).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
