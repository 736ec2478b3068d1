"""Small helpers over DataFrames that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``. Without that setting a local master (tests) gets one
    under /tmp; on a cluster it is an error, since each executor would write to its own disk."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Removes every table that this application wrote to the shared folder; frames made from them cannot be read after."""
    remove(spark, shared_path(spark, "x").rsplit("/", 1)[0])


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: the loop's lineage ends here and a lost executor costs
    nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(value: Column | str, *keys: Column | str) -> Column:
    """Aggregate: the values as an array in the order of ``keys``. collect_list alone has no order."""
    value = F.col(value) if isinstance(value, str) else value
    sortable = F.struct(*[F.col(k).alias(f"k{i}") if isinstance(k, str) else k.alias(f"k{i}") for i, k in enumerate(keys)], value.alias("value"))
    return F.transform(F.array_sort(F.collect_list(sortable)), lambda x: x["value"])


def last_wins(df: DataFrame, key: list[str], value: str, pos: str) -> DataFrame:
    """An ordered map: one row a key, at its first position with its last value. A null value is a value."""
    return df.groupBy(*key).agg(F.min(pos).alias(pos), F.max_by(F.struct(value), pos)[value].alias(value))
