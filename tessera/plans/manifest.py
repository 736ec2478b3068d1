"""From filtered source groups to the rows that renderers take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import in_order
from ..functions import paths
from ..operators import tree


def override(files: DataFrame, given: DataFrame, order: str) -> DataFrame:
    """``files`` (path) with those of an override's name replaced by the last such override of ``given`` (pkg, path);
    ``comment`` says whose it is and what it replaces. An override list is written by hand, and a broadcast if small enough
    for Spark to choose so."""
    last = given.withColumn("base", paths.basename(F.col("path"))).groupBy("base").agg(F.max_by(F.struct(F.col("path").alias("new"), F.col("pkg").alias("by")), order).alias("over"))
    both = files.withColumn("base", paths.basename(F.col("path"))).join(last, "base", "left")
    note = F.concat(F.lit("OVERRIDDEN from "), F.col("over.by"), F.lit(": "), F.col("path"))
    return both.withColumn("comment", F.when(F.col("over").isNotNull(), note)).withColumn("path", F.coalesce("over.new", "path")).drop("base", "over")


def render_groups(files: DataFrame, defines: DataFrame, dirs: DataFrame) -> DataFrame:
    """Rows for the renderers. ``files`` (grp, pos, pkg, target, path, comment), ``defines`` (grp, pos, name, value) and
    ``dirs`` (grp, dir): groups cut into runs of one file type."""
    typed = files.withColumn("file_type", paths.file_type(F.col("path")))
    run = tree.runs(typed, F.col("file_type"), ["pos"], ["grp"])
    lists = run.groupBy("grp", "run").agg(F.first("file_type").alias("file_type"), F.first("pkg").alias("pkg"), F.first("target").alias("target"), in_order(F.struct(F.col("path").alias("file"), "comment"), "pos").alias("files"))
    own = defines.groupBy("grp", "name").agg(F.min("pos").alias("pos"), F.max_by(F.struct("value"), "pos")["value"].alias("value")).groupBy("grp").agg(in_order(F.struct("name", "value"), "pos").alias("defines"))
    include = dirs.groupBy("grp").agg(F.array_sort(F.collect_set("dir")).alias("incdirs"))
    empty = F.expr("cast(array() as array<struct<name:string,value:string>>)")
    joined = lists.join(own, "grp", "left").join(include, "grp", "left")
    told = F.concat(F.lit("Package("), F.coalesce("pkg", F.lit("")), F.lit(") Target("), F.coalesce("target", F.lit("*")), F.lit(")"))
    return joined.select((F.col("grp") * (1 << 20) + F.col("run")).alias("no"), told.alias("metadata"), "file_type", F.coalesce("defines", empty).alias("defines"), F.coalesce("incdirs", F.expr("cast(array() as array<string>)")).alias("incdirs"), "files")
