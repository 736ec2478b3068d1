"""States of locked packages against what their repositories offer and their parents ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, semver


def states(locked: DataFrame, available: DataFrame, parents: DataFrame, *, ignore_sources: bool = False, only_update: bool = False) -> DataFrame:
    """(pkg, state, current, highest, compatible), a row for each state a package is in.

    ``locked`` (pkg, rev, version), ``available`` (pkg, version), ``parents`` (pkg, parent, parent_pos, constraint,
    source). Sources are compared in one form: paths without ``.`` and ``..``, so two ways to one folder are no conflict, and
    an address as it is. Conflict: a constraint that is no version range and differs from the first parent's, or a source that does.
    """
    parents = parents.withColumn("source", paths.source_form(F.col("source"))).withColumn("parsed", semver.requirement(F.col("constraint")))
    is_range = F.col("parsed").isNotNull()
    first = Window.partitionBy("pkg").orderBy("parent_pos")
    odd = (~is_range & (F.col("constraint") != F.first("constraint").over(first))) | (F.lit(not ignore_sources) & (F.col("source") != F.first("source").over(first)))
    asked = parents.withColumn("odd", odd).groupBy("pkg").agg(F.bool_or("odd").alias("conflict"), F.bool_or(is_range).alias("req"), F.count_if(is_range).alias("n"))
    highest = available.groupBy("pkg").agg(F.max("version").alias("hi"))
    fits = parents.where(is_range).join(available.distinct(), "pkg").where(semver.matches(F.col("version"), F.col("parsed")))
    most = fits.groupBy("pkg", "version").agg(F.count_distinct("parent").alias("k")).join(asked.select("pkg", "n"), "pkg").where("k = n").groupBy("pkg").agg(F.max("version").alias("mc"))
    rows = locked.select("pkg", "rev", F.col("version").alias("cur")).join(asked, "pkg", "left").join(highest, "pkg", "left").join(most, "pkg", "left").fillna(False, ["conflict", "req"])
    cur, hi, mc = F.col("cur"), F.col("hi"), F.col("mc")
    tests = {
        "conflict": F.col("conflict"),
        "path": cur.isNull() & F.col("rev").isNull(),
        "hash": (cur.isNull() | ~F.col("req")) & F.col("rev").isNotNull(),
        "up-to-date": F.col("req") & (hi == cur) & F.lit(not only_update),
        "auto-update": F.col("req") & (mc > cur),
        "update": F.col("req") & (hi > cur) & (mc.isNull() | (mc < hi)),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return rows.select("pkg", F.explode(found).alias("state"), cur.alias("current"), hi.alias("highest"), mc.alias("compatible"))


def lock_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, old, new) of packages whose revision changed, that came or went; ``old`` and ``new`` have name, revision,
    version. Shown is the version, else the revision, else that it is a path. Paths that only move are not told."""
    shown = lambda side: F.coalesce(F.col(f"{side}.version"), F.col(f"{side}.revision"), F.when(F.col(f"{side}.here"), "path"), F.lit(""))
    both = old.withColumn("here", F.lit(True)).alias("o").join(new.withColumn("here", F.lit(True)).alias("n"), "name", "full_outer")
    changed = ~F.col("o.revision").eqNullSafe(F.col("n.revision")) | F.col("o.here").isNull() | F.col("n.here").isNull()
    return both.where(changed).select("name", shown("o").alias("old"), shown("n").alias("new"))


def parents_of(locked: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((dep, parent, constraint, source), warnings): who needs a package by the lock (src, dst) and what its manifest says
    (parent, dep, constraint, source); a parent whose manifest does not name it is stale, told as W17."""
    edges = locked.select(F.col("src").alias("parent"), F.col("dst").alias("dep")).distinct()
    found = edges.join(declared, ["parent", "dep"]).select("dep", "parent", "constraint", "source")
    stale = edges.join(declared.select("parent", "dep"), ["parent", "dep"], "left_anti").select(F.col("parent").alias("subject")).distinct()
    told = stale.select("subject", F.lit("W17").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("the manifest and the lock differ on "), "subject").alias("message"))
    return found, told


def counts(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """(packages, width, needs): how many packages there are, the widest name, and how many dependencies."""
    own = packages.agg(F.count("*").alias("packages"), F.max(F.char_length("name")).alias("width"))
    return own.crossJoin(edges.agg(F.count("*").alias("needs")))  # one row each


def listed(ranks: DataFrame, lock: DataFrame, root: str | None = None) -> DataFrame:
    """(place, name, rank, version) of the packages of a lock (name, version), highest rank first; with ``root`` that package
    comes last, without a version."""
    rows = lock.join(ranks.withColumnRenamed("pkg", "name"), "name").select("name", "rank", "version")
    if root is not None:
        rows = rows.unionByName(rows.sparkSession.createDataFrame([(root, -1, None)], "name string, rank long, version string"))
    return rows.select(F.row_number().over(Window.orderBy(F.desc("rank"), "name")).alias("place"), "name", "rank", "version")
