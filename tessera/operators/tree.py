"""Source trees: inheritance down a tree of groups, flattening to an ordered list, runs of equal neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import cut


def by_level(nodes: DataFrame, first: dict[str, Column], down: dict[str, Column], key: str = "node", parent: str = "parent") -> DataFrame:
    """Columns computed from the root down: ``first`` for roots; ``down`` for children, over the child's own columns and
    the parent's computed ones as ``up.<name>``. One join a level; the depth of a source tree is small."""
    nodes = cut(nodes, "nodes")
    roots = nodes.where(F.col(parent).isNull())
    level = cut(roots.select("*", *[c.alias(n) for n, c in first.items()]), "level")
    done = level
    while True:
        up = level.select(F.col(key).alias("up_key"), F.struct(*first).alias("up"))
        level = cut(nodes.join(up, F.col(parent) == F.col("up_key")).select(nodes["*"], *[c.alias(n) for n, c in down.items()]), "level")
        if level.isEmpty():
            return done
        done = done.unionByName(level)


def preorder(nodes: DataFrame, pos: str = "pos", key: str = "node", parent: str = "parent") -> DataFrame:
    """``nodes`` with ``path``: positions from the root, whose order as arrays is the pre-order."""
    return by_level(nodes, {"path": F.array(F.col(pos).cast("long"))}, {"path": F.array_append(F.col("up.path"), F.col(pos).cast("long"))}, key, parent)


def surviving(nodes: DataFrame, holds: Column, key: str = "node", parent: str = "parent") -> DataFrame:
    """Nodes whose own condition and all whose ancestors' hold."""
    kept = by_level(nodes.withColumn("own", F.coalesce(holds, F.lit(False))), {"alive": F.col("own")}, {"alive": F.col("up.alive") & F.col("own")}, key, parent)
    return kept.where("alive").drop("own", "alive")


def runs(df: DataFrame, category: Column, order: list[str], within: list[str], stretch: Column | None = None) -> DataFrame:
    """``df`` with ``run``: number of the maximal stretch of equal categories it stands in; null equals null only.

    Where ``within`` may have few values with many rows, ``stretch`` (a number that does not fall in that order) deals the
    rows of one out: runs are numbered inside stretches, and what one leaves goes on to the next."""
    if stretch is None:
        w = Window.partitionBy(*within).orderBy(*order)
        fresh = F.row_number().over(w) == 1
        changed = fresh | ~F.lag(category).over(w).eqNullSafe(category)
        return df.withColumn("changed", changed.cast("long")).withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")
    rows = df.withColumns({"stretch_": stretch, "category_": F.struct(category.alias("c"))})
    inside = Window.partitionBy(*within, "stretch_").orderBy(*order)
    changed = ~F.coalesce(F.lag("category_").over(inside).eqNullSafe(F.col("category_")), F.lit(True))
    rows = rows.withColumn("changed", (changed & (F.row_number().over(inside) > 1)).cast("long")).withColumn("inner_", F.sum("changed").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*within, "stretch_").agg(F.sum("changed").alias("n"), F.min_by("category_", F.struct(*order)).alias("first"), F.max_by("category_", F.struct(*order)).alias("last"))
    over = Window.partitionBy(*within).orderBy("stretch_")
    broken = F.row_number().over(over) == 1
    broken = broken | ~F.lag("last").over(over).eqNullSafe(F.col("first"))
    parts = parts.withColumn("broken", broken.cast("long"))
    before = F.coalesce(F.sum(F.col("n")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("broken").over(over.rowsBetween(Window.unboundedPreceding, 0))
    placed = parts.select(*within, "stretch_", before.alias("before_"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*within, "stretch_")]
    joined = rows.alias("r").join(placed.alias("p"), same)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("p.before_") + F.col("r.inner_")).alias("run"))


def flatten(items: DataFrame) -> DataFrame:
    """Loose files into emitted groups. ``items`` (node, pos, is_group, independent, path): the children of groups in
    order. A stretch of files between two subgroups is one group; in an independent group all files are one group,
    after the subgroups. Adds ``run``."""
    w = Window.partitionBy("node").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    with_run = items.withColumn("run", F.when(F.col("independent"), F.lit(0)).otherwise(F.sum(F.col("is_group").cast("long")).over(w)))
    return with_run.where("NOT is_group")
