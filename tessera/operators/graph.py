"""Closures and ranks of directed graphs, over edge tables (src, dst).

A graph of at most SMALL_EDGES edges, counted, is walked in one task in time proportional to its size, whatever its depth:
package graphs are of that kind. Larger ones are walked by frontier loops: each round joins the frontier to the edges and
keeps one row a node, so work follows edges, not paths; rounds are appended to one table in the shared folder, where
their lineage ends. Only counts come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..frames import cut, shared_path
from ..shipping import ship_package

#: Edges up to which one task holds a graph: some 100 MB.
SMALL_EDGES = 500_000

Links = list[list[int]]


class CycleError(ValueError):
    """The graph has a cycle; the message names nodes on or behind it."""


def _in_one_task(edges: DataFrame, starts: DataFrame, walk: Callable[[Links, Links, list[int]], list[tuple[int, int]]]) -> DataFrame:
    """(node, value) of ``walk`` over the links out of and into each node, and the starting nodes; nodes of any type."""
    ship_package(edges.sparkSession)
    kind = starts.schema["node"].dataType
    rows = edges.select("src", "dst").unionByName(starts.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst")))
    same = lambda v: tuple(v.values()) if isinstance(v, dict) else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict = {}
        nodes: list = []
        out: Links = []
        into: Links = []

        def of(v) -> int:
            i = number.setdefault(same(v), len(nodes))
            if i == len(nodes):
                nodes.append(v)
                out.append([])
                into.append([])
            return i

        begin, schema = [], None
        for batch in batches:
            schema = batch.schema
            for s, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if d is None:
                    begin.append(of(s))
                else:
                    a, b = of(s), of(d)
                    out[a].append(b)
                    into[b].append(a)
        found = walk(out, into, begin)
        for start in range(0, len(found), 10_000):
            part = found[start : start + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in part], schema.field(0).type), pa.array([v for _, v in part], pa.int64())], ["node", "value"])

    return rows.coalesce(1).mapInArrow(run, StructType([StructField("node", kind), StructField("value", LongType())]))


def _reach(out: Links, begin: list[int]) -> list[int]:
    seen, order = set(begin), list(dict.fromkeys(begin))
    for i in order:  # grows while it is walked
        for j in out[i]:
            if j not in seen:
                seen.add(j)
                order.append(j)
    return order


def _walk_closure(out: Links, into: Links, begin: list[int]) -> list[tuple[int, int]]:
    return [(i, 0) for i in _reach(out, begin)]


def _walk_ranks(out: Links, into: Links, begin: list[int]) -> list[tuple[int, int]]:
    """Ranks of what the roots reach, peeled by open links; -1 on or behind a cycle."""
    reached = _reach(out, begin)
    inside = set(reached)
    left = {i: sum(p in inside for p in into[i]) for i in reached}
    rank = {i: 0 for i in reached if not left[i]}
    order = list(rank)
    for i in order:
        for j in out[i]:
            left[j] -= 1
            rank[j] = max(rank.get(j, 0), rank[i] + 1)
            if not left[j]:
                order.append(j)
    return [(i, rank[i] if not left[i] else -1) for i in reached]


def _walk_cycles(out: Links, into: Links, begin: list[int]) -> list[tuple[int, int]]:
    gone: set[int] = set()
    for links, back in ((out, into), (into, out)):
        left = [sum(j not in gone for j in back[i]) for i in range(len(back))]
        todo = [i for i, n in enumerate(left) if not n and i not in gone]
        for i in todo:
            gone.add(i)
            for j in links[i]:
                left[j] -= 1
                if not left[j] and j not in gone:
                    todo.append(j)
    return [(i, 0) for i in range(len(out)) if i not in gone]


def closure(edges: DataFrame, start: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Nodes reachable from ``start`` (node), itself included. Excluded nodes are neither kept nor crossed."""
    if exclude is not None:
        start = start.join(exclude, "node", "left_anti")
        edges = edges.join(exclude, edges["dst"] == exclude["node"], "left_anti")
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    start = start.select("node").distinct()
    if edges.count() <= SMALL_EDGES:
        return _in_one_task(edges, start, _walk_closure).select("node")
    spark, path = edges.sparkSession, shared_path(edges.sparkSession, "closure")
    frontier = cut(start, "frontier")
    while True:
        frontier.write.mode("append").parquet(path)
        seen = spark.read.schema(frontier.schema).parquet(path)
        reached = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen


def _cyclic(nodes: DataFrame) -> CycleError:
    return CycleError(f"the graph has a cycle through or before {', '.join(str(r.node) for r in nodes.orderBy('node').limit(5).collect())}")


def ranks(edges: DataFrame, roots: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, rank): the length of the longest path from a root; nodes that no root reaches have 0. A cycle that a root
    reaches is an error. Nodes are peeled once all that lead to them are ranked, so each edge is followed once."""
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    every = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).unionByName(roots.select("node"))
    every = (every.unionByName(nodes.select("node")) if nodes is not None else every).distinct()
    if edges.count() <= SMALL_EDGES:
        found = cut(_in_one_task(edges, roots.select("node").distinct(), _walk_ranks).select("node", F.col("value").alias("rank")), "ranks")
        looped = found.where("rank < 0").select("node")
    else:
        found, looped = _peeled(edges, roots)
    if not looped.isEmpty():
        raise _cyclic(looped)
    return every.join(found, "node", "left").select("node", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))


def _peeled(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    spark, path = edges.sparkSession, shared_path(edges.sparkSession, "levels")
    reached = closure(edges, roots.select("node"))
    edges = cut(edges.join(reached, F.col("src") == F.col("node"), "left_semi"), "reached")
    open_ = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    left = cut(reached.join(open_, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n")), "left")
    level = 0
    while True:
        frontier = left.where("n = 0").select("node")
        frontier.withColumn("rank", F.lit(level).cast("long")).write.mode("append").parquet(path)
        done = frontier.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("done"))
        rest = cut(left.where("n > 0").join(done, "node", "left").select("node", (F.col("n") - F.coalesce("done", F.lit(0))).alias("n")), "left")
        found = spark.read.parquet(path)
        if rest.where("n = 0").isEmpty():
            return found, rest.select("node")
        left, level = rest, level + 1


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or between two: what is left after taking away, again and again, nodes that nothing leads to
    or that lead nowhere."""
    left = cut(edges.select("src", "dst").distinct(), "edges")
    n = left.count()
    if n <= SMALL_EDGES:
        return _in_one_task(left, left.select(F.col("src").alias("node")).limit(0), _walk_cycles).select("node")
    while True:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = inner.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        left = cut(inner, "edges")
        m = left.count()
        if m == n:
            break
        n = m
    return left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
