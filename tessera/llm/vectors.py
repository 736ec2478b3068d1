"""Operator 6: pairs of vectors with cosine at or above a threshold, by dual traversal of cover trees.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c). Vectors are dealt to cells by their nearest pivot and
cells cut into blocks of bounded size. Each block is a cover tree: nested levels of centres with halving radii; a node's
points stand in one range. The widest level is the widest whose balls can be apart at all on the unit sphere, (2 -
reach) / 2. Two blocks, and inside them two nodes, are passed over where the distance of their centres exceeds both
covering radii and the threshold together, taken whole where even the farthest points are within it, and otherwise
opened; what is left at the bottom is compared in double precision. Pairs are exact.

A task gets one pair of blocks and tells, for each of their points, how many links it has and one other point of its
local component: rows grow with points, not with links. Equal vectors are one point with a weight.

Defined results: vectors that are null, zero or hold null or non-finite components and rows with null ids link with
nothing; vectors of different lengths do not link, each length is searched by itself; rows that share an id are told
apart, each with its own links, and only their ids are compared for ``kept``; repeated rows link with each other; an
empty table gives an empty table; other columns are not read.

At scale: a vector is copied once for each block that its own may reach. Their number is BLOCKS while blocks hold at
most BLOCK_BYTES, so small tables move in proportion to their size; beyond, it grows with the table, less what bounds
prune: of directions without structure in many dimensions no metric bound prunes anything, and the work is quadratic. The
driver holds at most 1,024 sampled rows for pivots, which only steer where vectors go, not what is found; pairs of blocks
are found by executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import arrow_batches, arrow_map, components, connected_components, join_counted, slices, written

#: Blocks that a table is cut into at least, points in a block at least, and bytes of vectors in one at most.
BLOCKS, LEAST_BLOCK, BLOCK_BYTES = 8, 1024, 16 << 20
PIVOT_SAMPLE, MOST_PIVOTS = 1024, 256
#: Blocks whose centres are compared at once.
HEADS = 2048
#: Levels below the threshold's distance.
FINER = 2
#: Slack for rounding in bounds; compared vectors decide by their own cosine.
SLACK = 1e-7
#: Node pairs of fewer point pairs than this are compared at once; and the most distances that are taken at once.
SMALL, AT_ONCE = 1 << 14, 1 << 22
#: Tasks that pairs of blocks are dealt to at most.
MOST_TASKS = 20_000
#: Links that a task holds before it makes stars of them.
MOST_EDGES = 1 << 20

UNIT = "vec_id long, vec binary"
PACKED = "block long, ids binary, weights binary, vecs binary, nodes binary, centre binary, radius double"
LINKS = "point long, n_links long, root long"


def unit(vecs: np.ndarray) -> np.ndarray:
    x = vecs.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _clean(part: pa.RecordBatch) -> pa.RecordBatch:
    """Vectors as the bytes of doubles; null where a row can have no links."""
    out = []
    for i, v in zip(part.column(0), part.column(1), strict=True):
        x = None
        if i.is_valid and v.is_valid and v.values.null_count == 0 and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = (x / top).tobytes() if np.isfinite(x).all() and (top := np.abs(x).max()) > 0 else None
        out.append(x)
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])


def pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each new pivot is the sampled vector farthest from those before."""
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def net(x: np.ndarray, own: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, float]]:
    """The points ``own`` cut into balls: each centre is the first point that no earlier ball covers, and comes first.
    Yields (points, covering radius). Distances are taken for some hundred possible centres at once."""
    while len(own):
        some = own[:256]
        gap = np.sqrt(np.maximum(2 - 2 * (x[some] @ x[own].T), 0))
        left = np.ones(len(own), bool)
        for i in range(len(some)):
            if left[i]:
                inside = left & (gap[i] <= radius)
                inside[i] = False
                left &= ~inside
                left[i] = False
                yield np.r_[own[i], own[inside]], float(gap[i][inside].max(initial=0.0))
        own = own[left]


def level_radii(reach: float) -> list[float]:
    """Radii that halve from the widest that may prune, to FINER levels below the threshold's distance."""
    wider = 0
    while reach * 2 ** (wider + 1) <= (2 - reach) / 2:
        wider += 1
    return [reach * 2.0**k for k in range(wider, -FINER - 1, -1)]


def cover_tree(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(order of the points, nodes): a node is (level, start, end, first child, end of children, radius) over the
    ordered points, its centre being its first point. Each level halves the radius of the one above."""
    order = np.arange(len(x))
    levels: list[list[tuple[int, int, float]]] = []
    ranges = [(0, len(x))] if len(x) else []
    for radius in level_radii(reach):
        nodes = []
        for start, end in ranges:
            pieces = []
            for points, reached in net(x, order[start:end], radius):
                nodes.append((start, start + len(points), reached))
                start += len(points)
                pieces.append(points)
            order[end - sum(map(len, pieces)) : end] = np.concatenate(pieces)
        levels.append(nodes)
        ranges = [(s, e) for s, e, _ in nodes]
    # radii are measured once the order is final: deeper levels permute points, but keep each node's first point
    first = np.cumsum([0, *map(len, levels)])
    rows = []
    for k, nodes in enumerate(levels):
        starts = np.array([s for s, _, _ in levels[k + 1]]) if k + 1 < len(levels) else np.zeros(0)
        for s, e, r in nodes:
            a, b = (first[k + 1] + np.searchsorted(starts, [s, e])) if len(starts) else (0, 0)
            rows.append((k, s, e, a, b, r))
    return order, np.array(rows, dtype=np.float64).reshape(-1, 6)


def _pack(table: pa.Table, reach: float) -> pa.Table:
    ids = table.column("point").to_numpy()
    vecs = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(len(ids), -1)
    x = unit(vecs)
    by_id = np.argsort(ids, kind="stable")
    ids, x, weights = ids[by_id], x[by_id], table.column("weight").to_numpy()[by_id]
    order, nodes = cover_tree(x, reach)
    centre = x.mean(axis=0)
    radius = float(np.linalg.norm(x - centre, axis=1).max())
    row = [table.column("block")[0].as_py(), ids[order].tobytes(), weights[order].astype(np.int64).tobytes(), x[order].tobytes(), nodes.tobytes(), centre.tobytes(), radius]
    return pa.table([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * 5, pa.float64()), strict=True)], names=[c.split(" ")[0] for c in PACKED.split(", ")])


class Tree:
    def __init__(self, ids: bytes, weights: bytes, vecs: bytes, nodes: bytes):
        self.ids, self.weights = np.frombuffer(ids, np.int64), np.frombuffer(weights, np.int64)
        self.x = np.frombuffer(vecs, np.float64).reshape(len(self.ids), -1)
        n = np.frombuffer(nodes, np.float64).reshape(-1, 6)
        self.level, self.start, self.end, self.a, self.b = (n[:, k].astype(np.int64) for k in range(5))
        self.radius, self.root = n[:, 5], np.flatnonzero(n[:, 0] == 0)
        self.links = np.zeros(len(self.ids), np.int64)


class Join:
    """Dual traversal of two trees, or of one with itself."""

    def __init__(self, cosine: float):
        self.cosine, self.reach = cosine, math.sqrt(2 - 2 * cosine)

    def run(self, s: Tree, t: Tree) -> np.ndarray:
        """Adds to both trees' link counts; the component of each point of ``s`` and then, if it is another, of ``t``."""
        same, self.edges, self.held = s is t, [], 0
        self.shift, n = 0 if same else len(s.ids), len(s.ids) if same else len(s.ids) + len(t.ids)
        todo = [(s.root, t.root)]
        while todo:
            i, j = todo.pop()
            rows = max(1, AT_ONCE // max(1, len(j)))
            if len(i) > rows:
                todo += [(i[k : k + rows], j) for k in range(0, len(i), rows)]
                continue
            gap = np.sqrt(np.maximum(2 - 2 * (s.x[s.start[i]] @ t.x[t.start[j]].T), 0))
            near = gap <= s.radius[i][:, None] + t.radius[j][None, :] + self.reach + SLACK
            if same:
                # nodes of one level stand in the order of their numbers: a pair is met once
                near &= i[:, None] <= j[None, :]
            for p, q in zip(*np.nonzero(near), strict=True):
                a, b, d = i[p], j[q], gap[p, q]
                size = (s.end[a] - s.start[a]) * (t.end[b] - t.start[b])
                if not (same and a == b) and d + s.radius[a] + t.radius[b] <= self.reach - 1e-6:
                    self.whole(s, t, a, b)
                elif size <= SMALL or s.a[a] == s.b[a] or t.a[b] == t.b[b]:
                    self.compare(s, t, a, b, same and a == b)
                else:
                    todo.append((np.arange(s.a[a], s.b[a]), np.arange(t.a[b], t.b[b])))
            if self.held > MOST_EDGES:
                label = components(n, *self.all_edges())
                own = np.flatnonzero(label != np.arange(n))
                self.edges, self.held = [(own, label[own])], 0
        return components(n, *self.all_edges())

    def all_edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.edges:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.edges, strict=True))

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        """Edges between points of the one tree and of the other."""
        self.edges.append((u, v + self.shift))
        self.held += len(u)

    def whole(self, s: Tree, t: Tree, a: int, b: int) -> None:
        x, y = np.arange(s.start[a], s.end[a]), np.arange(t.start[b], t.end[b])
        s.links[x] += t.weights[y].sum()
        t.links[y] += s.weights[x].sum()
        self.link(x, np.full(len(x), y[0]))
        self.link(np.full(len(y), x[0]), y)

    def compare(self, s: Tree, t: Tree, a: int, b: int, itself: bool) -> None:
        """All points of two nodes, in slices. A slice's links are told by one partner for each point, and one for each
        partner; where that leaves points unjoined that share partners, all links are."""
        rows = max(1, AT_ONCE // max(1, t.end[b] - t.start[b]))
        y = slice(t.start[b], t.end[b])
        for start in range(s.start[a], s.end[a], rows):
            x = slice(start, min(start + rows, s.end[a]))
            hit = s.x[x] @ t.x[y].T >= self.cosine
            if itself:
                at = np.arange(x.start, x.stop)
                hit[at - x.start, at - y.start] = False
            if not hit.any():
                continue
            s.links[x] += hit @ t.weights[y]
            if not itself:
                t.links[y] += hit.T @ s.weights[x]
            left, right = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            hit = hit[np.ix_(left, right)]
            # rounds of labels over the slice: each partner takes its least point, each point its least partner's
            own, most = np.arange(len(left)), len(left)
            while True:
                other = np.where(hit, own[:, None], most).min(axis=0)
                new = np.minimum(own, np.where(hit, other[None, :], most).min(axis=1))
                if (new == own).all():
                    break
                own = new
            self.link(x.start + left[other], y.start + right)
            self.link(x.start + left, y.start + right[hit.argmax(axis=1)])


def _traverse(cosine: float):
    join = Join(cosine)

    def out(trees: list[Tree], label: np.ndarray) -> pa.RecordBatch:
        ids, links = (np.concatenate([getattr(t, k) for t in trees]) for k in ("ids", "links"))
        some = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[label[some]])], ["point", "n_links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for part in slices(batches, 1):
            one, two, block, *body = (c[0].as_py() for c in part.columns)
            tree = Tree(*body)
            if one != two and block == one:
                first = (one, two), tree
                continue
            if one == two:
                trees = [tree, tree]
            elif first is None or first[0] != (one, two):
                raise RuntimeError("a block came without the one before it")
            else:
                trees = [first[1], tree]
            label = join.run(*trees)
            first = None
            yield out(trees[:1] if one == two else trees, label)

    return run


def _near_heads(reach: float):
    """Over heads sorted by cell (group, group): pairs (one, two) of blocks that may hold links, one <= two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def pairs() -> pa.RecordBatch:
            group, block, radius = (np.array([r[k] for r in rows]) for k in (0, 1, 2))
            centre = np.array([np.frombuffer(r[3], np.float64) for r in rows])
            left, right = np.flatnonzero(group == cell[0]), np.flatnonzero(group == cell[1])
            one, two = [], []
            for start in range(0, len(left), 256):
                i = left[start : start + 256]
                square = (centre[i] ** 2).sum(axis=1)[:, None] + (centre[right] ** 2).sum(axis=1)[None, :] - 2 * centre[i] @ centre[right].T
                near = np.sqrt(np.maximum(square, 0)) <= radius[i][:, None] + radius[right][None, :] + reach + SLACK
                if cell[0] == cell[1]:
                    near &= block[i][:, None] <= block[right][None, :]
                x, y = np.nonzero(near)
                one.append(np.minimum(block[i][x], block[right][y]))
                two.append(np.maximum(block[i][x], block[right][y]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(k).astype(np.int64)) for k in (one, two)], ["one", "two"])

        for batch in batches:
            for own, other, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (own, other) != cell:
                    if rows:
                        yield pairs()
                    cell, rows = (own, other), []
                rows.append(row)
        if rows:
            yield pairs()

    return run


def _block_pairs(packed: DataFrame, n: int, reach: float) -> DataFrame:
    """Pairs (one, two) of blocks that may hold links; heads of blocks are compared group by group."""
    groups = max(1, math.ceil(n / HEADS))
    heads = packed.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), "block", "radius", "centre")
    cells = heads.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(F.least("group", "other").alias("a"), F.greatest("group", "other").alias("b"), "group", "block", "radius", "centre")
    return arrow_batches(cells.repartition("a", "b").sortWithinPartitions("a", "b"), _near_heads(reach), "one long, two long")


def _search(points: DataFrame, n: int, size: int, cosine: float) -> DataFrame:
    """Links of ``n`` distinct vectors of one length (``size`` bytes), as LINKS."""
    reach = math.sqrt(2 - 2 * cosine)
    block = min(max(LEAST_BLOCK, math.ceil(n / BLOCKS)), max(1, BLOCK_BYTES // size))
    sample = points.orderBy(F.xxhash64("point"), "point").limit(PIVOT_SAMPLE).select("vec").collect()
    tops = pivots(unit(np.array([np.frombuffer(r.vec, np.float64) for r in sample])), min(MOST_PIVOTS, math.ceil(n / block)))

    def cell(part: pa.RecordBatch) -> pa.RecordBatch:
        x = unit(np.frombuffer(b"".join(part.column(0).to_pylist()), np.float64).reshape(part.num_rows, -1))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array((x @ tops.T).argmax(axis=1).astype(np.int64))], ["vec", "point", "weight", "cell"])

    placed = written(arrow_map(points.select("vec", "point", "weight"), cell, "vec binary, point long, weight long, cell long", rows=2048), "cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts"))  # as many rows as pivots
    dealt = placed.join(F.broadcast(parts), "cell").select((F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("point"), "parts")).alias("block"), "point", "weight", "vec")
    packed = written(dealt.groupBy("block").applyInArrow(lambda t: _pack(t, reach), PACKED), "blocks")
    pairs = written(_block_pairs(packed, packed.select("block").count(), reach), "block-pairs")
    each = pairs.select("one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    work = each.join(packed.select("block", "ids", "weights", "vecs", "nodes"), "block").select("one", "two", "block", "ids", "weights", "vecs", "nodes")
    tasks = min(max(1, pairs.count()), MOST_TASKS)
    return written(arrow_batches(work.repartition(tasks, "one", "two").sortWithinPartitions("one", "two", "block"), _traverse(cosine), LINKS), "links")


def linked(vectors: DataFrame, cosine: float = 0.9, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable), kept (it is its own component's)."""
    spark = vectors.sparkSession
    ship_package(spark)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    clean = written(arrow_map(given, _clean, UNIT, rows=2048), "vectors")
    usable = clean.where("vec IS NOT NULL")
    distinct = usable.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    points = written(distinct.withColumn("point", F.monotonically_increasing_id()), "points")
    size = F.octet_length("vec")
    found = spark.createDataFrame([], LINKS)
    # a point without another of its length has no links but to its own copies
    for r in points.groupBy(size.alias("size")).count().where("count > 1").orderBy("size").collect():
        found = found.unionByName(_search(points.where(size == r["size"]), r["count"], r["size"], cosine))

    counts = found.groupBy("point").agg(F.sum("n_links").alias("n"))
    parts = written(connected_components(found.where("point != root").select(F.col("point").alias("a"), F.col("root").alias("b"))), "components")
    least = written(parts.join(points.select(F.col("point").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    placed = join_counted(parts, least, "component", "n").select(F.col("node").alias("point"), "component_id")
    told = points.join(counts, "point", "left").join(placed, "point", "left")
    told = written(told.select("vec", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "told")
    yes = join_counted(usable, told, "vec", "weight").select("vec_id", "n_links", "component_id")
    rest = clean.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return yes.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT row, vec_id, x, len(x) AS n, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_sum(list_transform(x, lambda y: abs(y))) > 0),
link AS (SELECT a.row AS a, b.row AS b FROM ok a JOIN ok b ON a.n = b.n AND a.row <> b.row WHERE list_dot_product(a.x, b.x) / a.norm / b.norm >= 0.9),
reach AS (SELECT row AS a, row AS b FROM ok UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
part AS (SELECT r.a AS row, min(o.vec_id) AS component_id FROM reach r JOIN ok o ON o.row = r.b GROUP BY r.a)
SELECT v.vec_id, (SELECT count(*) FROM link l WHERE l.a = v.row) AS n_links, coalesce(component_id, v.vec_id) AS component_id, coalesce(v.vec_id = coalesce(component_id, v.vec_id), true) AS kept FROM v LEFT JOIN part USING (row)
"""
