"""Operator 3: near-duplicate documents by BagMinHash over multisets of five-word shingles.

Signatures. A shingle that occurs w times has weight w. For every shingle there is one Poisson process for each
dyadic range of weight ([0,1), [1,2), [2,4), ...), its rate the range's width; each point falls on a random level
of its range, found by halving, and on a random register. Points above w do not count. A register keeps the least
point, so two documents agree on it with the probability of their weighted Jaccard similarity, without bias. Points
come in ascending order and a process ends once it passes the largest register.

Groups. Documents with the same words are one class. Classes whose signatures agree on a band meet in a bucket.
First every class is compared with the smallest class that it meets: one pair each. Then only buckets that still
hold several components are searched, block by block inside tasks: once by sketches, which tell the classes that have a
likely partner in a bucket, and once by the whole multisets of those. Every link is verified: overlap of the multisets,
intersection over union. A task tells one edge a class, to the least class of its local component, never pairs.

Defined results: a document is its id; null texts, texts without words and rows with null ids link with nothing;
texts of fewer than five words have one shingle, all their words; rows that share an id are one document to
others; of a group the smallest id stays; texts of any length are compared whole, by 64-bit hashes of their words; an
empty table gives an empty table; other columns are not read.

At scale: no bucket is gathered in one row or task (the first pass takes a minimum, the others deal blocks of bounded
count and words), no pairs are made inside classes or inside buckets already joined. Rows grow with the members of a
bucket, and with its blocks; only comparisons inside tasks grow with the square of classes that are alike but not the
same. With 40 bands of 7 registers a pair at
similarity 0.8 is missed with a probability of 0.0001, at 0.85 of 2 * 10**-7; the sketches' estimate adds 10**-6 at 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, arrow_map, broadcast_if_small, components, connected_components, join_counted, text_or_empty, written
from .hashing import mix, span_hashes
from .quality import CLASS, WORD

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 7
REGISTERS = BANDS * ROWS
#: Pairs inside a bucket go on to verification from this share of equal registers: five deviations below 0.8.
LIKELY = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
#: Classes compared with each other at once in a task, and words of theirs.
BLOCK, BLOCK_WORDS = 1024, 1 << 20
#: Entries of the matrices that hold their shingles.
DENSE = 8 << 20

_U = np.uint64
SIGNED = "doc_id long, digest string, bands array<long>, sketch binary, size long"
PAIR = "a long, b long"
ACTIVE = "bucket long, own int, other int, block int, id long"
BAG = "id long, bag binary"


def words_of(text: str) -> np.ndarray:
    """A 64-bit hash for every word: runs of letters and digits, in lower case."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    word = (CLASS[raw] == WORD).astype(np.int8)
    edge = np.diff(np.r_[np.int8(0), word, np.int8(0)])
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, _U)
    return span_hashes(raw, start, end)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, _U)
    for i in range(width):
        total = mix(total * _U(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(total, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum() + b[1].sum()) - both
    return both / union if union else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """BagMinHash registers of each bag; infinite for empty bags."""
    least = np.full(len(bags) * REGISTERS, np.inf)
    bag, seed, width, room = [], [], [], []
    for i, (hashes, counts) in enumerate(bags):
        low, j = 0, 0
        while len(hashes):
            # the range [low, high) of weight: everything of it counts, or only levels below the count
            high = 1 << j
            bag.append(np.full(len(hashes), i))
            seed.append(mix(hashes + _U(j * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)))
            width.append(np.full(len(hashes), high - low, float))
            room.append(np.minimum(counts - low, high - low).astype(float))
            low, j, more = high, j + 1, counts > high
            hashes, counts = hashes[more], counts[more]
    if not bag:
        return least.reshape(len(bags), REGISTERS)
    bag, seed, width, room = map(np.concatenate, (bag, seed, width, room))
    at, step = np.zeros(len(bag)), 0
    while len(bag):
        ahead = int(np.clip(20_000 // len(bag), 1, 64))
        t = np.arange(step, step + ahead, dtype=_U)
        h = mix(seed[:, None] + t * _U(0x2545F4914F6CDD1D) + _U(1))
        gaps = -np.log(((h >> _U(11)).astype(float) + 0.5) * 2.0**-53) / width[:, None]
        gaps[:, 0] += at
        points = np.cumsum(gaps, axis=1)
        h = mix(h + _U(0x632BE59BD9B4E019))
        register = ((h & _U(0xFFFFFFFF)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
        level = (h >> _U(32)).astype(float) * 2.0**-32 * width[:, None]
        counts = level < room[:, None]
        np.minimum.at(least, (bag[:, None] * REGISTERS + register)[counts], points[counts])
        at, step = points[:, -1], step + ahead
        alive = at < least.reshape(len(bags), REGISTERS).max(axis=1)[bag]
        bag, seed, width, room, at = bag[alive], seed[alive], width[alive], room[alive], at[alive]
    return least.reshape(len(bags), REGISTERS)


def _sign(part: pa.RecordBatch) -> pa.RecordBatch:
    words = [words_of(t) for t in part.column(1).to_pylist()]
    full = np.array([len(w) > 0 for w in words])
    ids = [d for d, f in zip(part.column(0).to_pylist(), full, strict=True) if f]
    words = [w for w in words if len(w)]
    points = signatures([shingles(w) for w in words]).view(_U)
    bands = np.zeros((len(words), BANDS), _U) + np.arange(BANDS, dtype=_U)
    for r in range(ROWS):
        bands = mix(bands * _U(31) + points[:, r::ROWS])
    sketch = (mix(points) >> _U(56)).astype(np.uint8)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([hashlib.blake2b(w.tobytes(), digest_size=16).hexdigest() for w in words], pa.string()), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([len(w) for w in words], pa.int64())],
        ["doc_id", "digest", "bands", "sketch", "size"],
    )


def _by_cell(each: Callable[[tuple, list[tuple]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``each`` over the rows of every cell (bucket, own block, other block), which come sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            # lists of hashes stay rows of one array
            columns = [c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
            for bucket, own, other, *row in zip(*columns, strict=True):
                if (bucket, own, other) != cell:
                    if rows:
                        yield from each(cell, rows)
                    cell, rows = (bucket, own, other), []
                rows.append(row)
        if rows:
            yield from each(cell, rows)

    return run


def _active(cell: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, component, sketch, band, bands) of a cell that have a partner of another component with a similar
    sketch, each pair in the first band whose hash both share."""
    if len(rows) < 2 or len({r[2] for r in rows}) < 2:
        return
    block, ids, comps = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    band, (_, own, other) = rows[0][4], cell
    sketch = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), REGISTERS)
    bands = np.stack([r[5] for r in rows])
    left, right = np.flatnonzero(block == own), np.flatnonzero(block == other)
    some = np.zeros(len(rows), bool)
    for start in range(0, len(left), 64):
        i = left[start : start + 64]
        equal = np.count_nonzero(sketch[i][:, None, :] == sketch[right][None, :, :], axis=2)
        x, y = np.nonzero((equal >= LIKELY * REGISTERS) & (comps[i][:, None] != comps[right][None, :]))
        x, y = i[x], right[y]
        # sketches may agree on a band by chance; only shared hashes are buckets that both are in
        first = np.zeros(len(x), bool)
        for at in range(0, len(x), 1 << 14):
            part = slice(at, at + (1 << 14))
            first[part] = (bands[x[part]] == bands[y[part]]).argmax(axis=1) == band
        some[x[first]] = some[y[first]] = True
    found = np.flatnonzero(some)
    if len(found):
        key = [pa.array(np.full(len(found), v), t) for v, t in zip(cell, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
        yield pa.RecordBatch.from_arrays([*key, pa.array(block[found], pa.int32()), pa.array(ids[found])], ["bucket", "own", "other", "block", "id"])


def bag_of(text: str) -> np.ndarray:
    """A number for every occurrence of every shingle, ascending: two bags share as many as the multisets overlap."""
    hashes, counts = shingles(words_of(text))
    each = np.repeat(hashes, counts)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(np.where(nth > 0, mix(each + nth.astype(_U) * _U(0x9FB21C651E98DF25)), each))


def overlaps(bags: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two bags share."""
    n, sizes = len(bags), [len(b) for b in bags]
    _, column, held = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    new = np.cumsum(held > 1) - 1
    row, column = np.repeat(np.arange(n), sizes)[shared], new[column[shared]]
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    out, width = np.zeros((n, n), np.float32), int(column[-1]) + 1 if len(column) else 0
    step = max(64, DENSE // max(1, n))
    for start in range(0, width, step):
        part = slice(*np.searchsorted(column, [start, start + step]))
        dense = np.zeros((n, min(step, width - start)), np.float32)
        dense[row[part], column[part] - start] = 1
        out += dense @ dense.T
    return out


def _linked(cell: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Edges between rows (id, bag) of a cell: of each to the least that links lead to inside the cell."""
    if len(rows) < 2:
        return
    ids, bags = np.array([r[0] for r in rows], np.int64), [np.frombuffer(r[1], _U) for r in rows]
    sizes = np.array([len(b) for b in bags], np.float64)
    both = overlaps(bags).astype(np.float64)
    hit = both / np.maximum(sizes[:, None] + sizes[None, :] - both, 1) >= THRESHOLD
    label = components(len(rows), *np.nonzero(np.triu(hit, 1)))
    other = np.flatnonzero(label != np.arange(len(rows)))
    if len(other):
        a, b = ids[other], ids[label[other]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _verify(part: pa.RecordBatch) -> pa.RecordBatch:
    known: dict[str, tuple] = {}

    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        if text not in known:
            if len(known) > 64:
                known.clear()
            known[text] = shingles(words_of(text))
        return known[text]

    good = [similarity(bag(x), bag(y)) >= THRESHOLD for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
    return part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Only texts that some pair names are moved."""
    named = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    needed = texts.join(broadcast_if_small(named), "doc_id", "left_semi")
    with_a = pairs.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    both = with_a.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return arrow_map(both, _verify, PAIR, rows=64).distinct()


def active(places: DataFrame, own: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (ACTIVE) with a likely partner, by cell, in buckets that hold several components of ``links``. A bucket of
    many classes or words is dealt out by pairs of blocks."""
    parts = connected_components(links)
    placed = places.join(parts, F.col("id") == F.col("node"), "left").select("bucket", "band", "id", "blocks", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("bucket")
    still = written(placed.join(broadcast_if_small(mixed), "bucket", "left_semi"), "near-open")
    block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    cells = still.select("bucket", "band", "id", "component", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sketches = own.join(broadcast_if_small(still.select("id").distinct()), "id", "left_semi").select("id", "sketch", "bands")
    dealt = cells.join(sketches, "id").select("bucket", F.least("block", "other").alias("own"), F.greatest("block", "other").alias("other"), "block", "id", "component", "sketch", "band", "bands")
    in_cells = dealt.repartition("bucket", "own", "other").sortWithinPartitions("bucket", "own", "other")
    return arrow_batches(in_cells, _by_cell(_active), ACTIVE)


def searched(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) that the links among active classes lead to, cell by cell, on their whole multisets."""

    def bags(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([bag_of(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["id", "bag"])

    needed = texts.join(broadcast_if_small(found.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    once = needed.withColumn("hash", F.xxhash64("text")).dropDuplicates(["doc_id", "hash"])  # rows that share an id keep their own words
    held = written(arrow_map(once.select(F.col("doc_id").alias("id"), "text"), bags, BAG), "near-bags")
    dealt = found.distinct().join(held, "id").select("bucket", "own", "other", "id", "bag")
    return arrow_batches(dealt.repartition("bucket", "own", "other").sortWithinPartitions("bucket", "own", "other"), _by_cell(_linked), PAIR).distinct()


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest document with the same words), group_id (smallest document
    reachable by links), kept (it is the smallest of its group)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = written(arrow_map(texts.where("doc_id IS NOT NULL"), _sign, SIGNED), "near-signed")
    least = written(signed.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "near-digests")
    classes = written(join_counted(signed.select("doc_id", "digest"), least, "digest", "n").select("doc_id", "class_id").distinct(), "near-classes")
    first = classes.where("doc_id = class_id").select("doc_id").distinct()
    own = signed.join(broadcast_if_small(first), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "bands", "sketch", "size")

    met = own.select("id", "size", F.posexplode("bands").alias("band", "bucket"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_WORDS)).cast("int")
    buckets = met.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n"), blocks.alias("blocks")).where("n > 1")
    places = written(met.join(buckets, "bucket").select("bucket", "band", "id", "leader", "blocks"), "near-places")
    tested = places.groupBy("id").agg(F.min("leader").alias("a")).where("a < id").select("a", F.col("id").alias("b"))
    links = written(verified(written(tested, "near-stars"), texts), "near-links")
    found = written(active(places, own, links), "near-active")
    links = links.unionByName(written(searched(found, texts), "near-links"))

    joined = connected_components(links)
    placed = classes.join(joined, F.col("class_id") == F.col("node"), "left").select("doc_id", "class_id", F.coalesce("component", "class_id").alias("component"))
    # rows that share an id but not their words belong together
    whole = placed.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component").alias("group_id"))
    ids = texts.select("doc_id")
    return ids.join(whole, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)).alias("kept"))
