"""Operator 4: exact duplicates by an extendible-hash index on shared files.

1. Each task normalises its rows (lower-cases A-Z), hashes them, and collapses equal texts of a batch, comparing
   bytes. What is left are entries: one text of each batch's group, with the group's size and its best row. They are
   written to the shared folder, and so are their distinct keys.
2. The directory doubles until no bucket holds more distinct keys than its capacity. Since a key counts once however
   many entries it has, a hot text splits nothing; the directory has a few dozen slots for each owner task, whatever
   the corpus, and is a file in the shared folder too.
3. A key with more than CROWD entries is folded first: its entries are dealt to as many tasks as it needs, which
   compare bytes and leave one entry each, until there are CROWD at most.
4. Owner tasks process the key ranges of their buckets in key order: entries with one key are chained, and bytes
   decide which are equal. Where the keys with several entries are few enough to broadcast, only theirs move.

Defined results: null text is empty; the row with the largest id stays, null ids being smallest, and of rows
that share text and id one stays; texts of any length are compared whole; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_batches, broadcast_if_small, parts_for, slices, text_or_empty, written

#: Buckets for each owner task, and the fewest keys for which a bucket is split.
BUCKETS_PER_TASK = 16
LEAST_CAPACITY = 256
#: Entries of one key that an owner takes.
CROWD = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTRY = "key long, best_id long, best_row long, members long, text_sha256 string, body binary"
ROWS = f"row long, doc_id long, entry long, {ENTRY}"
OWNED = "entry long, keep_id long, keep_row long, group_size long, text_sha256 string"


def _order(doc_id: int | None, row: int) -> tuple:
    return doc_id is not None, doc_id or 0, row


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = (TaskContext.get().partitionId() << 33) - 1
    for batch in batches:
        chains: dict[int, list[list]] = {}
        rows = []
        for part in slices(iter([batch])):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                row += 1
                body = text.encode().lower()  # bytes.lower() changes A-Z only
                key = xxhash.xxh64_intdigest(body) - (1 << 63)
                chain = chains.setdefault(key, [])
                entry = next((e for e in chain if e[4] == body), None)
                if entry is None:
                    chain.append(entry := [row, doc_id, row, 0, body, key])
                entry[3] += 1
                if _order(doc_id, row) > _order(entry[1], entry[2]):
                    entry[1:3] = doc_id, row
                rows.append((row, doc_id, entry))
        for start in range(0, len(rows), 1000):
            yield _batch([(r, d, e[0], *((e[5], e[1], e[2], e[3], hashlib.sha256(e[4]).hexdigest(), e[4]) if e[0] == r else (None,) * 6)) for r, d, e in rows[start : start + 1000]], ROWS)


def _chains(part: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Over entries (entry, group, ENTRY) sorted by key and group: the links of each chain, as [body, (best id, best row),
    members, entries, key, sha]."""
    last, chain = None, []
    for batch in slices(part):
        for entry, group, key, best_id, best_row, members, sha, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, group) != last:
                if chain:
                    yield chain
                last, chain = (key, group), []
            for link in chain:
                if link[0] == body:
                    link[1] = max(link[1], (best_id, best_row), key=lambda x: _order(*x))
                    link[2] += members
                    link[3].append(entry)
                    break
            else:
                chain.append([body, (best_id, best_row), members, [entry], key, sha])
    if chain:
        yield chain


def _some(rows: Iterator[tuple], schema: str, most: int = 1000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for r in rows:
        out.append(r)
        if len(out) >= most:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def _own(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each entry's text comes to."""
    return _some(((e, *best, members, sha) for chain in _chains(part) for _, best, members, entries, _, sha in chain for e in entries), OWNED)


def _fold(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries as rows of one entry among them, as _collapse has it."""

    def rows() -> Iterator[tuple]:
        for chain in _chains(part):
            for body, best, members, entries, key, sha in chain:
                for e in entries:
                    yield (e, None, entries[0], *((key, *best, members, sha, body) if e == entries[0] else (None,) * 6))

    return _some(rows(), ROWS, 200)


def directory(keys: DataFrame, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """(global depth, slots) for distinct keys (key): slot p is the bucket (prefix, local depth) of keys whose first
    bits are p. Doubles while a bucket holds more than ``capacity`` keys; only overfull buckets are counted again, one
    bit deeper."""
    prefix = lambda depth: F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    depth = max(0, math.ceil(math.log2(max(1, keys.count() / capacity))))
    leaves: dict[tuple[int, int], None] = {(p, depth): None for p in range(1 << depth)}
    held = keys.select("key").groupBy(prefix(depth).alias("p"))
    while True:
        full = [r.p for r in held.agg(F.count("*").alias("n")).where(F.col("n") > capacity).collect()]
        if not full or depth == 60:
            break
        for p in full:
            del leaves[p, depth]
            leaves |= {(2 * p, depth + 1): None, (2 * p + 1, depth + 1): None}
        held = keys.where(prefix(depth).isin(full)).groupBy(prefix(depth + 1).alias("p"))
        depth += 1
    slots = [(0, 0)] * (1 << depth)
    for p, local in leaves:
        first = p << (depth - local)
        slots[first : first + (1 << (depth - local))] = [(p, local)] * (1 << (depth - local))
    return depth, slots


_COLUMNS = [x.split(" ")[0] for x in ENTRY.split(", ")]


def folded(entries: DataFrame, keys: DataFrame, owners: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Entries and keys (key, n) with no key of more than CROWD entries, and the rounds (entry, into) that led there."""
    rounds: list[DataFrame] = []
    before = None
    while True:
        crowded = keys.where(F.col("n") > CROWD)
        n = crowded.agg(F.sum("n")).first()[0]
        if not n or before is not None and n >= before:  # CROWD different texts with one hash are chained as they are
            return entries, keys, rounds
        before = n
        dealt = broadcast_if_small(crowded.select("key", F.ceil(F.col("n") / CROWD).alias("tasks")))
        spread = entries.join(dealt, "key").withColumn("group", F.pmod(F.xxhash64("entry"), "tasks").cast("long"))
        part = spread.repartition(owners, "key", "group").sortWithinPartitions("key", "group", "entry").select("entry", "group", *_COLUMNS)
        rows = written(arrow_batches(part, _fold, ROWS), "exact-folded")
        rounds.append(rows.select(F.col("row").alias("entry"), F.col("entry").alias("into")))
        entries = entries.join(dealt, "key", "left_anti").select("entry", *_COLUMNS).unionByName(rows.where("row = entry").select("entry", *_COLUMNS))
        keys = written(entries.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the lower-cased text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = written(arrow_batches(texts, _collapse, ROWS), "exact-rows")
    owners = parts_for(docs)
    entries = rows.where("row = entry").select("entry", *_COLUMNS)
    keys = written(entries.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    depth, slots = directory(keys, max(LEAST_CAPACITY, math.ceil(keys.count() / (owners * BUCKETS_PER_TASK))))
    buckets = written(spark.createDataFrame([(p, slots[p][0] << (depth - slots[p][1])) for p in range(len(slots))], "slot long, bucket long"), "exact-directory")
    entries, keys, rounds = folded(entries, keys, owners)

    several, alone = keys.where("n > 1").select("key"), None
    if several.count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
        alone = entries.join(several, "key", "left_anti").select("entry", F.col("best_id").alias("keep_id"), F.col("best_row").alias("keep_row"), F.col("members").alias("group_size"), "text_sha256")
        entries = entries.join(several, "key", "left_semi")
    slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    dealt = entries.withColumn("slot", slot).join(F.broadcast(buckets) if len(slots) <= 1 << 16 else buckets, "slot")
    owned = dealt.repartition(owners, "bucket").sortWithinPartitions("key", "entry").select("entry", F.lit(0).cast("long").alias("group"), *_COLUMNS)
    found = arrow_batches(owned, _own, OWNED)
    found = found if alone is None else found.unionByName(alone.select(*found.columns))
    for into in reversed(rounds):
        found = written(found, "exact-found")
        found = found.unionByName(into.where("entry != into").join(found.withColumnRenamed("entry", "into"), "into").select(*found.columns))
    return rows.select("row", "doc_id", "entry").join(found, "entry").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)
"""
