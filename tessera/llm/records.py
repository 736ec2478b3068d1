"""Operator 10: token ids as length-delimited binary records, with a separate offset index.

Format. A shard is a run of records; a record is

    8 bytes  length of the body, little-endian          4 bytes  masked CRC-32 of those 8 bytes
    body                                                4 bytes  masked CRC-32 of the body
    1 byte   0x0A, end mark

The body is 1 byte flags (bit 0: the id is null; bits 1-2: bytes of a token id, less one), 8 bytes document id,
then the token ids, little-endian. The mask is that of the common record formats: rotate right by 15 and add a
constant, so that checksums of data that hold checksums stay sound. Shards are in ascending order of document id,
and so are the records in each. The index (Parquet) has shard, offset, length, doc_id, n_tokens of every record.

Shards go through Spark's own text writer and the binaryFile reader, so they land in any file system that Spark
writes, and a lost task leaves no half-written shard: the writer's commit protocol decides.

Shards are numbered; a shard's number is what its file name says, so shards are in order however many there are.

Defined results: null text is empty and has only the end id; null ids come first; rows with one id stand in the order
of their texts' first ORDERED characters, and beyond that in any order, so that one id may fill many shards; a text of
any length is one record; repeated rows are a record each; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_batches, arrow_map, estimated_bytes, parts_for, slices, text_or_empty, written

MASK_ADD = 0xA282EAD8
#: Shards up to which their wanted places are broadcast.
MOST_PLACES = 1000
HEAD = struct.Struct("<QI")
INDEX = "shard long, offset long, length long, doc_id long, n_tokens long"
#: Characters of a text that order rows of one id, and how many ways rows that agree on them are dealt.
ORDERED, WAYS = 64, 1024
#: Bytes of estimated input in a shard: what a reading task holds at once.
SHARD_BYTES = 64 << 20


class BadRecord(ValueError):
    """A record whose length or checksum does not hold."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """A record without its end mark, which the writer adds."""
    body = struct.pack("<Bq", (doc_id is None) | (ids.dtype.itemsize - 1) << 1, doc_id or 0) + ids.tobytes()
    length = struct.pack("<Q", len(body))
    return b"".join((length, struct.pack("<I", masked(length)), body, struct.pack("<I", masked(body))))


def unframe(shard: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """offset, length, document id and token ids of every record, each checked."""
    at = 0
    while at < len(shard):
        if at + HEAD.size > len(shard):
            raise BadRecord(f"a record is cut off at {at}")
        length, check = HEAD.unpack_from(shard, at)
        if masked(shard[at : at + 8]) != check:
            raise BadRecord(f"the length at {at} does not match its checksum")
        start, end = at + HEAD.size, at + HEAD.size + length
        body = shard[start:end]
        if len(shard) < end + 5 or masked(body) != struct.unpack_from("<I", shard, end)[0] or shard[end + 4] != 10:
            raise BadRecord(f"the record at {at} does not match its checksum")
        flags, doc_id = struct.unpack_from("<Bq", body)
        width = (flags >> 1 & 3) + 1
        yield at, end + 5 - at, None if flags & 1 else doc_id, np.frombuffer(body, f"<u{width}", offset=9)
        at = end + 5


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None, specials_as_text: bool = False) -> None:
    """Encodes every document, appends ``end_id`` and writes shards in order of document id, then the index."""
    spark = docs.sparkSession
    shipped = tokens.ship(spark, tokens.load_spec(tokenizer, pattern))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    parts = max(parts_for(texts), math.ceil(estimated_bytes(texts) / SHARD_BYTES))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        enc = tokens.encoder(shipped, specials_as_text)
        ids = [np.append(x, enc.dtype.type(end_id)) for x in enc.encode(part.column(1).to_pylist())]
        out = [frame(d, x) for d, x in zip(part.column(0).to_pylist(), ids, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    order = ["doc_id", F.substring("text", 1, ORDERED), F.col("way")]
    ways = texts.withColumn("way", F.pmod(F.monotonically_increasing_id(), F.lit(WAYS)).cast("int"))
    in_order = ways.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    arrow_map(in_order, run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/shards")
    index(spark, path).write.parquet(f"{path}/index")


def shard_number(path: Column) -> Column:
    """The number in a shard's file name, which has five digits or more."""
    return F.regexp_extract(path, r"part-([0-9]+)[^/]*$", 1).cast("long")


def _shards(spark: SparkSession, path: str, numbers: list[int] | None = None) -> DataFrame:
    """(shard, content) of all shards or of those with the numbers; other files are not opened."""
    reader = spark.read.format("binaryFile")
    where = f"{path}/shards" if numbers is None else [f"{path}/shards/part-{n:05d}*" for n in numbers]
    return reader.load(where).select(shard_number(F.col("path")).alias("shard"), "content")


def index(spark: SparkSession, path: str) -> DataFrame:
    """Offset and length of every record, from the shards themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            shard = part.column(0)[0].as_py()
            rows = [(shard, at, n, doc, len(ids)) for at, n, doc, ids in unframe(part.column(1)[0].as_buffer().to_pybytes())]
            yield _batch(rows, ("shard", "offset", "length", "doc_id", "n_tokens"), "lqqqq")

    return arrow_batches(_shards(spark, path), run, INDEX)


RECORDS = "shard long, offset long, doc_id long, ids binary, n_tokens long"


def _unframed(shards: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            shard, rows = part.column(0)[0].as_py(), []
            for at, _, doc, ids in unframe(part.column(1)[0].as_buffer().to_pybytes()):
                rows.append((shard, at, doc, ids.astype("<u4").tobytes(), len(ids)))
                if len(rows) == 1000:
                    yield _batch(rows, ("shard", "offset", "doc_id", "ids", "n_tokens"), "lqqbq")
                    rows = []
            yield _batch(rows, ("shard", "offset", "doc_id", "ids", "n_tokens"), "lqqbq")

    return arrow_batches(shards, run, RECORDS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, offset, doc_id, ids (little-endian unsigned 32-bit), n_tokens of every record."""
    return _unframed(_shards(spark, path))


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records of the documents in ``wanted`` (doc_id), in any order. The index names the shards that are read, and
    each record's place; no other record is taken apart."""
    index_rows = spark.read.schema(INDEX).parquet(f"{path}/index")
    places = index_rows.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("shard").agg(F.collect_list(F.struct("offset", "length")).alias("at"))
    places = written(places, "places")
    numbers = [r.shard for r in places.select("shard").collect()]  # one for each file at most
    if not numbers:
        return spark.createDataFrame([], RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            shard, content = part.column(0)[0].as_py(), part.column(1)[0].as_buffer()
            for start in range(0, len(part.column(2)[0]), 1000):
                rows = []
                for at in part.column(2)[0].as_py()[start : start + 1000]:
                    (_, _, doc, ids), = unframe(content.slice(at["offset"], at["length"]).to_pybytes())
                    rows.append((shard, at["offset"], doc, ids.astype("<u4").tobytes(), len(ids)))
                yield _batch(rows, ("shard", "offset", "doc_id", "ids", "n_tokens"), "lqqbq")

    return arrow_batches(_shards(spark, path, numbers).join(F.broadcast(places) if len(numbers) <= MOST_PLACES else places, "shard"), run, RECORDS)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, offset, start: how many ids stand before each record. A window over the shards' totals joins the
    running sums inside each shard; no task sees more rows than a shard has, or than there are shards."""
    rows = spark.read.schema(INDEX).parquet(f"{path}/index")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("shard", "offset", F.coalesce(inside, F.lit(0)).alias("inside")).join(before, "shard").select("shard", "offset", (F.col("inside") + F.coalesce("base", F.lit(0))).alias("start"))


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: str) -> pa.RecordBatch:
    types = {"l": pa.int64(), "q": pa.int64(), "b": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))
