"""Operator 7: byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

``encode`` gives each document's ids and, on request, each token's span in characters; ``decode`` turns ids
back into bytes. Both work row by row: no shuffle, memory bounded by a slice of rows.

Defined results: null text counts as empty; an empty text has no ids; rows with equal or null ids each keep
their own output row; empty tables give empty tables; other columns of the input are not read. A token that
holds part of a character has the span of that whole character. Decoded bytes that are not UTF-8 stay bytes;
``decoded_text`` shows them as U+FFFD.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map

ENCODED = "doc_id long, n_tokens long, ids binary"
SPANS = ", starts array<int>, ends array<int>"


@functools.lru_cache(2)
def byte_table(digest: str, body: str) -> list[bytes]:
    """The bytes of every id."""
    back = {c: b for b, c in tokens.byte_alphabet().items()}
    form = json.loads(body)
    vocab, added = form["model"]["vocab"], {t["id"]: t["content"].encode() for t in form.get("added_tokens") or []}
    table = [b""] * (1 + max([*vocab.values(), *added]))
    for token, i in vocab.items():
        table[i] = bytes(map(back.__getitem__, token)) if i not in added else b""
    for i, content in added.items():
        table[i] = content
    return table


def char_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of every token: byte offsets mapped to the characters that hold them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths[ids])
    return of_byte[ends - lengths[ids]].astype(np.int32), (of_byte[ends - 1] + 1).astype(np.int32)


def encode(docs: DataFrame, tokenizer: str, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, specials_as_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), with ``spans`` also starts and ends in characters."""
    shipped = tokens.ship(docs.sparkSession, tokens.load_spec(tokenizer, pattern))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        enc = tokens.encoder(shipped, specials_as_text)
        texts = [x or "" for x in part.column(1).to_pylist()]
        ids = enc.encode(texts)
        out = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
        if spans:
            lengths = np.array([len(x) for x in byte_table(shipped.value[0], shipped.value[1][1])])
            both = [char_spans(t, x, lengths) for t, x in zip(texts, ids, strict=True)]
            out += [pa.array([x[k] for x in both], pa.list_(pa.int32())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids", *(("starts", "ends") if spans else ())])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, ENCODED + SPANS * spans)


def decode(encoded: DataFrame, tokenizer: str, pattern: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with ``decoded``: the bytes that its ids stand for."""
    shipped = tokens.ship(encoded.sparkSession, tokens.load_spec(tokenizer, pattern))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        byte_of = byte_table(shipped.value[0], shipped.value[1][1]).__getitem__
        out = [None if x is None else b"".join(map(byte_of, np.frombuffer(x, "<u4").tolist())) for x in part.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return arrow_map(encoded.select("doc_id", "n_tokens", "ids"), run, ENCODED + ", decoded binary")


def decoded_text(decoded: DataFrame) -> DataFrame:
    """``decoded`` as text, with bytes that are no whole character as U+FFFD."""
    return decoded.withColumn("text", F.expr("make_valid_utf8(cast(decoded AS STRING))"))
