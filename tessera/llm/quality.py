"""Operator 8: a quality classifier. Logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader (proximal) updates, scored as sparse dot products.

Tokens are runs of letters and digits, and runs of marks. Features are the hashes of folded words and marks, of
pairs of neighbours (a word followed by itself is one feature), and of triples of word shapes (small, Capital,
LARGE, mixed, mark), each weighted by its share of the text's tokens.

Defined results: null and empty texts have no features and get the score of the bias; rows with a null label or
id are not learnt from; texts of any length are scored whole; without labels of both kinds every score is 0.5; repeated rows are scored each; an empty
table gives an empty table. Only the text is an input of a score.

Bounds: learns from at most ``sample`` labelled rows (least hash of the id first); the model is 2**18 weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_or_empty
from .hashing import mix, span_hashes

BITS = 18
#: Labelled rows learnt from, at most.
SAMPLE = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 1e-3

SPACE, WORD, MARK = 0, 1, 2
CLASS = np.full(256, MARK, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[np.r_[48:58, 65:91, 97:123, 128:256]] = WORD
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text: every n-gram with its share, repeats not yet added up."""
    raw = np.frombuffer(text.encode(), np.uint8)
    kind = CLASS[raw]
    edge = np.flatnonzero(np.diff(kind)) + 1
    start, end = np.r_[0, edge], np.r_[edge, len(raw)]
    start, end = start[keep := kind[start] != SPACE] if len(raw) else start[:0], end[keep] if len(raw) else end[:0]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0)
    word = span_hashes(_FOLD[raw], start, end)
    large = np.r_[0, np.cumsum((raw >= 65) & (raw <= 90))]
    n_large, length = large[end] - large[start], end - start
    shape = np.where(kind[start] == MARK, 4, np.where(n_large == 0, 0, np.where((n_large == length) & (length > 1), 2, np.where((n_large == 1) & (raw[start] >= 65) & (raw[start] <= 90), 1, 3)))).astype(np.uint64)
    shape = np.where(shape == 4, word ^ np.uint64(77), shape + np.uint64(1))
    pairs = np.where(word[1:] == word[:-1], np.uint64(12345), mix(word[:-1] + np.uint64(3) * word[1:]))
    triples = mix(shape[:-2] + np.uint64(0x10001) * shape[1:-1] + np.uint64(0x100000007) * shape[2:] + np.uint64(99))
    grams = np.concatenate([word, pairs, triples, mix(shape + np.uint64(7))])
    return (grams >> np.uint64(64 - BITS)).astype(np.int64), np.full(len(grams), 4.0 / len(start))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes of per-coordinate FTRL-proximal updates."""
    z, n, bias_z, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    if len({y for *_, y in rows}) < 2:
        return np.zeros(1 << BITS), 0.0
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[i]
            w, b = weights(z[at], n[at]), -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2)
            error = 1 / (1 + np.exp(-np.clip(w @ x + b, -30, 30))) - y
            g = error * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            bias_z += error - (np.sqrt(bias_n + error * error) - np.sqrt(bias_n)) / ALPHA * b
            bias_n += error * error
    return weights(z, n), float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learns from labelled rows that are not held out; features are made on the executors."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ats, values = [], []
        for text in part.column(2).to_pylist():
            at, x = features(text)
            own, inverse = np.unique(at, return_inverse=True)
            ats.append(own.astype("<i4").tobytes())
            values.append(np.bincount(inverse, x, len(own)).astype("<f4").tobytes())
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ats, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "y", "at", "x"])

    made = arrow_map(chosen.join(texts, "doc_id").select("doc_id", "y", "text"), run, "doc_id long, y int, at binary, x binary").collect()
    made.sort(key=lambda r: (r.doc_id, r.y, bytes(r.at)))
    return fit_rows([(np.frombuffer(r.at, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(float), r.y) for r in made[: 4 * sample]])


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 weights, whatever the corpus

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        weights, bias = shipped.value
        out = []
        for text in part.column(2).to_pylist():
            at, x = features(text)
            out.append(1 / (1 + np.exp(-np.clip(weights[at] @ x + bias, -30, 30))))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).select("doc_id", held_out().alias("held_out"), "text")
    return arrow_map(texts, run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that the model rejects; no join, rows are judged where they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        weights, bias = shipped.value
        good = []
        for text in part.column(at_text).to_pylist():
            at, x = features(text or "")
            good.append(bool(weights[at] @ x + bias >= 0))
        return part.filter(pa.array(good, pa.bool_()))

    return arrow_map(docs, run, docs.schema)
