import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, counts, packing, records, tokens

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "don't stop. it's 'quoted' x's", "tab\there", "x y", "a b", "1234 5,6.7", "<|endoftext|>", "a<|endoftext|>b c", "漢字 かな", "é" * 300, "word" * 500, "a\r\nb", "\x1c", "x \x85 y", "(see) [this] {one}: it; is! ok?", "A--B ---", "ƒoo ǆ Ĳ ß", "԰՘x"]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_libraries():
    by_json, by_ranks, plain = tokens.Encoder(tokens.load_spec(JSON)), tokens.Encoder(tokens.load_spec(RANKS, P.PATTERN), True), Tokenizer.from_file(JSON)
    each = [f"ab{c} {c}x{c}. \n{c}9{c}" for c in map(chr, range(1, 0x3100)) if not 0xD800 <= ord(c) < 0xE000]
    texts = ODD + each + [" ".join(ODD)]
    for _ in range(2):  # the second time from the memo
        assert [x.tolist() for x in by_json.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        enc = library()
        assert [x.tolist() for x in by_ranks.encode(texts)] == [enc.encode_ordinary(t) for t in texts]


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return [word, word.translate(str.maketrans("ab", "ba"))]


def test_bytes_decide_what_is_known(monkeypatch):
    plain = Tokenizer.from_file(JSON)
    texts = [t for n in (8, 16, 32, 1024, 2048, 65536) for w in thue_morse(n) for t in (w, f"x {w}\n{w[::-1]}")] + ["a", "a\0", "x" * 31 + " " + "x" * 32] + ODD
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for few in (None, 3):
        if few:  # most chunks share a hash
            real = tokens.words_hash
            monkeypatch.setattr(tokens, "words_hash", lambda words: real(words) % np.uint64(few))
        enc = tokens.Encoder(tokens.load_spec(JSON))
        for _ in range(2):
            assert [x.tolist() for x in enc.encode(texts)] == want


def test_colliding_chunks_in_the_operators(spark, tmp_path):
    plain = Tokenizer.from_file(JSON)
    texts = [w for n in (1024, 2048, 65536) for w in thue_morse(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(df, RANKS, P.PATTERN).collect()}
    assert [got[i] for i in range(len(texts))] == want
    counted = {r.doc_id: r.n_tokens for r in counts.token_counts(df, JSON, f"file://{tmp_path}/cache").collect()}
    assert [counted[i] for i in range(len(texts))] == [len(x) for x in want]
    records.write(df, f"file://{tmp_path}/records", JSON)
    read = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in records.read(spark, f"file://{tmp_path}/records").collect()}
    assert [read[i] for i in range(len(texts))] == [[*x, 0] for x in want]
    packed = packing.pack_documents(df, JSON).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {i: len(x) for i, x in enumerate(want)}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    enc = tokens.Encoder(tokens.load_spec(P.path(name)))
    if name.endswith(".model"):
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(ODD, num_threads=1)
    else:
        want = [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(ODD, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(ODD)] == want


def test_bpe_round_trip(spark, hard):
    encoded = bpe.encode(hard, RANKS, P.PATTERN, spans=True)
    assert encoded.count() == hard.count()
    back = bpe.decoded_text(bpe.decode(encoded, RANKS, P.PATTERN))
    want = sorted((str(r.doc_id), r.text or "") for r in hard.collect())
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == want
    row = bpe.encode(spark.createDataFrame([(1, "a 漢😀é b")], "doc_id long, text string"), RANKS, P.PATTERN, spans=True).first()
    assert row.starts[0] == 0 and row.ends[-1] == 7 and all(a < b for a, b in zip(row.starts, row.ends, strict=True))
    assert bpe.encode(hard.limit(0), RANKS, P.PATTERN).count() == 0


def test_counts_and_cache(spark, hard, tmp_path):
    cache = f"file://{tmp_path}/cache"
    plain = Tokenizer.from_file(JSON)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(plain.encode(r.text or "", add_special_tokens=False).ids)) for r in hard.collect())
    for _ in range(2):
        got = counts.token_counts(hard, JSON, cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 512) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == hard.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert counts.token_counts(hard.limit(0), JSON, cache).count() == 0
    # a stored count is used, not made anew
    d = hashlib.sha256(b"never encoded").hexdigest()
    version = stored.first().tokenizer
    spark.createDataFrame([(d, version, 77)], counts.CACHE).write.mode("append").parquet(cache)
    assert counts.token_counts(spark.createDataFrame([(1, "never encoded")], "doc_id long, text string"), JSON, cache).first().n_tokens == 77


def test_records(spark, hard, tmp_path):
    path = f"file://{tmp_path}/records"
    records.write(hard, path, JSON)
    plain = Tokenizer.from_file(JSON)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in hard.collect()))
    got = records.read(spark, path).join(records.starts(spark, path), ["shard", "offset"]).orderBy("start").collect()
    start = 0
    for (known, doc, text), r in zip(rows, got, strict=True):
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (doc if known else None, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = records.fetch(spark, path, spark.createDataFrame([(8,), (5,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in some) == [5, 5, 8]
    assert records.fetch(spark, path, spark.createDataFrame([(-5,)], "doc_id long")).count() == 0
    records.write(hard.limit(0), f"{path}-none", JSON)
    assert records.read(spark, f"{path}-none").count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_counts_of_a_hot_text(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(counts, "BROADCAST_ROWS", 0)
    df = spark.range(900).select(F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "the hot one").otherwise(F.concat(F.lit("n "), F.col("id").cast("string"))).alias("text"))
    plain = Tokenizer.from_file(JSON)
    want = sorted((str(r.doc_id), len(plain.encode(r.text, add_special_tokens=False).ids)) for r in df.collect())
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert sorted((str(r.doc_id), r.n_tokens) for r in counts.token_counts(df, JSON, cache).collect()) == want
    assert spark.read.parquet(cache).count() == 601


def test_fetch_opens_named_shards_only(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    records.write(spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(4), path, JSON)
    index = spark.read.parquet(f"{path}/index")
    wanted = index.where("doc_id = 7").first()
    for f in (tmp_path / "records" / "shards").glob("part-*"):
        if int(f.name[5:10]) != wanted.shard:
            f.write_bytes(b"damaged")
    assert index.select("shard").distinct().count() > 1
    assert [r.doc_id for r in records.fetch(spark, path, spark.createDataFrame([(7,)], "doc_id long")).collect()] == [7]


def test_shards_in_order(spark):
    names = spark.range(100_001).select(F.concat(F.lit("file:/x/part-"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("-a1b2-c000.txt")).alias("path"), "id")
    names = names.withColumn("path", F.when(F.col("id") > 99_999, "file:/x/part-100000-a1b2-c000.txt").otherwise(F.col("path")))
    assert names.where(records.shard_number(F.col("path")) != F.col("id")).count() == 0


def test_one_id_fills_many_shards(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    records.write(df, path, JSON)
    per = [r["count"] for r in records.read(spark, path).groupBy("shard").count().collect()]
    assert sum(per) == 4000 and len(per) > 1


def test_damaged_records():
    good = records.frame(3, np.array([1, 2, 10], "<u2")) + b"\n"
    assert [(d, i.tolist()) for _, _, d, i in records.unframe(good * 2)] == [(3, [1, 2, 10])] * 2
    for at in range(len(good)):
        with pytest.raises(records.BadRecord):
            list(records.unframe(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]))
    with pytest.raises(records.BadRecord):
        list(records.unframe(good[:-1]))


def test_packing(spark, hard):
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.sample(range(40), rng.randint(1, 8)))
        n, k = [rng.randint(1, 9) for _ in lengths], rng.randint(1, 5)
        pad = lambda tops: sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, n, strict=True))  # noqa: E731,B023
        best = min(pad([*s, lengths[-1]]) for m in range(min(k, len(lengths))) for s in itertools.combinations(lengths[:-1], m))
        got = packing.bounds(lengths, n, k)
        assert len(got) <= k and pad(got) == best
    rows = packing.pack_documents(hard, JSON, longest=64, buckets=4, budget=256).collect()
    plain = Tokenizer.from_file(JSON)
    total = sum(len(plain.encode(r.text or "", add_special_tokens=False).ids) for r in hard.collect())
    assert sum(r.n_tokens for r in rows) == total and all(r.n_tokens <= r.bucket_len for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket_len, r.batch_id), []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) and len(s) * max(b, 1) <= 256 for (b, _), s in batches.items())
    short = {}
    for (b, _), s in batches.items():
        short[b] = short.get(b, 0) + (len(s) < 256 // max(b, 1))
    assert all(v <= 1 for v in short.values())
    assert packing.pack_documents(hard.limit(0), JSON).count() == 0
