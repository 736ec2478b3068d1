import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle_check import agree  # noqa: E402

from tessera.llm import near, packing, quality, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    agree(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


# Each query against the plainest way to the same rows


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def rows_of(spark, name, key="doc_id"):
    rows = queries.QUERIES[name](spark, SF).collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_op1(spark, documents, library):
    rows = queries.op1_packing(spark, SF).collect()
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in documents.items()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    longest = packing.LONGEST
    assert {i: sorted(p) for i, p in pieces.items()} == {i: [(s, min(n - s, longest)) for s in range(0, max(n, 1), longest)] for i, n in want.items()}
    # the least padding of all ways to choose bounds, by a plain recurrence over the distinct lengths
    lengths = sorted({r.n_tokens for r in rows})
    many = {x: sum(r.n_tokens == x for r in rows) for x in lengths}
    best = [0.0] + [float("inf")] * len(lengths)
    for _ in range(packing.BUCKETS):
        best = [min([best[j], *(best[i] + sum(many[x] * (lengths[j - 1] - x) for x in lengths[i:j]) for i in range(j))]) if j else 0 for j in range(len(lengths) + 1)]
    assert sum(r.bucket_len - r.n_tokens for r in rows) == best[-1] and len({r.bucket_len for r in rows}) <= packing.BUCKETS
    slots = {}
    for r in rows:
        slots.setdefault(r.batch_id, []).append((r.slot, r.bucket_len))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) and len({b for _, b in v}) == 1 and (len(v) * v[0][1] <= packing.BUDGET or len(v) == 1) for v in slots.values())


def test_op2(spark):
    """The pages have one article each; its text by the standard library's parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        blocks = frozenset("article h1 h2 h3 p ul ol li div table tr td th blockquote pre section figure figcaption".split())

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.out, self.piece, self.skip = 0, [], [], []

        def border(self):
            if text := " ".join("".join(self.piece).split()):
                self.out.append(text)
            self.piece = []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if self.inside and (tag in ("script", "style", "aside", "nav", "form", "footer") or any(k in ("class", "id") and v in ("ad", "comments", "share") for k, v in attrs)):
                self.skip.append(tag)
            elif self.inside and tag in self.blocks:
                self.border()
            elif tag == "br":
                self.piece.append(" ")

        def handle_endtag(self, tag):
            if self.skip and tag == self.skip[-1]:
                self.skip.pop()
            elif self.inside and tag in self.blocks:
                self.border()
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.piece.append(data)

    found = rows_of(spark, "op2_html_text", "page_id")
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        parser = Article()
        parser.feed(r.html or "")
        parser.border()
        got = found[r.page_id]
        assert got.text == "\n".join(parser.out) and got.n_chars == len(got.text) and got.url == r.url


def test_op3(spark, documents):
    from test_dedup import brute_groups

    assert {i: (r.group_id, r.kept) for i, r in rows_of(spark, "op3_near_dedup").items()} == {i: (g, g == i) for i, g in brute_groups(documents).items()}


def test_op5(spark, documents):
    from test_text import brute_spans

    kinds = ["email", "ip", "card", "phone"]
    for i, r in rows_of(spark, "op5_pii").items():
        own = brute_spans(documents[i])
        listed = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in own)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in own) for x in range(4)]
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))


def test_op7(spark, documents):
    from test_tokens import library as ranks

    enc = ranks()
    for i, r in rows_of(spark, "op7_byte_bpe").items():
        ids = enc.encode_ordinary(documents[i])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(documents[i].encode()).hexdigest())


def test_op8(spark, documents):
    """Scores of a dense follow-the-regularised-leader, written out coordinate by coordinate from its definition."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learnt = sorted(i for i, y in labels.items() if y in (0, 1) and i in documents and zlib.crc32(str(i).encode()) % 3 != 1)
    assert len(learnt) <= quality.SAMPLE
    rows = []
    for i in learnt:
        at, x = quality.features(documents[i])
        total = {}
        for k, v in zip(at.tolist(), x.tolist(), strict=True):
            total[k] = total.get(k, 0.0) + v
        own = sorted(total)
        rows.append((i, labels[i], np.array(own, "<i4"), np.array([total[k] for k in own], "<f4").astype(float)))
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    n_weights = 1 << quality.BITS
    z, n = np.zeros(n_weights + 1), np.zeros(n_weights + 1)
    penalty = np.r_[np.full(n_weights, quality.L1), 0.0], np.r_[np.full(n_weights, quality.L2), quality.L2]

    def weights():
        return np.where(np.abs(z) <= penalty[0], 0.0, (np.sign(z) * penalty[0] - z) / ((quality.BETA + np.sqrt(n)) / quality.ALPHA + penalty[1]))

    for epoch in range(quality.EPOCHS):
        for j in np.random.default_rng(epoch).permutation(len(rows)):
            _, y, at, x = rows[j]
            dense = np.zeros(n_weights + 1)
            dense[at], dense[-1] = x, 1.0
            w = weights()
            g = (1 / (1 + np.exp(-(w @ dense))) - y) * dense
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / quality.ALPHA
            z += g - sigma * w
            n += g * g
    w = weights()
    for i, r in rows_of(spark, "op8_quality").items():
        at, x = quality.features(documents[i])
        score = 1 / (1 + np.exp(-(w[at] @ x + w[-1])))
        assert abs(r.score - score) < 1e-6 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_op9(spark, documents, library):
    for i, r in rows_of(spark, "op9_token_counts").items():
        n = len(library.encode(documents[i], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(documents[i].encode()), n, n > 512)


def test_op10(spark, documents, library):
    found, start = rows_of(spark, "op10_records"), 0
    for i in sorted(documents):
        ids = np.array([*library.encode(documents[i], add_special_tokens=False).ids, 0], "<u4")
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pipeline(spark, hard):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    assert kept["quality"] > kept["exact_dedup"] >= kept["near_dedup"] == kept["pii"] <= kept["packing"]
    texts = {r.doc_id: r.text for r in docs.sparkSession.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    bags = [near.shingles(near.words_of(texts[i])) for i in sorted(ids)]
    assert all(near.similarity(bags[i], bags[j]) < near.THRESHOLD for i in range(len(bags)) for j in range(i))
    assert len(ids) == kept["near_dedup"]


def test_stages_take_hard_rows(spark, hard):
    pipeline = pytest.importorskip("corpus_pipeline")
    from pyspark.sql import functions as F

    # with extra columns whose names the stages use themselves
    docs = hard.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "listed": F.lit("x"), "kept": F.lit("x"), "sha": F.lit("x"), "stays": F.lit("x"), "n": F.lit("x"), "shared": F.lit("x"), "text_sha256": F.lit("x")})
    assert pipeline.no_copies(spark, docs, SF).count() == docs.select(F.lower(F.coalesce("text", F.lit("")))).distinct().count()
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() >= 0
