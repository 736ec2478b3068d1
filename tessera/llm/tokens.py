"""Token ids by the tokenizers and sentencepiece libraries, for use inside Arrow tasks."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os
from pathlib import Path

import numpy as np

from .hashing import span_words, words_hash

#: Chunks kept per Python worker (some 45 bytes each); beyond it the memo starts anew. Bounds memory, never changes
#: a result: a chunk is found by a hash of its bytes, but the bytes decide.
MEMO_CHUNKS = 1_000_000
#: Words that hold a chunk with what stands before it. Longer chunks are known by a dictionary of their bytes, or, from
#: KEPT_BYTES on, not kept at all.
KEY_WORDS = 2
KEY_BYTES, KEPT_BYTES, LONG_CHUNKS = 8 * KEY_WORDS - 1, 256, 50_000
#: From here on, library and Python may not agree on what a letter is; and the marks that never join letters.
FIRST_UNSURE = "\u0530"
MARKS = ".,;:!?)]}*%&$#|\"-"
#: Bytes of text cut into chunks at once.
AT_ONCE = 1 << 20


@functools.cache
def byte_alphabet() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte: itself if it is a visible
    Latin-1 character, else the next free one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _halves(token: bytes, ranks: dict[bytes, int], below: int) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes ``token``."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            raise ValueError(f"no merge leads to {token!r}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@functools.lru_cache(4)
def spec_from_ranks(path: str, pattern: str) -> str:
    """The JSON of a tokenizers byte-level BPE with the ranks of a .tiktoken file, splitting by ``pattern``."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    lines = Path(path).read_bytes().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    shown = byte_alphabet()
    spell = lambda token: "".join(map(shown.__getitem__, token))
    merges = [tuple(map(spell, _halves(t, ranks, r))) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    made = Tokenizer(models.BPE({spell(t): r for t, r in ranks.items()}, merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def load_spec(path: str, pattern: str | None = None) -> tuple[str, str | bytes]:
    """(kind, content) of a tokenizer file, read on the driver; its size is that of a vocabulary, whatever the corpus."""
    if path.endswith(".tiktoken"):
        if pattern is None:
            raise ValueError("a rank file needs the pattern that cuts texts")
        return "json", spec_from_ranks(path, pattern)
    if path.endswith(".model"):
        return "piece", Path(path).read_bytes()
    return "json", Path(path).read_text(encoding="utf-8")


def spec_digest(spec: tuple[str, str | bytes]) -> str:
    body = spec[1] if isinstance(spec[1], bytes) else spec[1].encode()
    return hashlib.sha256(spec[0].encode() + b"\0" + body).hexdigest()


class Memo:
    """Ids of chunks by their bytes. Rows are in order of arrival: a chunk's words, and its place in one pool of ids;
    sorted hashes of the words lead to the rows."""

    def __init__(self, dtype: np.dtype):
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.words = [np.zeros(1 << 14, np.uint64) for _ in range(KEY_WORDS)]
        self.place, self.length = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.uint16)
        self.pool, self.used = np.zeros(1 << 16, dtype), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.row[at], -1)

    def room(self, ids: list[int]) -> int:
        """Puts ids behind those in use, where the next call overwrites them unless they are kept; their place."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.r_[self.pool[: self.used], np.zeros(self.used // 3 + 2 * len(ids), self.pool.dtype)]
        self.pool[self.used : self.used + len(ids)] = ids
        return self.used

    def add(self, keys: np.ndarray, words: list[np.ndarray], ids: list[int], lengths: list[int]) -> None:
        """``keys`` ascending and new; ``ids`` of all chunks, one after the other."""
        n, more, length = len(self.keys), len(keys), np.array(lengths, np.int32)
        if n + more > len(self.place):
            grown = lambda a: np.r_[a[:n], np.zeros(n // 3 + 2 * more, a.dtype)]
            self.words, self.place, self.length = [grown(w) for w in self.words], grown(self.place), grown(self.length)
        for own, new in zip(self.words, words, strict=True):
            own[n : n + more] = new
        self.place[n : n + more] = self.room(ids) + np.cumsum(length, dtype=np.int64) - length
        self.length[n : n + more] = length
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.row = np.insert(self.keys, at, keys), np.insert(self.row, at, np.arange(n, n + more, dtype=np.int32))


def _uneven(raw: np.ndarray) -> np.ndarray:
    """Places where cutting at single spaces and newlines may not agree with the pre-tokenizer: white space next to
    white space, or other white space than these two."""
    kind = _KIND[raw]
    odd = [np.flatnonzero(kind == 2), np.flatnonzero((kind[1:] > 0) & (kind[:-1] > 0)), np.flatnonzero((kind[1:] > 0) & (kind[:-1] > 0)) + 1]
    for lead, tails in _WIDE_SPACE.items():
        at = np.flatnonzero(raw == lead)
        for tail in tails:
            own = at[at + len(tail) < len(raw)]
            for k, byte in enumerate(tail):
                own = own[raw[own + 1 + k] == byte]
            odd.append(own)
    return np.concatenate(odd)


_KIND = np.zeros(256, np.uint8)
#: Among them the zero byte, with which chunks are filled up.
_KIND[[0, 9, 11, 12, 13, 28, 29, 30, 31]] = 2
_KIND[[10, 32]] = 1
#: Every other character that counts as white space, in UTF-8, by first byte.
_WIDE_SPACE: dict[int, list[bytes]] = {}
for _c in map(chr, range(0x80, 0x3001)):
    if _c.isspace():
        _WIDE_SPACE.setdefault(_c.encode()[0], []).append(_c.encode()[1:])


class Encoder:
    """Encodes whole texts with the library. For byte-level JSON vocabularies, evenly spaced texts are cut at spaces
    and newlines, where no token crosses, and each distinct chunk is encoded once; other texts are encoded whole."""

    def __init__(self, spec: tuple[str, str | bytes], specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kind, self.specials = spec[0], []
        if self.kind == "piece":
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=spec[1])
            self.size, self.chunks = self.library.get_piece_size(), False
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(spec[1])
            self.library.encode_special_tokens = specials_as_text
            self.library.no_truncation()
            self.library.no_padding()
            self.size = self.library.get_vocab_size(with_added_tokens=True)
            form = json.loads(spec[1])
            cut = json.dumps(form.get("pre_tokenizer") or {})
            self.chunks = form.get("normalizer") is None and '"ByteLevel"' in cut and '"add_prefix_space": true' not in cut
            self.specials = [] if specials_as_text else [t["content"] for t in form.get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.memo = Memo(self.dtype)
        self.long: dict[tuple[int, bytes], list[int]] = {}
        if self.chunks:
            self.newline = self._ids(["\n"])[0].tolist()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.kind == "piece":
            return [np.array(x, self.dtype) for x in self.library.encode(texts, num_threads=1)]
        return [np.array(x.ids, self.dtype) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str], lead: list[int]) -> tuple[list[int], list[int]]:
        """All ids of chunks after nothing (0), a space (1) or a newline (2), and how many each has. A run of letters,
        with marks after it or not, is cut as the pre-tokenizer would, and goes to the library's model directly."""
        merge, shown, ids, lengths = self.library.model.tokenize, byte_alphabet(), [], []
        for c, b in zip(chunks, lead, strict=True):
            n = len(ids)
            word = c.rstrip(MARKS)
            if b == 2:
                ids += self.newline
            if word.isalpha() and max(word) < FIRST_UNSURE:
                spelt = word if word.isascii() else "".join(map(shown.__getitem__, word.encode()))
                ids += [t.id for t in merge("\u0120" + spelt if b == 1 else spelt)]
                if len(word) < len(c):
                    ids += [t.id for t in merge(c[len(word) :])]
            else:
                ids += self._ids([" " + c if b == 1 else c])[0].tolist()
            lengths.append(len(ids) - n)
        return ids, lengths

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        even, size = [], 0
        for i, x in enumerate(texts):
            if not self.chunks or not x or len(x) > AT_ONCE or any(s in x for s in self.specials):
                continue
            if size + len(x) > AT_ONCE:
                self._cut(texts, even, out)
                even, size = [], 0
            even.append(i)
            size += len(x)
        self._cut(texts, even, out)
        rest = [i for i, x in enumerate(out) if x is None]
        for start in range(0, len(rest), 64):
            part = rest[start : start + 64]
            for i, ids in zip(part, self._ids([texts[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def _cut(self, texts: list[str], which: list[int], out: list[np.ndarray | None]) -> None:
        """Puts the ids of evenly spaced texts in ``out``."""
        bodies = [texts[i].encode() for i in which]
        for again in (True, False):
            if not bodies:
                return
            joined = b"\n".join(bodies)
            raw = np.frombuffer(joined, np.uint8)
            ends = np.cumsum([len(b) + 1 for b in bodies])
            odd = np.unique(np.searchsorted(ends, _uneven(raw), "right"))
            if not len(odd):
                break
            if again:
                odd = set(odd.tolist())
                which, bodies = ([x for k, x in enumerate(y) if k not in odd] for y in (which, bodies))
        gaps = np.flatnonzero(_KIND[raw] == 1)
        start, end = np.r_[0, gaps + 1], np.r_[gaps, len(raw)]
        # what stands before a chunk: 0 the start of a text, 1 a space, 2 a newline
        before = np.r_[0, np.where(raw[gaps] == 32, 1, 2)].astype(np.uint64)
        heads = np.r_[0, ends[:-1]]
        first = np.searchsorted(start, heads)
        before[first] = 0
        if len(self.memo.keys) > MEMO_CHUNKS:
            self.memo = Memo(self.dtype)
        place, length = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        short = np.flatnonzero(end - start <= KEY_BYTES)
        place[short], length[short], unlike = self._short(joined, raw, start[short], end[short], before[short])
        long = np.flatnonzero(end - start > KEY_BYTES)
        if len(long):
            each = [self._long(int(before[i]), joined[start[i] : end[i]]) for i in long.tolist()]
            length[long] = [len(x) for x in each]
            place[long] = self.memo.room([i for x in each for i in x]) + np.cumsum(length[long]) - length[long]
        done = np.cumsum(length)
        ids = self.memo.pool[np.repeat(place - (done - length), length) + np.arange(done[-1])]
        borders = np.r_[(done - length)[first], done[-1]].tolist()
        other = set((np.searchsorted(first, short[unlike], "right") - 1).tolist())
        for k, i in enumerate(which):
            if k not in other:
                out[i] = ids[borders[k] : borders[k + 1]]

    def _short(self, joined: bytes, raw: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the ids of each chunk, and which chunks share a hash with other bytes: those are not told."""
        words = span_words(raw, start, end, KEY_WORDS)
        words[-1] |= before << np.uint64(8 * (KEY_BYTES % 8))
        keys, at, inverse = np.unique(words_hash(words), return_index=True, return_inverse=True)
        row = self.memo.find(keys)
        new = np.flatnonzero(row < 0)
        if len(new):
            chunks = [joined[s:e].decode() for s, e in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
            row[new] = np.arange(len(self.memo.keys), len(self.memo.keys) + len(new))
            self.memo.add(keys[new], [w[at[new]] for w in words], *self._learn(chunks, before[at[new]].tolist()))
        row = row[inverse]
        unlike = np.zeros(len(row), bool)
        for own, word in zip(self.memo.words, words, strict=True):
            unlike |= own[row] != word
        return self.memo.place[row], self.memo.length[row], np.flatnonzero(unlike)

    def _long(self, lead: int, chunk: bytes) -> list[int]:
        known = self.long.get((lead, chunk))
        if known is None:
            known = self._learn([chunk.decode()], [lead])[0]
            if len(chunk) <= KEPT_BYTES:
                if len(self.long) >= LONG_CHUNKS:
                    self.long.clear()
                self.long[lead, chunk] = known
        return known


_made: dict[tuple, Encoder] = {}


def encoder(shipped, specials_as_text: bool = False) -> Encoder:
    """The worker's encoder for a broadcast (digest, spec); Python workers are reused, so it is made once in each."""
    digest, spec = shipped.value
    key = digest, specials_as_text
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(spec, specials_as_text)
    return _made[key]


def ship(spark, spec: tuple[str, str | bytes]):
    """Broadcasts a tokenizer file: tens of MB at most, whatever the corpus."""
    if len(spec[1]) > 64 << 20:
        raise ValueError("a tokenizer file of more than 64 MB is not broadcast")
    return spark.sparkContext.broadcast((spec_digest(spec), spec))
