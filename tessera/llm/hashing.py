"""Spans of bytes as numbers, many at once, the same wherever a span stands."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_MIX_A, _MIX_B = _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15)
#: Spans of at most so many bytes fit in WORDS 64-bit words; longer ones are digested by themselves.
WORDS = 4
SHORT = 8 * WORDS
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX_A
    return (h ^ (h >> _U(29))) * _MIX_B


def span_words(values: np.ndarray, start: np.ndarray, end: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The bytes of each span [start, end), of at most 8 bytes a word, as little-endian words, filled up with zeros."""
    padded = np.concatenate([values, np.zeros(SHORT, np.uint8)])
    at_byte = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    length = end - start
    out = [at_byte[start] & _MASK[np.minimum(length, 8)]]
    for k in range(1, words):
        word, more = np.zeros(len(start), _U), np.flatnonzero(length > 8 * k)
        word[more] = at_byte[start[more] + 8 * k] & _MASK[np.minimum(length[more] - 8 * k, 8)]
        out.append(word)
    return out


def words_hash(words: list[np.ndarray]) -> np.ndarray:
    h = mix(words[0] + _U(0xA24BAED4963EE407))
    for word in words[1:]:
        more = np.flatnonzero(word)
        h[more] = mix(h[more] * _U(0x9FB21C651E98DF25) + word[more])
    return mix(h)


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each span [start, end) of bytes: of its words if it is short, else of its BLAKE2 digest."""
    out, length = np.empty(len(start), _U), end - start
    short = np.flatnonzero(length <= SHORT)
    out[short] = mix(words_hash(span_words(values, start[short], end[short])) + length[short].astype(_U))
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(values[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out
