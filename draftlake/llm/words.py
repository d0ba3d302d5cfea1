"""Words, word hashes and shingles of whole Arrow batches, by numpy over the text bytes.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``. Null and empty texts have no words.
Work is done in chunks of whole documents of about ``CHUNK`` bytes, so memory stays bounded; one document longer than
that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        have = _powers[name] = out
    return have[:n]


@dataclass
class Words:
    """The words of some whole documents: ``rows`` are their rows in the batch, ``bounds`` split the word arrays by document."""

    rows: range
    data: np.ndarray
    byte_bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.bounds))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string array; null rows are empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, bounds


def chunks(texts: pa.Array, fold: bool = False, size: int = CHUNK) -> Iterator[Words]:
    """Words of the texts, in order, ``size`` bytes at once; ``fold`` lower-cases A-Z only."""
    raw, bounds = text_bytes(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield _words(raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], range(first, last), fold)
        first = last


def _words(data: np.ndarray, byte_bounds: np.ndarray, rows: range, fold: bool) -> Words:
    n = len(data)
    if fold:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    begins, finishes = inside.copy(), inside.copy()
    cut = np.zeros(n + 1, bool)
    cut[byte_bounds] = True
    if n:
        begins[1:] &= ~inside[:-1] | cut[1:n]
        finishes[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=total[1:])
    hashes = (total[ends] - total[starts]) * _power("down", _INVERSE, n + 1)[starts]
    hashes = mix(hashes ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(rows, data, byte_bounds, starts, ends, np.searchsorted(starts, byte_bounds), hashes)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``k`` words inside one document."""
    n = len(w.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = w.doc_of_word()
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, mix(_run_hash(w.hashes, n, k)[at])


def _run_hash(hashes: np.ndarray, n: int, k: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += hashes[j : j + n]
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes): A-Z lower-cased; fewer than ``k`` words make one shingle, none an empty set."""
    for w in chunks(texts, fold=True):
        at, hashes = windows(w, k)
        split = np.searchsorted(at, w.bounds)
        for i, row in enumerate(w.rows):
            own = hashes[split[i] : split[i + 1]]
            words = w.hashes[w.bounds[i] : w.bounds[i + 1]]
            if 0 < len(words) < k:
                own = mix(_run_hash(words, 1, len(words)) + np.uint64(len(words)))
            yield row, np.unique(own)
