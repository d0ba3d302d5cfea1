"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMO = 600_000  # pre-tokens a task keeps; it starts anew beyond, so memory is bounded and results do not change

# Letters, numbers and white space up to U+024F, where the standard library's faster engine can stand in for the
# Unicode classes of the published pattern. Texts with any character beyond take the full pattern.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \u0085 "
_NEAR = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_FAR = re.compile("[^\x00-ɏ]")


class PerfectHash:
    """A minimal perfect hash over byte strings by displacement: every key has a slot of its own among as many slots.

    Keys are put into buckets; the largest buckets look first for a displacement that sends their keys to free slots, and
    buckets of one key name their slot directly (a negative entry).
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        if len(set(keys)) != n:
            raise ValueError("keys repeat")
        self.buckets = max(1, n // 2)
        buckets: list[list[int]] = [[] for _ in range(self.buckets)]
        pairs = [self._pair(key) for key in keys]
        for i, (low, _) in enumerate(pairs):
            buckets[low % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        self.values = [0] * n
        free = bytearray(b"\x01") * n
        order = sorted(range(self.buckets), key=lambda b: -len(buckets[b]))
        later = []
        for b in order:
            own = buckets[b]
            if len(own) < 2:
                later.append(b)
                continue
            d = 0
            while True:
                spots = {(pairs[i][0] // self.buckets + d * pairs[i][1]) % n for i in own}
                if len(spots) == len(own) and all(free[s] for s in spots):
                    break
                d += 1
            self.shift[b] = d
            for i in own:
                self._put((pairs[i][0] // self.buckets + d * pairs[i][1]) % n, keys[i], i, free)
        rest = (s for s in range(n) if free[s])
        for b in later:
            for i in buckets[b]:
                spot = next(rest)
                self.shift[b] = -spot - 1
                self._put(spot, keys[i], i, free)

    @staticmethod
    def _pair(key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h & (1 << 64) - 1, (h >> 64) | 1

    def _put(self, spot: int, key: bytes, value: int, free: bytearray) -> None:
        free[spot] = 0
        self.slots[spot], self.values[spot] = key, value

    def get(self, key: bytes) -> int | None:
        """The key's place in the list of keys, None for any other string."""
        if not self.n:
            return None
        low, step = self._pair(key)
        d = self.shift[low % self.buckets]
        spot = -d - 1 if d < 0 else (low // self.buckets + d * step) % self.n
        return self.values[spot] if self.slots[spot] == key else None


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a rank file (base64 token, rank); ranks are 0 to n - 1."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class Codec:
    """Encoder and decoder over a list of tokens in rank order and a pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str, published: str | None = None):
        self.tokens = tokens
        self.table = PerfectHash(tokens)
        self.ranks = {token: i for i, token in enumerate(tokens)}
        self.near = _NEAR if pattern == published else None
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        if self.near and not _FAR.search(text):
            return self.near.findall(text)
        return self.pattern.findall(text)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair is a token."""
        ranks = self.ranks
        n = len(piece)
        ends = list(range(1, n + 1))      # where the token that starts here ends; 0: merged into an earlier one
        before = list(range(-1, n - 1))   # start of the token to the left
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            middle = ends[at]
            if not middle or middle >= n or ends[middle] != end:
                continue  # one of the two has changed since
            ends[at], ends[middle] = end, 0
            if end < n:
                before[end] = at
                rank = ranks.get(piece[at : ends[end]])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, ends[end]))
            left = before[at]
            if left >= 0:
                rank = ranks.get(piece[left:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, end))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : ends[at]]])
            at = ends[at]
        return out

    def _ids(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.table.get(raw)
        return (whole,) if whole is not None else tuple(self.merge(raw))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces, memo = self.split(text), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for piece in set(pieces).difference(memo):
            memo[piece] = self._ids(piece)
        return list(chain.from_iterable(map(memo.__getitem__, pieces)))

    def decode(self, ids: list[int] | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids or ()))


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """The task's codec: built once in a Python worker from the broadcast tokens."""
    tokens, pattern, published, key = shared.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, pattern, published)
    return _codecs[key]


def share_vocabulary(spark: SparkSession, path: str, pattern: str | None = None):
    """Broadcast a vocabulary (at most some 100,000 tokens: its file is read on the driver, executors need none)."""
    import public_tokenizers

    tokens = read_ranks(path)
    pattern = pattern or public_tokenizers.PATTERN
    key = hashlib.sha256(b"\0".join(tokens) + pattern.encode()).hexdigest()
    return spark.sparkContext.broadcast((tokens, pattern, public_tokenizers.PATTERN, key))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids (array<int>) of a text column; a null or empty text has none."""
    shared = share_vocabulary(df.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(texts):
        codec = _codec(shared)
        return texts.map(codec.encode)

    return df.withColumn(out, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``df`` with the bytes of a column of ids; null ids give no bytes."""
    shared = share_vocabulary(df.sparkSession, path)

    @F.pandas_udf("binary")
    def joined(rows):
        tokens = shared.value[0]
        return rows.map(lambda row: b"".join(tokens[i] for i in row) if row is not None else b"")

    return df.withColumn(out, joined(F.col(ids)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, then its ids decoded, in one pass.

    A null or empty text has no ids and the digests of the empty string. Rows may repeat and doc_id may be null: each
    row gives one. Other columns are not read. Nothing is shuffled.
    """
    shared = share_vocabulary(docs.sparkSession, path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        names = [str(i) for i in range(len(codec.tokens))]
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
