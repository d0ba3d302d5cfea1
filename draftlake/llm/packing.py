"""Packing by shortest-pack-first over the length histogram: packs are planned for lengths, then joined back to documents by rank."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.bpe import Codec
from draftlake.llm.ranks import gapless
from draftlake.session import cut

CONTEXT = 2048
END_ID = 1


def plan_packs(histogram: dict[int, int], context: int = CONTEXT) -> list[tuple[int, tuple[int, ...]]]:
    """[(count, lengths)]: packing patterns for a histogram of lengths from 1 to ``context``.

    Lengths are placed longest first. Each goes into the pattern that is filled least, as often as both counts allow,
    which splits that pattern; if it does not fit there it fits nowhere, and a new pattern opens. The work depends on
    ``context`` and not on the number of documents.
    """
    open_packs: list[tuple[int, int, int, tuple[int, ...]]] = []  # filled, serial, count, lengths
    serial = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and open_packs[0][0] + length <= context:
                filled, _, count, lengths = heapq.heappop(open_packs)
                used = min(left, count)
                if used < count:
                    serial += 1
                    heapq.heappush(open_packs, (filled, serial, count - used, lengths))
                new = (filled + length, serial + 1, used, (*lengths, length))
            else:
                used = left
                new = (length, serial + 1, left, (length,))
            serial += 1
            heapq.heappush(open_packs, new)
            left -= used
    return [(count, lengths) for _, _, count, lengths in sorted(open_packs, key=lambda p: p[1])]


def slots_of(packs: list[tuple[int, tuple[int, ...]]], context: int = CONTEXT) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of its places, in rank order."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            rank = given.get(length, 0)
            found.setdefault(length, []).append((rank, sequence, offset))
            given[length] = rank + count
            offset += length
        sequence += count
    return {length: tuple(np.array(x, np.int64) for x in zip(*places, strict=True)) for length, places in found.items()}


def read_tokens(path: str) -> list[bytes]:
    """Tokens in id order from a byte-level BPE file in the JSON form of the tokenizers library, without added tokens."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    # That form writes each byte as one printable character: printable Latin-1 stands for itself, the others follow from U+0100.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    added = {t["content"] for t in data.get("added_tokens", ())}
    ids = {i: bytes(map(byte_of.__getitem__, t)) for t, i in data["model"]["vocab"].items() if t not in added}
    return [ids[i] for i in range(len(ids))]


def read_added(path: str) -> dict[str, int]:
    """Added tokens of such a file and their ids; the library finds them in a text before anything else."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens", ())
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that take in white space or stand as whole words only are not supported")
    return {t["content"]: t["id"] for t in added}


_encoders: dict[str, tuple] = {}


def _encoder(shared) -> tuple:
    """(tiktoken's encoder of the same ranks, this library's own), built once in a Python worker."""
    tokens, pattern, added, key = shared.value
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = (tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens=added), Codec(tokens, pattern, pattern))
    return _encoders[key]


def token_ids(encoder: tuple, text: str) -> np.ndarray:
    """Unsigned 32-bit ids of a text; strings of added tokens have the ids of those, as in the tokenizers library."""
    quick, own = encoder
    try:
        return quick.encode_to_numpy(text, allowed_special="all")
    except ValueError:  # its regular expressions refuse very long runs of white space
        added = sorted(quick.special_tokens_set, key=len, reverse=True)
        parts = re.split(f"({'|'.join(map(re.escape, added))})", text) if added else [text]
        return np.array([i for part in parts for i in ([quick.encode_single_token(part)] if part in quick.special_tokens_set else own.encode(part))], np.uint32)


PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, piece long"


def cut_pieces(docs: DataFrame, path: str, context: int = CONTEXT, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every document's tokens and its end token as pieces of ``context`` ids and one shorter rest. Nothing is shuffled.

    A null or empty text is the end token alone. ``piece`` tells rows apart within the result of one run.
    """
    tokens = read_tokens(path)
    pattern = public_tokenizers.PATTERN
    added = read_added(path)
    key = hashlib.sha256(b"\0".join(tokens) + json.dumps(added, sort_keys=True).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((tokens, pattern, added, key))

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            kept = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(encoder, text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), context):
                    piece = ids[start : start + context]
                    for column, value in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), start // context), strict=True):
                        column.append(value)
                    if keep_ids:
                        kept.append(piece)
            arrays = [pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(out)] + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PIECE.split(", ")] + ["ids"] * keep_ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_batches, PIECE + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, path: str, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece of every document in its sequence.

    The histogram of lengths has at most ``context`` rows, so it and the plan are made on the driver; pieces of one length
    are numbered without gathering them and take the plan's places in that order. Full pieces are sequences of their own.
    Repeated rows are pieces of their own; a null doc_id stays null; an empty table gives no rows. Other columns are not read.
    """
    pieces = cut(cut_pieces(docs, path, context, end_id).drop("piece"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = pieces.sparkSession.sparkContext.broadcast(slots_of(plan_packs(histogram, context), context))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((2, len(rank)), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for value in np.unique(lengths):
            at = np.flatnonzero(lengths == value)
            first, sequence, offset = places.value[int(value)]
            slot = np.searchsorted(first, ranks[at], "right") - 1
            out[0, at], out[1, at] = sequence[slot] + ranks[at] - first[slot], offset[slot]
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    numbered = gapless(pieces, ["length"], "rank", bins=32)
    return numbered.select("*", place("length", "rank").alias("place")).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "place.sequence_id", "place.offset")
