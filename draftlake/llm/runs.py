"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array (suffix array, its inverse, LCP intervals).

Suffixes of all documents of a chunk are sorted together; words of different documents count as different, so nothing
reaches over a document's end. A square of period q that its neighbour on the right does not continue consists of two
suffixes, q apart, that part after exactly q words: both lie in one LCP interval of depth q, in different children. So the
suffixes of all children but the largest are tried, i with i + q and i - q by the inverse array, which is n log n tries in
all and needs no tree. Rotating such a square to the left as far as it goes gives the whole run that it ends.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.words import Words, chunks, mix

POWER = 4      # a run is as many periods long at least
LEAST = 6      # and as many words


@dataclass
class SuffixArray:
    """``levels[t]`` numbers the runs of 2**t symbols: equal numbers, equal runs. The last level is the inverse of ``order``."""

    order: np.ndarray
    levels: list[np.ndarray]
    lcp: np.ndarray

    @property
    def inverse(self) -> np.ndarray:
        return self.levels[-1]


def suffix_array(symbols: np.ndarray) -> SuffixArray:
    """Prefix doubling; a round sorts only suffixes that are still equal to another, so texts with few repeats end early."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, length = [rank], 1

    def shared(new: np.ndarray) -> np.ndarray:
        """Which places hold a suffix of a group of two or more."""
        lone = new.copy()
        lone[:-1] &= new[1:]
        return ~lone

    live = np.flatnonzero(shared(new))
    while len(live):
        suffix = order[live]
        ahead = suffix + length
        behind = np.where(ahead < n, rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        key = rank[suffix].astype(np.int64) * (n + 1) + behind
        by = np.argsort(key, kind="stable")
        key, suffix = key[by], suffix[by]
        order[live] = suffix
        new = np.ones(len(live), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[suffix] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        levels.append(rank)
        length *= 2
        live = live[shared(new)]
    return SuffixArray(order, levels, _lcp(order, levels))


def _lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[p]: symbols that the suffixes at places p - 1 and p share; lcp[0] = lcp[n] = 0."""
    n = len(order)
    lcp = np.zeros(n + 1, np.int64)
    place = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[place - 1], order[place]
    same = np.zeros(len(place), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        i, j = a + same, b + same
        inside = np.maximum(i, j) < n
        equal = inside & (levels[t][np.minimum(i, n - 1)] == levels[t][np.minimum(j, n - 1)])
        same += equal.astype(np.int64) << t
    lcp[place] = same
    return lcp


def _intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, end) for every place with an LCP above 0: the widest stretch of suffixes around it that share as much."""
    place = np.flatnonzero(lcp)
    if not len(place):
        return place, place, place
    depth = lcp[place]
    lows = [lcp]      # lows[t][p]: the least of 2**t places from p on
    breaks = np.flatnonzero(np.diff(place) > 1)
    widest = int(np.diff(np.concatenate([[-1], breaks, [len(place) - 1]])).max())
    while 1 << len(lows) <= widest:
        half = 1 << (len(lows) - 1)
        lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
    end, first = place.copy(), place.copy()
    for t in range(len(lows) - 1, -1, -1):
        low, step = lows[t], 1 << t
        end += np.where((end < len(low)) & (low[np.minimum(end, len(low) - 1)] >= depth), step, 0)
        back = first - step
        # lows[t][q] covers q .. q + step - 1, the places just before ``first``
        first = np.where((back >= 0) & (low[np.clip(back, 0, len(low) - 1)] >= depth), back, first)
    return place, first - 1, end


def squares(sa: SuffixArray, power: int = POWER) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares whose period the next symbol does not continue, of intervals wide enough for ``power`` periods."""
    nothing = np.zeros(0, np.int64)
    place, first, end = _intervals(sa.lcp)
    # The last period of a run and those before it all start with the same symbols.
    wide = end - first >= power
    place, first, end = place[wide], first[wide], end[wide]
    if not len(place):
        return nothing, nothing
    n, inverse = len(sa.order), sa.inverse
    by = np.argsort(first * (n + 1) + end, kind="stable")
    place, first, end = place[by], first[by], end[by]
    opens = np.ones(len(place), bool)
    opens[1:] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
    group = np.cumsum(opens) - 1
    stop = np.where(np.append(opens[1:], True), end, np.append(place[1:], 0))
    head = np.flatnonzero(opens)
    # Children: one from every place on, and one before the first place of each interval.
    child_from, child_to = np.concatenate([place, first[head]]), np.concatenate([stop, place[head]])
    child_of = np.concatenate([group, np.arange(len(head))])
    size = child_to - child_from
    ranked = np.lexsort((child_from, size, child_of))
    largest = np.append(child_of[ranked][1:] != child_of[ranked][:-1], True)
    kept = ranked[~largest]
    child_from, child_to, child_of, size = child_from[kept], child_to[kept], child_of[kept], size[kept]
    depth, low, high = sa.lcp[place[head]][child_of], first[head][child_of], end[head][child_of]
    own = np.repeat(np.arange(len(kept)), size)
    i = sa.order[np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + child_from[own]]
    q = depth[own]
    starts, periods = [], []
    for j, start in ((i + q, i), (i - q, i - q)):
        there = inverse[np.clip(j, 0, n - 1)]
        hit = (j >= 0) & (j < n) & (there >= low[own]) & (there < high[own]) & ((there < child_from[own]) | (there >= child_to[own]))
        starts.append(start[hit])
        periods.append(q[hit])
    key = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(periods))
    return key // (n + 1), key % (n + 1)


def runs(symbols: np.ndarray, power: int = POWER, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of at least ``power`` periods and ``least`` symbols, with their smallest period, by start and period."""
    nothing = np.zeros(0, np.int64)
    if len(symbols) < least:
        return nothing, nothing, nothing
    sa = suffix_array(symbols)
    start, period = squares(sa, power)
    end = start + 2 * period
    for t in range(len(sa.levels) - 1, -1, -1):
        back, level = start - (1 << t), sa.levels[t]
        start = np.where((back >= 0) & (level[np.maximum(back, 0)] == level[np.maximum(back, 0) + period]), back, start)
    long = end - start >= np.maximum(least, power * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    # A multiple of the period finds the same stretch again.
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[once], end[once], period[once]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def plain_order(w: Words, doc_ids: list) -> np.ndarray:
    """The words as they stand."""
    return np.arange(len(w.starts))


def folded_order(w: Words, doc_ids: list) -> np.ndarray:
    """The words as the registered query numbers them: a tenth of the documents, by the CRC-32 of the doc_id, repeat a stretch to their end.

    A null doc_id has no CRC and changes nothing.
    """
    order = np.arange(len(w.starts))
    for k, doc_id in enumerate(doc_ids):
        first, n = int(w.bounds[k]), int(w.bounds[k + 1] - w.bounds[k])
        if doc_id is None or not n:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            order[first + a : first + n] = first + a + np.arange(n - a) % p
    return order


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@dataclass
class Found:
    """Runs of the documents of a chunk, places counted in the chunk, and which words stay; ``order`` says which word stands where."""

    words: Words
    order: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray
    kept: np.ndarray

    def collapsed(self) -> list[bytes]:
        """Each document's kept words, joined by one space."""
        w = self.words
        left = self.order[self.kept]
        size = w.ends[left] - w.starts[left] + 1
        after = np.cumsum(size)
        at = np.arange(int(after[-1]) if len(after) else 0) - np.repeat(after - size, size) + np.repeat(w.starts[left], size)
        text = np.append(w.data, np.uint8(32))[at]
        text[after - 1] = 32
        bounds = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(self.kept)])[w.bounds]]
        raw = text.tobytes()
        return [raw[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def find(w: Words, order: np.ndarray, power: int = POWER, least: int = LEAST) -> Found:
    doc_of = w.doc_of_word()
    symbols = mix(w.hashes[order] + doc_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    start, end, period = runs(symbols, power, least)
    change = np.zeros(len(order) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return Found(w, order, doc_of[start], start, end, period, np.cumsum(change[:-1]) == 0)


def _rows(w: Words, doc_ids: list, numbered) -> Iterator[tuple]:
    f = find(w, numbered(w, doc_ids))
    start, length = f.start - w.bounds[f.doc], f.end - f.start
    best = np.lexsort((f.period, start, -(length / f.period), f.doc))
    lead = {int(f.doc[r]): r for r in best[::-1].tolist()}
    bounds = np.searchsorted(f.doc, np.arange(len(doc_ids) + 1))
    for k, text in enumerate(f.collapsed()):
        own = range(int(bounds[k]), int(bounds[k + 1]))
        lines = "".join(f"{start[r]},{length[r]},{f.period[r]}\n" for r in own)
        r = lead.get(k)
        top = (None,) * 4 if r is None else (int(start[r]), int(length[r]), int(f.period[r]), int(1000 * length[r] // f.period[r]))
        yield doc_ids[k], len(own), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def detect(docs: DataFrame, numbered=folded_order) -> DataFrame:
    """One row of ``SCHEMA`` for every row of ``docs`` (doc_id, text): its runs, the strongest one, and what stays without repeats.

    ``numbered`` says which word stands at which place (``plain_order``: as in the text). Null and empty texts have no words
    and no runs; repeated rows have rows each; a null doc_id stays null; other columns are not read; an empty table gives no
    rows. Nothing is shuffled. A task holds chunks of about a megabyte; a longer text is a chunk of its own and takes some
    200 bytes of memory a word.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for w in chunks(batch.column(1)):
                rows = list(_rows(w, ids[w.rows.start : w.rows.stop], numbered))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.string()] * 2, strict=True)],
                                                 names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, SCHEMA)


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with periodic runs of words cut to their first period.

    Only texts with such a run change: their kept words are joined by one space. Null texts stay null; columns stay.
    """

    @F.pandas_udf("string")
    def shortened(texts):
        import pandas as pd

        out = texts.copy()
        for w in chunks(pa.array(texts, pa.large_string(), from_pandas=True)):
            f = find(w, plain_order(w, []))
            collapsed = f.collapsed() if len(f.doc) else []
            for k in np.unique(f.doc).tolist():
                out.iloc[w.rows.start + k] = collapsed[k].decode()
        return pd.Series(out)

    return docs.withColumn("text", shortened("text"))
