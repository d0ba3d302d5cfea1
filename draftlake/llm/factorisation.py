"""A quality classifier by a factorisation machine over hashed words, structure statistics and the length on record.

Training takes a bounded sample of labelled rows (``SAMPLE``, those of least hash); scoring reads every whole text once and
costs time linear in its words: pairwise interactions of rank ``RANK`` come from the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.words import Words, chunks

BUCKETS = 1 << 14      # hashed words
RANK = 8
SAMPLE = 6000          # labelled rows that training may see; documented bound
EPOCHS = 8
BATCH = 64
RATE = 0.02
DECAY = 1e-4
SEED = 7

STATISTICS = (
    "log_words", "word_bytes", "symbols", "capitals", "digits", "pipes", "stops", "commas", "exclamations", "lines",
    "distinct_words", "repeated_words", "high_bytes", "log_chars")
_CLASSES = [b"#*$%&<>~^", bytes(range(65, 91)), b"0123456789", b"|", b".", b",", b"!", b"\n"]
_IS = np.zeros((len(_CLASSES), 256), np.int64)
for _i, _chars in enumerate(_CLASSES):
    _IS[_i, list(_chars)] = 1


@dataclass
class Features:
    """Sparse word weights of some rows (row bounds, bucket, value) and their dense statistics."""

    bounds: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    dense: np.ndarray


def features(w: Words, n_chars: np.ndarray) -> Features:
    """Words weigh their count in the document, scaled to length one; an empty text has zeros everywhere."""
    docs = len(w.rows)
    n = np.diff(w.bounds)
    key = w.doc_of_word().astype(np.int64) * BUCKETS + (w.hashes >> np.uint64(40)).astype(np.int64) % BUCKETS
    unique, count = np.unique(key, return_counts=True)
    row, bucket = unique // BUCKETS, unique % BUCKETS
    square = np.bincount(row, count.astype(float) ** 2, docs)
    value = count / np.sqrt(square[row]) if len(row) else np.zeros(0)
    bytes_ = np.diff(w.byte_bounds)
    at_most = lambda a: a / np.maximum(n, 1)
    dense = np.zeros((docs, len(STATISTICS)))
    dense[:, 0] = np.log1p(n)
    dense[:, 1] = at_most(np.bincount(w.doc_of_word(), w.ends - w.starts, docs))
    for i, flags in enumerate(_IS):
        total = np.concatenate([[0], np.cumsum(flags[w.data])])
        dense[:, 2 + i] = at_most(total[w.byte_bounds[1:]] - total[w.byte_bounds[:-1]])
    dense[:, 10] = at_most(np.bincount(row, minlength=docs))
    same = np.zeros(len(w.hashes))
    if len(same) > 1:
        same[1:] = w.hashes[1:] == w.hashes[:-1]
    dense[:, 11] = at_most(np.bincount(w.doc_of_word(), same, docs))
    high = np.concatenate([[0], np.cumsum(w.data >= 128)])
    dense[:, 12] = (high[w.byte_bounds[1:]] - high[w.byte_bounds[:-1]]) / np.maximum(bytes_, 1)
    dense[:, 13] = np.log1p(np.maximum(n_chars, 0))
    dense[n == 0, :13] = 0
    return Features(np.searchsorted(row, np.arange(docs + 1)), bucket, value, dense)


@dataclass
class Machine:
    """A factorisation machine; ``centre`` and ``scale`` standardise the statistics. ``constant`` stands in where there was nothing to learn from."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def dense(self, f: Features) -> np.ndarray:
        return np.clip((f.dense - self.centre) / self.scale, -4, 4) / np.sqrt(len(STATISTICS))

    def logits(self, f: Features) -> np.ndarray:
        """Linear time: one pass over the non-zero values for the sums and the sums of squares."""
        docs = len(f.bounds) - 1
        dense = self.dense(f)
        row = np.repeat(np.arange(docs), np.diff(f.bounds))
        w, v = self.linear, self.factors
        out = self.bias + dense @ w[BUCKETS:] + np.bincount(row, f.value * w[f.bucket], docs)
        pair = np.zeros(docs)
        for k in range(v.shape[1]):
            own = f.value * v[f.bucket, k]
            total = np.bincount(row, own, docs) + dense @ v[BUCKETS:, k]
            pair += total**2 - np.bincount(row, own**2, docs) - dense**2 @ v[BUCKETS:, k] ** 2
        return out + pair / 2

    def scores(self, f: Features) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(f.bounds) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(f), -30, 30)))


def fit(rows: list[Features], labels: np.ndarray) -> Machine:
    """Adam over mini-batches in a fixed order of chance; classes weigh alike. One class or none gives a constant score."""
    size = BUCKETS + len(STATISTICS)
    zero = Machine(0.0, np.zeros(size), np.zeros((size, RANK)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    if len(labels) == 0 or labels.min() == labels.max():
        zero.constant = float(labels[0]) if len(labels) else 0.5
        return zero
    dense = np.vstack([f.dense for f in rows])
    counts = np.concatenate([np.diff(f.bounds) for f in rows])
    bucket, value = np.concatenate([f.bucket for f in rows]), np.concatenate([f.value for f in rows])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    model = zero
    model.centre, model.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    rng = np.random.default_rng(SEED)
    model.factors = rng.normal(0, 0.02, (size, RANK))
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = [np.zeros(1), model.linear, model.factors]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            index = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in pick])
            n = counts[pick]
            part = Features(np.concatenate([[0], np.cumsum(n)]), bucket[index], value[index], dense[pick])
            model.bias = float(params[0][0])
            x, row, standard = part.value, np.repeat(np.arange(len(pick)), n), model.dense(part)
            error = (1 / (1 + np.exp(-np.clip(model.logits(part), -30, 30))) - labels[pick]) * weight[pick] / len(pick)
            slope = [np.array([error.sum()]), DECAY * params[1], DECAY * params[2]]
            slope[1][:BUCKETS] += np.bincount(part.bucket, error[row] * x, BUCKETS)
            slope[1][BUCKETS:] += error @ standard
            for k in range(RANK):
                v = params[2][:, k]
                total = np.bincount(row, x * v[part.bucket], len(pick)) + standard @ v[BUCKETS:]
                slope[2][:BUCKETS, k] += np.bincount(part.bucket, error[row] * x * (total[row] - x * v[part.bucket]), BUCKETS)
                slope[2][BUCKETS:, k] += (error * total) @ standard - (error @ standard**2) * v[BUCKETS:]
            step += 1
            for p, g, (m, s) in zip(params, slope, moment, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    model.bias = float(params[0][0])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no training sees: CRC-32 of the doc_id as text leaves 1 modulo 3. A null doc_id is held out of neither part."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents outside the held-out part.

    Labels other than 0 and 1 and rows with a null doc_id are left out; a doc_id with contradicting labels as well. The
    sample goes to the driver, which its bound allows; only its texts' features are made.
    """
    known = labels.select(F.col("doc_id").cast("long"), "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    once = known.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    # Twice the bound: labels may name documents that are not there.
    chosen = F.broadcast(once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).select("doc_id", F.col("low").alias("label")))
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.char_length("text")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(n_chars.cast("long"), F.lit(0)).alias("n_chars")).join(chosen, "doc_id")

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = batch.column(2).to_numpy()
            out: list[list] = [[], [], []]
            for w in chunks(batch.column(1)):
                f = features(w, chars[w.rows.start : w.rows.stop])
                for i in range(len(w.rows)):
                    part = slice(f.bounds[i], f.bounds[i + 1])
                    for column, value in zip(out, (f.bucket[part].astype(np.int32), f.value[part].astype(np.float32), f.dense[i]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3).cast(pa.int32()), pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.float32())), pa.array(out[2], pa.list_(pa.float64()))],
                                             names=["doc_id", "label", "bucket", "value", "dense"])

    found = rows.mapInArrow(collected, "doc_id long, label int, bucket array<int>, value array<float>, dense array<double>")
    taken = found.orderBy(F.xxhash64("doc_id"), "doc_id", "bucket", "value").limit(sample).toArrow().combine_chunks()
    labels_ = taken.column("label").to_numpy().astype(float)
    parts = [Features(np.array([0, len(b)]), np.array(b, np.int64), np.array(v, float), np.array([d]))
             for b, v, d in zip(*(taken.column(c).to_pylist() for c in ("bucket", "value", "dense")), strict=True)]
    return fit(parts, labels_)


def score(docs: DataFrame, model: Machine, out: str = "score") -> DataFrame:
    """``docs`` with the model's probability of quality 1 from whole texts; null texts count as empty. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts, chars):
        import pandas as pd

        n, values = chars.to_numpy(), np.zeros(len(texts))
        for w in chunks(pa.array(texts, pa.large_string(), from_pandas=True)):
            values[w.rows.start : w.rows.stop] = shared.value.scores(features(w, n[w.rows.start : w.rows.stop]))
        return pd.Series(values)

    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.char_length("text")
    return docs.withColumn(out, probability(F.coalesce(F.col("text"), F.lit("")), F.coalesce(n_chars.cast("long"), F.lit(0).cast("long"))))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, n_chars if there).

    lang, source, doc_id and the labels are inputs of no score. Without usable labels every score is 0.5, with labels of one
    class that class. Rows may repeat; a null doc_id is not held out; an empty table gives no rows.
    """
    columns = ["doc_id", "text"] + ["n_chars"] * ("n_chars" in docs.columns)
    scored = score(docs.select(columns), train(docs, labels, sample))
    return scored.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows scored below ``least``; columns stay."""
    return score(docs, train(docs, labels, sample), "__score").where(F.col("__score") >= least).select(docs.columns)
