"""Scoring of texts by a causal self-attention model over subword ids, beside a counted word model.

One pass counts the words of the training texts. A second writes every text's ids to the shared folder, with what frequent
words add to its base score; rare words follow by a join. From the written ids all training texts are counted (pairs of
ids), the network learns in rounds, and every text is scored. A hash deals the training texts over the rounds; in its round a
text gives all its windows, so the network sees each training window once. Tasks train apart and their weights are averaged by windows.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm import attention
from draftlake.llm.bpe import Codec
from draftlake.llm.words import Words, chunks, mix
from draftlake.session import ensure_checkpoint_dir

FREQUENT = 1 << 22     # words with at least one in so many of all tokens are frequent: no more than that can be
LONGEST = 64           # bytes of a frequent word
KNOWN = 1 << 20        # words whose ids a task keeps at hand
CHUNK = 1 << 22        # bytes of text whose words are told apart together
ROUNDS = 4
LINE = 1 << 14         # weights in a row on their way to the average
MANY = 1 << 20         # ids that are scored together
END = ""               # the end token among words


def held_out(doc_id: Column) -> Column:
    """Texts that no training sees: CRC-32 of the doc_id as text leaves 2 modulo 7. A null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct value, in order of values; which of them stands at each place)."""
    by = np.argsort(values)
    ordered = values[by]
    new = np.ones(len(by), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(by), np.int64)
    which[by] = np.cumsum(new) - 1
    return by[new], which


def _strings(w: Words, first: np.ndarray) -> pa.Array:
    """The words at some places, as strings."""
    size = w.ends[first] - w.starts[first]
    after = np.cumsum(size)
    at = np.arange(int(after[-1]) if len(after) else 0) + np.repeat(w.starts[first] - after + size, size)
    offsets = np.concatenate([[0], after]).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(w.data[at].tobytes()))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c): tokens of the column ``text``, A-Z lower-cased, words and one end for every row. Tasks count chunks before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([batch.num_rows])], names=["word", "c"])
            for w in chunks(batch.column(0), True, CHUNK):
                first, which = _distinct(w.hashes)
                yield pa.RecordBatch.from_arrays([_strings(w, first), pa.array(np.bincount(which, minlength=len(first)))], names=["word", "c"])

    return texts.select("text").mapInArrow(counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def _hash(words: pa.Array) -> np.ndarray:
    """The hash that ``Words`` has for each of some words."""
    return np.concatenate([w.hashes for w in chunks(words)]) if len(words) else np.zeros(0, np.uint64)


class Encoder:
    """Ids of words, each with one space before it, by tiktoken; its expressions refuse very long white space, which goes through this library's own encoder."""

    def __init__(self, ranks: dict[bytes, int]):
        pattern = public_tokenizers.PATTERN
        self.size = len(ranks)
        self.quick = tiktoken.Encoding("scoring", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.own = Codec(sorted(ranks, key=ranks.get), pattern, pattern)
        self.bytes = np.zeros(self.size, np.int64)
        for token, i in ranks.items():
            self.bytes[i] = len(token)

    def _one(self, text: str) -> np.ndarray:
        try:
            return self.quick.encode_to_numpy(text)
        except ValueError:
            return np.array(self.own.encode(text), np.uint32)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the words, one after the other."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        size = np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1])
        listed = words.to_pylist()
        ids = self._one(" " + " ".join(listed))
        ends = np.cumsum(size + 1)
        after = np.cumsum(self.bytes[ids])
        place = np.minimum(np.searchsorted(after, ends), len(after) - 1)
        if (after[place] == ends).all():
            return ids, np.concatenate([[0], place + 1])
        # Some white space other than ASCII drew two words together: one by one, then.
        each = [self._one(" " + word) for word in listed]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


class Known:
    """Ids of the words a task has met, found by hash; it starts anew beyond ``KNOWN`` words."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.bounds = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def places(self, hashes: np.ndarray, words: pa.Array) -> np.ndarray:
        """Where ``flat`` and ``bounds`` hold each of some distinct words, given with their hashes in order."""
        if len(self.hashes) > KNOWN:
            self._clear()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        flat, bounds = self.encoder.encode(words.filter(pa.array(new)))
        out = np.empty(len(hashes), np.int64)
        out[new] = len(self.bounds) - 1 + np.arange(len(bounds) - 1)
        if len(self.hashes):
            out[~new] = self.place[at[~new]]
        self.flat = np.concatenate([self.flat, flat.astype(np.uint16)])
        self.bounds = np.concatenate([self.bounds, bounds[1:] + self.bounds[-1]])
        every, place = np.concatenate([self.hashes, hashes[new]]), np.concatenate([self.place, out[new]])
        by = np.argsort(every)
        self.hashes, self.place = every[by], place[by]
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    ranks, key = shared.value
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids from a file of lines of a base64 token and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _spread(flat: np.ndarray, bounds: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """flat[bounds[i]:bounds[i + 1]] for every i of ``pick``, one after the other."""
    size = np.diff(bounds)[pick]
    after = np.cumsum(size)
    return flat[np.arange(int(after[-1]) if len(after) else 0) + np.repeat(bounds[pick] - after + size, size)]


#: ids: two bytes each, an end id, those of the text, an end id.
ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, ids binary, rare array<struct<word: string, n: long>>"


def encoded(texts: DataFrame, ranks: dict[bytes, int], frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Every row of ``texts`` (doc_id, held_out, text) with its ids, what its frequent words and its end add to the base score, and its other words.

    The text is taken as its words, A-Z lower-cased, each with one space before it. ``frequent``: hashes, in order, and
    counts; the count of the end comes first.
    """
    if len(ranks) > 0xFFFF:
        raise ValueError("ids are written in two bytes each")
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((ranks, hashlib.sha256(repr(sorted(ranks.items(), key=lambda t: t[1])[::97]).encode()).hexdigest()))
    known = context.broadcast(frequent)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = known.value
        encoder, end = _encoder(shared), int(counts[0])
        met = Known(encoder)
        logs = np.log10(counts[1:] + 1.0)
        for batch in batches:
            for w in chunks(batch.column(3), True, CHUNK):
                docs = len(w.rows)
                first, inverse = _distinct(w.hashes)
                unique = w.hashes[first]
                words = _strings(w, first)
                own = met.places(unique, words)[inverse]
                place = np.minimum(np.searchsorted(hashes, unique), max(len(hashes) - 1, 0))
                hit = hashes[place] == unique if len(hashes) else np.zeros(len(unique), bool)
                doc = w.doc_of_word()
                value = np.zeros(len(unique))
                value[hit] = logs[place[hit]]
                base = np.bincount(doc, value[inverse], docs) + math.log10(end + 1)
                seen = np.bincount(doc, hit[inverse], docs).astype(np.int64) + (end > 0)
                other = ~hit[inverse]
                pair, times = np.unique(doc[other].astype(np.int64) * max(len(unique), 1) + inverse[other], return_counts=True)
                of = pair // max(len(unique), 1)
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(docs + 1)), pa.int32()), pa.StructArray.from_arrays(
                    [words.take(pa.array(pair % max(len(unique), 1))), pa.array(times)], ["word", "n"]))
                size = np.concatenate([[0], np.cumsum(np.diff(met.bounds)[own])])[w.bounds]
                # An end id stands before and after every text.
                ids = np.full(size[-1] + 2 * docs, len(encoder.bytes), "<u2")
                inside = np.ones(len(ids), bool)
                size += 2 * np.arange(docs + 1)
                inside[size[:-1]] = inside[size[1:] - 1] = False
                ids[inside] = _spread(met.flat, met.bounds, own)
                part = batch.slice(w.rows.start, docs)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array(np.diff(w.bounds) + 1), pa.array(seen), pa.array(base),
                    pa.array([ids[a:b].tobytes() for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)], pa.binary()), rare],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "ids", "rare"])

    return texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(written, ENCODED)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, bounds) of whole texts, about ``MANY`` ids at once, as they are written. Columns: ids, row, ..."""
    for batch in batches:
        column = batch.column(0)
        if not len(column):
            continue
        size = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 2
        raw = np.frombuffer(column.buffers()[2], "<u2", int(size[-1]))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + MANY, "right")) - 1)
            yield batch.slice(at, to - at), raw[size[at] : size[to]], (size[at : to + 1] - size[at]).astype(np.int64)
            at = to


def pair_counts(rows: DataFrame, ids: int) -> DataFrame:
    """(place, n): how often an id follows another, place = id before * ``ids`` + id. Tasks count chunks before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text, bounds in _texts(batches):
            follows = np.ones(len(text), bool)
            follows[bounds[:-1]] = False
            at = np.flatnonzero(follows)
            place, n = np.unique(text[at - 1].astype(np.int64) * ids + text[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n)], names=["place", "n"])

    return rows.select("ids").mapInArrow(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def _regrouped(pairs: DataFrame, place) -> DataFrame:
    """Counts of pairs under other numbers: ``place`` of (id before, id)."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, which = np.unique(place(batch.column(0).to_numpy()), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.bincount(which, batch.column(1).to_numpy()).astype(np.int64))], names=["place", "n"])

    return pairs.mapInArrow(moved, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def _collected(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = sums.toArrow().combine_chunks()
    return found.column("place").to_numpy(), found.column("n").to_numpy()


def _dense(sums: DataFrame, size: int) -> np.ndarray:
    place, n = _collected(sums)
    out = np.zeros(size)
    out[place] = n
    return out


def count_vocabulary(pairs: DataFrame, ids: int) -> attention.Vocabulary:
    """From ``pair_counts`` of all training texts. The driver gets counts of ids, two tables of classes by the vocabulary, and ``attention.PAIRS`` pairs at most."""
    counts = _dense(_regrouped(pairs, lambda place: place % ids), ids)
    class_of, row_of = attention.classes(counts)
    rows, classes = attention.OWN_ROWS + attention.SHARED_ROWS, attention.CLASSES
    after = _dense(_regrouped(pairs, lambda place: row_of[place // ids].astype(np.int64) * classes + class_of[place % ids]), rows * classes)
    inside = _dense(_regrouped(pairs, lambda place: class_of[place // ids].astype(np.int64) * ids + place % ids), classes * ids)
    # Pairs of at least one in PAIRS: there cannot be more of them than that.
    place, seen = _collected(pairs.where(F.col("n") * attention.PAIRS >= int(counts.sum())))
    place = row_of[place // ids].astype(np.int64) * ids + place % ids
    return attention.vocabulary(counts, after.reshape(rows, classes), inside.reshape(classes, ids), place, seen)


def learn(train: DataFrame, voc: attention.Vocabulary, rounds: int = ROUNDS, share: int = 1) -> np.ndarray:
    """Weights after ``rounds`` rounds over ``train`` (ids, row); a ``share`` above 1 trains on one window in so many. Without training texts they stay as they start."""
    context = train.sparkSession.sparkContext
    shared = context.broadcast(voc)
    weights = attention.fresh()
    for number in range(rounds):
        now = context.broadcast(weights)
        rate = attention.RATE * (1 - number / rounds)

        def trained(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            def chosen() -> Iterator[tuple[np.ndarray, attention.Windows]]:
                for rows, ids, bounds in _texts(batches):
                    row = rows.column(1).to_numpy().astype(np.uint64)

                    def key(doc: np.ndarray, of: np.ndarray, row=row) -> np.ndarray:
                        return mix(mix(row[doc]) + of.astype(np.uint64))

                    w = attention.windows(bounds, lambda doc, of: key(doc, of) % np.uint64(share) == 0)
                    yield ids, w[np.random.default_rng(len(w.doc)).permutation(len(w.doc))]

            flat, seen = attention.train(now.value, shared.value, chosen(), rate)
            if seen:
                lines = [flat[at : at + LINE].astype(float) * seen for at in range(0, len(flat), LINE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int32()), pa.array([seen] * len(lines), pa.int64()), pa.array(lines, pa.list_(pa.float64()))],
                                                 names=["line", "seen", "total"])

        def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for line, seen, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    own = total.setdefault(line, [0, 0.0])
                    own[0] += seen
                    own[1] = own[1] + value.values.to_numpy()
            for line, (seen, value) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([line], pa.int32()), pa.array([value / seen], pa.list_(pa.float64()))], names=["line", "mean"])

        # Tasks hold texts, so they are as many as the input is large; every line of weights is added up in one task as it streams in.
        own = train.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == number)
        sent = own.select("ids", "row").mapInArrow(trained, "line int, seen long, total array<double>")
        means = sent.repartition("line").mapInArrow(averaged, "line int, mean array<double>").toArrow().sort_by("line").column("mean").combine_chunks()
        if not len(means):
            continue
        weights = means.flatten().to_numpy().astype(np.float32)
    return weights


def score(rows: DataFrame, voc: attention.Vocabulary, weights: np.ndarray, columns: list[str], out: str = "score") -> DataFrame:
    """``columns`` of encoded ``rows`` with the model's log10 probability of each text, its end included."""
    shared = rows.sparkSession.sparkContext.broadcast((voc, weights))
    end = len(voc.class_of) - 1
    schema = rows.select(*columns, F.lit(0.0).cast("double").alias(out)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = shared.value
        for part, ids, bounds in _texts(batches):
            value = attention.log_probabilities(flat, vocabulary, ids, bounds) / math.log(10)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(value)], names=[*columns, out])

    return rows.select("ids", *columns).mapInArrow(scored, schema)


def score_documents(docs: DataFrame, path: str, rounds: int = ROUNDS, share: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Null and empty texts are one end token. Rows may repeat, and each gives one and trains as one; a null doc_id is not held
    out; other columns are not read; an empty table gives no rows, and one without training texts a base score of 0 and a
    model as it starts. A very long text is encoded and scored in pieces of work of its own; no part of it is left out.
    score is for the words with one space between, A-Z lower-cased, in ids of the file at ``path`` and an end id, so it
    stands for the same tokens as base_score.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/scoring-{uuid.uuid4().hex}"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    word_counts(texts.where("not held_out")).write.parquet(f"{folder}/counts")
    counts = spark.read.schema("word string, c long").parquet(f"{folder}/counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()

    # Words of at least one in FREQUENT tokens: there cannot be more of them than that, so they may go to every task.
    common = (F.col("c") * FREQUENT >= total) & (F.octet_length("word") <= LONGEST)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hash(batch.column(0)).view(np.int64)), batch.column(1)], names=["hash", "c"])

    found = counts.where(common & (F.col("word") != END)).mapInArrow(hashed, "hash long, c long").toArrow()
    hashes, of = found.column("hash").to_numpy().view(np.uint64), found.column("c").to_numpy()
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    by = np.argsort(hashes)
    ranks = read_ranks(path)
    encoded(texts, ranks, (hashes[by], np.concatenate([[ends], of[by]]))).write.option("compression", "zstd").parquet(f"{folder}/ids")
    rows = spark.read.schema(ENCODED).parquet(f"{folder}/ids")

    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts.where(~common), "word")
    more = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"), F.sum("n").alias("more_known"))

    train = rows.where("not held_out")
    pair_counts(train, len(ranks) + 1).write.parquet(f"{folder}/pairs")
    voc = count_vocabulary(spark.read.schema("place long, n long").parquet(f"{folder}/pairs"), len(ranks) + 1)
    weights = learn(train, voc, rounds, share)
    scored = score(rows, voc, weights, ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs"])
    each = math.log10(total + distinct + 1)
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score")
