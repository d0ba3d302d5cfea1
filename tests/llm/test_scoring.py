"""The attention model against plain formulas, and the scored table against brute force on awkward rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from draftlake.llm import attention as A
from draftlake.llm import scoring

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, row long, word string, c long, score double"
IDS = 400


@pytest.fixture(scope="module")
def model():
    """A vocabulary counted from random ids and weights that are not at rest."""
    rng = np.random.default_rng(8)
    ids = np.minimum(rng.geometric(0.02, 6000), IDS - 1)
    bounds = np.array([0, 2, 40, 41 + 32, 3000, 6000])
    ids[bounds[:-1]] = ids[bounds[1:] - 1] = IDS - 1
    counts = np.bincount(ids, minlength=IDS).astype(float)
    c, r = A.classes(counts)
    a, b = ids[:-1], ids[1:]
    pairs, seen = np.unique(r[a].astype(np.int64) * IDS + b, return_counts=True)
    voc = A.vocabulary(counts, np.bincount(r[a].astype(np.int64) * A.CLASSES + c[b], minlength=(A.OWN_ROWS + A.SHARED_ROWS) * A.CLASSES).reshape(-1, A.CLASSES).astype(float),
                       np.bincount(c[a].astype(np.int64) * IDS + b, minlength=A.CLASSES * IDS).reshape(A.CLASSES, IDS).astype(float), pairs[seen > 1], seen[seen > 1])
    flat = A.fresh()
    flat += rng.normal(0, 0.2, len(flat)).astype(np.float32)
    return voc, flat, ids, bounds


def _one_by_one(voc, flat, ids, bounds):
    """Each text's log probability, id by id, with the attention written out for one query."""
    p = {k: v.astype(float) for k, v in A.views(flat).items()}
    out = []
    for first, end in zip(bounds[:-1], bounds[1:]):
        total = 0.0
        for t in range(first + 1, end):
            begin = first + (t - first - 1) // A.STRIDE * A.STRIDE       # the window's first query
            keys = range(max(first, begin - A.OVERLAP), t)
            e = [p["embed"][voc.row_of[ids[k]]] for k in keys]
            q = e[-1] @ p["query"]
            s = np.array([q @ (x @ p["key"]) / math.sqrt(A.SIZE) + p["behind"][t - 1 - k] for x, k in zip(e, keys)])
            s = np.exp(np.clip(s, -A.LIMIT, A.LIMIT))
            y = sum(w * (x @ p["value"]) for w, x in zip(s / s.sum(), e))
            h = np.maximum(np.concatenate([e[-1], y]) @ p["into"] + p["into_bias"], 0)
            w = np.exp(np.clip(h @ p["out"] + p["out_bias"], -A.LIMIT, A.LIMIT)) * voc.after_row[voc.row_of[ids[t - 1]]]
            total += math.log(w[voc.class_of[ids[t]]] / w.sum()) + float(voc.within(ids[t - 1 : t], ids[t : t + 1])[0])
        out.append(total)
    return np.array(out)


def test_windows_score_each_id_once(model):
    voc, flat, ids, bounds = model
    w = A.windows(bounds)
    assert sorted(w.targets[w.real].tolist()) == sorted(set(range(len(ids))) - set(bounds[:-1].tolist()))
    got = A.log_probabilities(flat, voc, ids, bounds)
    assert np.abs(got - _one_by_one(voc, flat, ids, bounds)).max() < 1e-3 * len(ids)
    alone = [A.log_probabilities(flat, voc, ids[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds[:-1], bounds[1:])]
    assert np.allclose(got, alone, rtol=1e-5)


def test_probabilities_add_up_to_one(model):
    voc, flat, ids, bounds = model
    w = A.windows(bounds)[slice(10, 12)]
    x = voc.row_of[ids[w.keys]]
    weight, sums = A._weigh(voc, x, A.Reader(flat).forward(x, w.opening))
    for i, j in ((0, 0), (0, 23), (1, 17)):
        before = np.full(IDS, ids[w.targets[i, j] - 1])
        every = np.arange(IDS)
        p = weight[i, j, voc.class_of[every]] / sums[i, j] * np.exp(voc.within(before, every))
        assert abs(p.sum() - 1) < 1e-4 and (p > 0).all()


def test_gradient(model):
    voc, flat, ids, bounds = model
    w = A.windows(bounds)[slice(0, 12)]

    def loss(weights):
        x = voc.row_of[ids[w.keys]]
        said, cache = A.forward(A.views(weights), x, w.opening)
        weight, sums = A._weigh(voc, x, said)
        target = voc.class_of[ids[w.targets]]
        own = np.take_along_axis(weight, target[:, :, None], 2)[:, :, 0] / sums
        share = weight / sums[:, :, None]
        np.put_along_axis(share, target[:, :, None], np.take_along_axis(share, target[:, :, None], 2) - 1, 2)
        share *= w.real[:, :, None]
        return -(np.log(own.astype(float)) * w.real).sum(), A.gradient(A.views(weights), x, cache, share.astype(np.float32))

    slope = loss(flat)[1].astype(float)
    for name, view in A.views(np.arange(A.LENGTH)).items():
        way = np.zeros(A.LENGTH)
        way[view.ravel()] = slope[view.ravel()]
        size = np.linalg.norm(way)
        step = (way / size * 2e-3).astype(np.float32)
        measured = (loss(flat + step)[0] - loss(flat - step)[0]) / 4e-3
        assert abs(measured - size) < 0.03 * size, name


def _prose(rng, n):
    follow = {"a": "b c", "b": "c d", "c": "a", "d": "e", "e": "a b"}
    out, at = [], "a"
    for _ in range(n):
        at = rng.choice(follow[at].split())
        out.append({"a": "lantern", "b": "Meadow", "c": "quiet", "d": "rivers", "e": "under"}[at])
    return " ".join(out)


def _plain(rows):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", fold(t)) + [""] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = collections.Counter(x for w, h in zip(words, held) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for (i, _), w, h in zip(rows, words, held)]


def _same(got, want):
    key = lambda r: tuple((x is None, x) for x in r[:4])
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a[5] - b[5]) < 1e-9 * max(1, abs(b[5])) for a, b in zip(got, want))


def test_documents(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(None, "Meadow quiet"), (1, None), (2, ""), (3, " \t\n"), (4, "É ÉCLAIR \u0085x   y \U0001f600"), (5, "w" * 300_000), (5, " " * 3000 + " z")]
    rows += [(7, _prose(rng, 30_000)), (7, _prose(rng, 20))] + [(i, _prose(rng, rng.randrange(5, 400)) + f" Only{i} {i}") for i in range(10, 260)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 0.5) for i, t in rows], SCHEMA).repartition(3)
    # Most words are rare under the second bound, so they take the way of the join.
    for bound in (scoring.FREQUENT, 4):
        monkeypatch.setattr(scoring, "FREQUENT", bound)
        got = scoring.score_documents(docs, RANKS, share=2).collect()
        _same(got, _plain(rows))
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 5]
    assert len(held) > 20 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    again = [r["score"] for r in got if r["n_tokens"] == 1]
    assert len(again) == 3 and max(again) - min(again) < 1e-6


def test_without_training_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert scoring.score_documents(none, RANKS).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = scoring.score_documents(spark.createDataFrame([(held, "one two", 1, "x", 2, 0.5)], SCHEMA), RANKS).collect()
    _same(got, _plain([(held, "one two")]))
