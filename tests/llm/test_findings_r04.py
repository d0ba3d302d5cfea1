"""F1, F16: near copies inside a crowd of texts whose similarities lie on both sides of the threshold."""

import random

import numpy as np
import pytest

from draftlake.llm import neardup


def _crowd(n, words, least, most):
    """``n`` variants of one template; of each between ``least`` and ``most`` words are replaced."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(words)]
    out = []
    for v in range(n):
        text = list(base)
        for j in rng.sample(range(words), rng.randint(least, most)):
            text[j] = f"x{v}-{j}"
        out.append(text)
    return out


def _expected(texts, percent):
    ids = {}
    sets = [{ids.setdefault(tuple(t[j : j + 5]), len(ids)) for j in range(len(t) - 4)} for t in texts]
    has = np.zeros((len(sets), len(ids)), np.float32)
    for row, own in zip(has, sets, strict=True):
        row[list(own)] = 1
    both = has @ has.T
    size = has.sum(axis=1)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    least = np.arange(len(sets))
    while True:
        low = np.where(linked, least[None, :], len(sets)).min(axis=1)
        if (low == least).all():
            return dict(enumerate(least.tolist()))
        least = low


@pytest.mark.parametrize("block, shingles", [(4096, 1 << 21), (32, 5000)])
def test_crowd_equals_all_pairs(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles, raising=False)
    texts = _crowd(600, 300, 3, 14)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.link_documents(docs, 80).collect()}
    want = _expected(texts, 80)
    assert 100 < len(set(want.values())) < 500
    assert got == want
