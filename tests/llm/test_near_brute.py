"""Near-duplicate components against all pairs of full shingle sets, for similarities on both sides of the threshold."""

import random
import re

import pytest

from draftlake.llm import neardup

WORD = r"[^\x20\x09-\x0D]+"


def _texts():
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    out = ["", None, " \n", "one", "One", "a b c", "A  b\tc", "é É"]
    for family in range(50):
        base = [word() for _ in range(rng.randrange(60, 300))]
        out.append(" ".join(base))
        for _ in range(family % 4):
            other = list(base)
            for j in rng.sample(range(len(base)), rng.randrange(0, 1 + len(base) // 25)):
                other[j] = word()
            out.append(" ".join(other).upper() if rng.random() < 0.3 else " ".join(other))
    rng.shuffle(out)
    return dict(enumerate(out, 10))


def _expected(texts, percent):
    sets = {}
    for i, text in texts.items():
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                changed = True
    return {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_all_pairs(spark, percent):
    texts = _texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.link_documents(docs, percent).collect()}
    assert got == _expected(texts, percent)
