"""Periodic runs against every start, end and period tried, on small alphabets and awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np

from draftlake.llm import runs

SCHEMA = "doc_id long, text string, start long, length string, n_runs string"


def _all_runs(t, power=4, least=6):
    """(start, end, period) by trying every period at every place."""
    found = {}
    for q in range(1, len(t) // power + 1):
        at = 0
        while at < len(t) - q:
            end = at
            while end < len(t) - q and t[end] == t[end + q]:
                end += 1
            if end > at and end + q - at >= max(least, power * q):
                found.setdefault((at, end + q), q)     # the smallest period comes first
            at = end + 1
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def _plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = _all_runs(words)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    best = (None,) * 4
    if found:
        top = max((b - a) * 10**6 // q for a, b, q in found)
        a, b, q = min((a, b, q) for a, b, q in found if (b - a) * 10**6 // q == top)
        best = (a, b - a, q, 1000 * (b - a) // q)
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(found), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for trial in range(400):
        letters = rng.choice([1, 2, 2, 3, 4])
        t = []
        while len(t) < rng.randrange(1, 90):
            block = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
            t += block * rng.choice([1, 1, 2, 4, 5, 7])
        got = list(zip(*(x.tolist() for x in runs.runs(np.array(t))), strict=True))
        assert got == _all_runs(t), t
    for t in ([], [3], [1] * 5, [1] * 6, [1] * 5000, list(range(3000)), [1, 2, 3] * 700 + [1, 2]):
        got = list(zip(*(x.tolist() for x in runs.runs(np.array(t, np.int64))), strict=True))
        assert got == (_all_runs(t) if len(t) < 1000 else [(0, len(t), len(set(t)))] if len(set(t)) < 9 else [])


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(6)
    t = rng.integers(0, 3, 300)
    sa = runs.suffix_array(t)
    suffixes = [t[i:].tolist() for i in sa.order]
    assert suffixes == sorted(suffixes) and sa.inverse[sa.order].tolist() == list(range(300))
    for p in range(1, 300):
        a, b = suffixes[p - 1], suffixes[p]
        same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert sa.lcp[p] == same


def test_documents_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(None, "x " * 9), (1, None), (2, ""), (3, " \n\t "), (4, "spam " * 60), (4, "spam " * 60), (5, "spam " * 60), (6, "a\tb\x0bc  a b c a b\nc a b c é é é é é é é")]
    rows += [(7, " ".join(rng.choice("ab") for _ in range(300)) + "\u0085" + " z" * 30)]
    rows += [(i, " ".join(rng.choice(["w", "ü", "one two", "漢 字", "word"]) for _ in range(rng.randrange(1, 120)))) for i in range(10, 210)]
    docs = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], SCHEMA)
    got = runs.detect(docs).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(_plain(i, t) for i, t in rows)
    assert sum(r["n_runs"] for r in got) > 50 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert runs.detect(docs.limit(0)).collect() == []


def test_long_text_and_collapse(spark):
    long = " ".join(f"w{i}" for i in range(200_000)) + " go" * 100_000
    docs = spark.createDataFrame([(1, long, 1, "x", None), (2, "keep  this\ntext", 1, "x", None), (3, None, 1, "x", None), (4, "a b " * 9 + "end", 1, "x", None)], SCHEMA)
    got = {r["doc_id"]: r for r in runs.detect(docs, runs.plain_order).collect()}
    assert (got[1]["start"], got[1]["length"], got[1]["period"]) == (200_000, 100_000, 1) and got[2]["n_runs"] == 0
    short = {r["doc_id"]: r["text"] for r in runs.collapse(docs).collect()}
    assert short == {1: " ".join(f"w{i}" for i in range(200_000)) + " go", 2: "keep  this\ntext", 3: None, 4: "a b end"}
