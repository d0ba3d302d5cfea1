"""One very long text full of matches: results equal a plain walk, and the work does not grow with the square."""

import hashlib
import random
import re
import time

from draftlake.llm import credentials, supervision


def _listed(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(credentials.ASSIGN.replace("(?i:", "(?:"), text, re.I) if len(m[2]) >= 6]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(credentials.HEX, text)]
    return sorted(spans)


def test_many_assignments_in_one_text(spark):
    rng = random.Random(5)
    text = " ".join(f"é{i} token={'x' * rng.randrange(4, 9)}\n{'0f' * 12 if i % 3 == 0 else '-'}" for i in range(60000))
    docs = spark.createDataFrame([(1, text), (2, "token=abcdef"), (3, None), (4, "")], "doc_id long, text string")
    begin = time.time()
    got = {r["doc_id"]: r for r in credentials.scan_documents(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in credentials.redact(docs).collect()}
    assert time.time() - begin < 120
    spans = _listed(text)
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    assert clean[1] == "".join(out) + text[at:] and clean[2] == "[SECRET]" and clean[3] is None and clean[4] == ""


def test_overlapping_spans_over_block_borders(spark):
    """Spans that reach over the next ones, in blocks of a few."""
    rng = random.Random(9)
    rows = []
    for k in range(30):
        text = "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 60)))
        spans = sorted((a, 0, min(len(text), a + rng.choice([1, 2, 15]))) for a in (rng.randrange(len(text)) for _ in range(rng.randrange(0, 14) if text else 0)))
        rows.append((k, text, [{"start": a, "kind": c, "end": b} for a, c, b in spans]))
    d = spark.createDataFrame(rows, f"id int, text string, spans {credentials.SPANS}")
    got = {r["id"]: r["clean"] for r in d.where("size(spans) > 0").select("id", credentials._marked(d["text"], d["spans"], "#").alias("clean")).collect()}
    for k, text, spans in rows:
        if spans:
            hidden = [any(s["start"] <= i < s["end"] for s in spans) for i in range(len(text))]
            out, at = "", 0
            for s in spans:
                if s["start"] >= at:
                    out += text[at : s["start"]] + "#"
                at = max(at, s["end"])
            assert got[k] == out + text[at:] and len(got[k].replace("#", "")) == hidden.count(False)


def test_many_linked_parts_in_one_text(spark):
    scopes = [f"login: user{i}\n" + ("password=hunter22" if i % 2 else "nothing") for i in range(20000)]
    docs = spark.createDataFrame([(1, "\n\n".join(scopes))], "doc_id long, text string")
    begin = time.time()
    got = credentials.scan_documents(docs).first()
    assert time.time() - begin < 60
    assert got["n_assign"] == 10000 and got["spans"].count("login") == 10000


def test_repeated_words_in_one_text(spark):
    rng = random.Random(1)
    words = [rng.choice("ab") + "c" * rng.randrange(2) for _ in range(5000)] * 40 + [f"w{i}" for i in range(1000)]
    seen, where = {}, []
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])] = seen.get(tuple(words[i : i + 8]), 0) + 1
    last = -8
    n = 0
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            n += min(8, i - last)
            last = i
    docs = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "doc_id long, text string")
    begin = time.time()
    got = {r["doc_id"]: r["n_repeat_words"] for r in supervision.measures(docs).collect()}
    assert time.time() - begin < 60
    assert got == {1: n, 2: 0, 3: 0}
