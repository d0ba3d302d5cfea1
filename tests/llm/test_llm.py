"""The ten operators on small tables with awkward rows, held against plain versions."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from draftlake.llm import bpe, chains, credentials, factorisation, licences, neardup, packing, permutation, shards, supervision

MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, ids string, score double, shard int"
WORD = r"[^\x20\x09-\x0D]+"


def _prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n)) + "."


TEXTS = {
    1: _prose(1, 120), 2: _prose(1, 120), 3: _prose(1, 118) + " changed.", 4: "", 5: None, 6: "one", 7: " \t\n ", 8: "One", 9: _prose(9, 30000),
    10: 'user = alice\npassword: "hunter22" token=abc secret=AAAAAA', 11: "AKIA" + "A1" * 10 + " " + "0f" * 15, 12: "é漢😀 \u0085\x1c x", 13: "a b c d\na b c d\n\na b c d",
    14: ("spam " * 60).strip(), 15: _prose(15, 60) + " " + _prose(99, 70) + " " + _prose(16, 60), 16: _prose(17, 80) + " " + _prose(99, 70) + " " + _prose(18, 20),
    17: "Fine.\nReleased under the MIT License.", 18: "host = db.example.com\nlogin: root\nkey9Xq2LmZ8TtR4vBn6Wc1Yd",
    19: " ".join(_prose(100 + i, 12) for i in range(40))}


def _docs(spark, rows=None):
    rows = [(i, t, None, "s", len(t) if t else None, "b", None, 1.0, 3) for i, t in TEXTS.items()] + [(None, _prose(1, 120), "en", None, 5, None, "x", None, None), (1, TEXTS[1], "en", "s", 3, "b", None, 1.0, 3)] if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark).cache()


def test_bpe_equals_tiktoken(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collections.Counter(map(tuple, bpe.round_trip(docs, MULTI).collect()))
    want = collections.Counter()
    for r in docs.collect():
        ids = plain.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert got == want
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), MULTI), MULTI).collect()
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in back)


def test_bpe_random_strings():
    tokens = bpe.read_ranks(MULTI)
    codec = bpe.Codec(tokens, P.PATTERN, P.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice("ab'sStT \n\t\x0b\x1c\x85\xa0é²½ǅʰſ0123٣漢😀.,!?̀") for _ in range(rng.randrange(40)))
        assert codec.encode(s) == plain.encode_ordinary(s)
    assert codec.table.get(b"not a token at all") is None and all(codec.table.get(t) == i for i, t in enumerate(tokens))


def test_neighbours_recall_and_rules(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(900, 16)).astype("float32")
    rows = [(i, [float(x) for x in v[i]], "x") for i in range(900)] + [(900, None, "x"), (1000, [0.0] * 16, "x"), (1100, [float("nan")] * 16, "x"), (1200, [None] + [1.0] * 15, "x"), (1300, [1.0], "x"), (None, [1.0] * 16, "x")]
    rows += [(2000 + i, [float(x) for x in v[0]], "x") for i in range(30)] + [rows[5]]
    got = permutation.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")).toPandas()
    assert set(got["query_id"]) == {*range(0, 900, 100), 2000}
    first = got[got.query_id == 0].sort_values("rank")
    assert first["vec_id"].tolist() == list(range(2000, 2010)) and (first["score"] == 0).all()
    hits = 0
    ids, every = np.array([*range(900), *range(2000, 2030)]), np.vstack([v, np.repeat(v[:1], 30, axis=0)]).astype(float)
    for q in range(100, 900, 100):
        d = np.sqrt(((every - v[q].astype(float)) ** 2).sum(axis=1))
        d[q] = 99
        hits += len(set(ids[np.lexsort((ids, d))[:10]]) & set(got[got.query_id == q]["vec_id"]))
    assert hits >= 72
    assert permutation.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


ASSIGN = re.compile(credentials.ASSIGN, re.A)


def test_secrets(spark, docs):
    got = {r["doc_id"]: r for r in credentials.scan_documents(docs).collect()}
    for i, text in TEXTS.items():
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        listed = ",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), i
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == k for s in spans) for k in range(3)]
    assert "login:0:12" in got[10]["spans"] and got[10]["spans"].count("assign") == got[10]["n_assign"]
    assert {s.split(":")[0] for s in got[18]["spans"].split(",")} == {"endpoint", "login", "string"}
    clean = {r["doc_id"]: r for r in credentials.redact(docs).collect()}
    assert "hunter22" not in clean[10]["text"] and clean[6]["text"] == "one" and clean[5]["text"] is None and clean[10]["n_chars"] == len(clean[10]["text"])
    # Weak parts alone are not reported, nor over a blank line.
    lone = _docs(spark, [(1, "login: root", *[None] * 7), (2, "login: root\n\nkey9Xq2LmZ8TtR4vBn6Wc1Yd", *[None] * 7)])
    assert {r["spans"] for r in credentials.scan_documents(lone).collect()} == {""}


def test_repeated_passages(spark, docs):
    rows = chains.repeated_passages(docs).collect()
    pairs = {(r["doc_id"], r["partner_id"]) for r in rows}
    assert {(1, 2), (2, 1), (1, 3), (15, 16), (16, 15)} <= pairs
    assert {i for p in pairs for i in p} <= {1, 2, 3, 15, 16}
    r = next(r for r in rows if (r["doc_id"], r["partner_id"]) == (16, 15))
    assert (r["start_word"], r["end_word"], r["earlier"]) == (80, 150, False)
    cut = {r["doc_id"]: r for r in chains.drop_repeated_passages(docs.where("doc_id > 1")).collect()}
    assert len(re.findall(WORD, cut[16]["text"])) == 100 and cut[15]["text"] == TEXTS[15] and cut[5]["text"] is None


def test_chain_is_collinear():
    own, other = np.array([0, 10, 20, 30, 40]), np.array([100, 110, 5, 130, 140])
    assert chains.chain(own, other)[0] == [0, 1, 3, 4]


def test_weak_supervision(spark, docs):
    got = {r["doc_id"]: r for r in supervision.judge_documents(docs).collect()}
    for i, text in TEXTS.items():
        words = re.findall(WORD, text or "")
        lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        seen = collections.Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        covered = {j + d for j in range(len(words) - 7) if seen[tuple(words[j : j + 8])] > 1 for d in range(8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert got[19]["kept"] and not got[14]["kept"]


def test_shards(spark, docs):
    rows = shards.place_documents(docs, 16).collect()
    assert len(rows) == docs.count()
    for s in range(16):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 16)
        if r["doc_id"] in TEXTS:
            raw = (TEXTS[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert np.bincount(shards.jump(np.arange(16000, dtype=np.uint64), 16)).max() < 1150


def test_near_copies(spark, docs):
    got = {(r["doc_id"], r["n_shingles"]): r for r in neardup.link_documents(docs, 85).collect()}
    of = {i: c["component_id"] for (i, _), c in got.items()}
    assert of[1] == of[2] == of[3] == 1 and of[8] == of[6] == 6 and of[4] == 4 and of[5] == 5 and of[7] == 7 and of[16] == 16 and of[None] is None
    assert {i for (i, _), c in got.items() if c["kept"]} == {None, *TEXTS} - {2, 3, 8}
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted({0, *TEXTS} - {2, 3, 8})


def test_licences(spark):
    mit = "\n".join(licences.SENTENCES[s] for s in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability"))
    rows = {1: (mit, "MIT", "resolved"), 2: (licences.SENTENCES["mit-warranty"], "", "unresolved"), 3: ("x ***\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "resolved"),
            4: (None, "", "none"), 5: ("Released under the MIT License. Other. " + licences.SENTENCES["bsd-source"], "MIT", "partial"), 6: ("No licence here.", "", "none")}
    got = {r["doc_id"]: (r["licences"], r["state"]) for r in licences.scan_documents(_docs(spark, [(i, t, *[None] * 7) for i, (t, _, _) in rows.items()])).collect()}
    assert got == {i: x[1:] for i, x in rows.items()}


def test_packing(spark, docs):
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    rows = packing.pack(docs, JSON).collect()
    by_doc = collections.defaultdict(list)
    filled = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in TEXTS.items():
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for r in by_doc[i]:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
        assert sum(r["length"] for r in by_doc[i]) == len(ids) * (2 if i == 1 else 1)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    rng = random.Random(5)
    histogram = collections.Counter(rng.randrange(1, 2049) for _ in range(5000))
    packs = packing.plan_packs(histogram)
    used = collections.Counter()
    for count, lengths in packs:
        assert sum(lengths) <= 2048
        for n in lengths:
            used[n] += count
    assert used == histogram and sum(n * c for n, c in histogram.items()) >= 0.95 * 2048 * sum(c for c, _ in packs)
    long_blank = packing.token_ids((tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(packing.read_tokens(JSON))}, special_tokens={}), bpe.Codec(packing.read_tokens(JSON), P.PATTERN, P.PATTERN)), " " * 300000)
    assert len(long_blank) > 0


def test_classifier(spark):
    rows = [(i, _prose(i, 60) if i % 3 else "".join(w + "*** " for w in _prose(i, 60).split()), None, None, None, None, None, None, None) for i in range(400)]
    docs, labels = _docs(spark, rows + [(None, None, *[None] * 7)]), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 400)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in factorisation.score_documents(docs, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(400))
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.95
    assert 0 <= got[None]["score"] <= 1
    assert {r["score"] for r in factorisation.score_documents(docs, labels.where("false")).collect()} == {0.5}


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    size = factorisation.BUCKETS + len(factorisation.STATISTICS)
    m = factorisation.Machine(0.1, rng.normal(size=size), rng.normal(size=(size, 3)), np.zeros(len(factorisation.STATISTICS)), np.ones(len(factorisation.STATISTICS)))
    f = factorisation.Features(np.array([0, 3]), np.array([5, 9, 77]), np.array([0.5, 0.25, 1.0]), rng.normal(size=(1, len(factorisation.STATISTICS))))
    x = np.concatenate([f.value, m.dense(f)[0]])
    at = np.concatenate([f.bucket, np.arange(factorisation.BUCKETS, size)])
    want = 0.1 + x @ m.linear[at] + sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert math.isclose(float(m.logits(f)[0]), want, rel_tol=1e-9)


def test_empty_tables(spark):
    none = _docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (bpe.round_trip(none, MULTI), credentials.scan_documents(none), chains.repeated_passages(none), supervision.judge_documents(none), shards.place_documents(none),
               neardup.link_documents(none), licences.scan_documents(none), packing.pack(none, JSON), factorisation.score_documents(none, labels)):
        assert df.count() == 0
