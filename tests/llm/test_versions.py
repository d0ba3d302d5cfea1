"""Rows that share a doc_id, and other awkward rows, in the stages that drop near copies and cut repeated passages."""

import random

from draftlake.llm import chains, neardup


def _words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9))) for _ in range(n)]


def test_rows_that_share_a_doc_id_keep_their_own_text(spark):
    passage = _words("p", 80)
    a = _words("a", 60) + passage + _words("a2", 60)
    b = _words("b", 30) + passage + _words("b2", 90)
    c = _words("c", 200)
    rows = [(1, a, "x"), (2, b, "y"), (2, c, "z"), (None, a, "n"), (3, None, "e"), (4, [], "f"), (5, a, "g"), (5, a, "g")]
    docs = spark.createDataFrame([(i, None if t is None else " ".join(t), k) for i, t, k in rows], "doc_id long, text string, b string")
    got = {(r["doc_id"], r["b"]): r["text"] for r in chains.drop_repeated_passages(docs).collect()}
    assert got[1, "x"] == " ".join(a) and got[None, "n"] == " ".join(a) and got[2, "z"] == " ".join(c)
    assert got[2, "y"].split() == b[:30] + b[110:]
    assert got[3, "e"] is None and got[4, "f"] == "" and got[5, "g"].split() == []
    spans = chains.repeated_passages(docs).where("not earlier").select("doc_id", "partner_id", "start_word", "end_word", "n_equal").distinct().collect()
    assert sorted(map(tuple, spans)) == [(2, 1, 30, 110, 80), (5, 1, 0, 200, 200)]


def test_long_text_is_split_into_segments(spark):
    passage, long = _words("p", 60), _words("l", 90000)
    docs = spark.createDataFrame([(1, " ".join(long + passage)), (2, " ".join(passage + _words("r", 100))), (3, " ".join(_words("s", 50) + long[40000:40080]))], "doc_id long, text string")
    got = sorted(map(tuple, chains.repeated_passages(docs).where("not earlier").select("doc_id", "partner_id", "start_word", "end_word", "partner_start").collect()))
    assert got == [(2, 1, 0, 60, 90000), (3, 1, 50, 130, 40000)]


def test_stage_over_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long, seeds string")
    assert chains.drop_repeated_passages(docs).collect() == []
    assert neardup.drop_near_copies(docs).collect() == []


def test_near_copies_are_judged_by_their_own_text(spark):
    a, b, c = (" ".join(_words(x, 120)) for x in "abc")
    rows = [(1, a, "x", 7), (2, a + " end", "copy of 1", 7), (2, b, "own", 7), (2, c, "own too", 7), (3, b, "copy of 2", 7), (3, c + " z", "copy of 2", 7),
            (4, "", "empty", 7), (4, "", "empty", 7), (4, None, "null", 7), (None, a, "no id", 7), (5, c + " y x", "copy", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_key string, text_key int")
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["set_key"]) for r in kept.collect()) == [(0, "no id"), (1, "x"), (2, "own"), (2, "own too"), (4, "empty"), (4, "null")]
    got = neardup.link_documents(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == len(rows)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.where("doc_id is not null").collect()) == [(1, 1), (2, 1), (2, 2), (2, 2), (3, 2), (3, 2), (4, 4), (4, 4), (4, 4), (5, 2)]
