"""Groups that compare with their first member, against plain sequential walks."""

import random

import pytest
from pyspark.sql import functions as F

from draftlake.operators import geometry_tables as gt
from draftlake.operators import graph, solids


def _walk(items, near):
    """{ord: leader}: in order, an item joins the first leader it is near."""
    leaders, out = [], {}
    for item in items:
        out[item[0]] = next((other[0] for other in leaders if near(other, item)), item[0])
        if out[item[0]] == item[0]:
            leaders.append(item)
    return out


def test_a_chain_of_spans_is_not_one_feature(spark):
    faces = [("p", 1, 5.0, "z", True, 0.0, 1.0), ("p", 2, 5.0, "z", True, 0.5, 2.0), ("p", 3, 5.0, "z", True, 1.5, 3.0), ("p", 4, 5.00004, "z", True, 0.5, 2.0), ("q", 1, 5.0, "z", False, 0.0, 9.0)]
    df = spark.createDataFrame(faces, "part_id string, face_id int, radius double, axis_key string, inner boolean, lo double, hi double")
    got = sorted((r["part_id"], r["radius"], r["group_lo"], r["faces"], r["hi"]) for r in solids.group_cylinders(df).collect())
    assert got == [("p", 5.0, 0.0, 2, 2.0), ("p", 5.0, 1.5, 1, 3.0), ("p", 5.00004, 0.5, 1, 2.0), ("q", 5.0, 0.0, 1, 9.0)]
    assert solids.group_cylinders(df.limit(0)).collect() == []


def _spans(seed):
    rng = random.Random(seed)
    return [(k, i, float(rng.randrange(900)) / 4, rng.choice([0.0, 0.25, 1.0, 3.5, 40.0])) for k in range(4) for i in range(rng.choice([1, 7, 150]))] + [(9, i, i / 2, 0.5) for i in range(300)]


@pytest.mark.parametrize("limit", [None, "3"])
def test_first_members_equal_a_walk(spark, limit):
    spans = _spans(4)
    want = {}
    for key in {s[0] for s in spans}:
        own = sorted((s for s in spans if s[0] == key), key=lambda s: (s[2], s[1]))
        reach, first = None, None
        for _, i, start, length in own:
            if reach is None or start > reach:
                reach, first = start + length, start
            want[key, i] = first
    df = spark.createDataFrame(spans, "k int, id int, start double, length double")
    if limit:
        spark.conf.set("draftlake.rowsPerTask", limit)
    got = graph.first_members(df, ["k"], "start", F.col("start") + F.col("length"), ["id"], "first")
    assert {(r["k"], r["id"]): r["first"] for r in got.collect()} == want
    spark.conf.unset("draftlake.rowsPerTask")


@pytest.mark.parametrize("order", ["mixed", "rising"])
def test_circle_groups_equal_a_walk(spark, order):
    rng = random.Random(11)
    circles = [(i, float(rng.randrange(40)), float(rng.randrange(30)), rng.choice([1.0, 20.0, 80.0, 100.0, 97.0, 102.0, 104.5])) for i in range(120)]
    circles += [(200 + i, 500.0, 500.0, 50.0 * 1.01**i) for i in range(60)]
    if order == "mixed":
        ids = [c[0] for c in circles]
        rng.shuffle(ids)
        circles = [(i, *c[1:]) for i, c in zip(ids, circles)]
    circles.sort()
    df = spark.createDataFrame([("s", str(i), *c) for i, c in enumerate(circles)], "sheet_id string, geometry_id string, ord long, cx double, cy double, r double")
    families = {r["ord"]: r["family"] for r in gt.circle_families(df).collect()}
    assert families == _walk(circles, lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= max(2.0, 0.03 * max(a[3], b[3])))
    sizes = {r["ord"]: r["size_group"] for r in gt.equal_diameters(df).collect()}
    assert sizes == _walk(circles, lambda a, b: abs(a[3] - b[3]) <= 0.03 * max(a[3], b[3]))


def test_word_lines_keep_to_their_first_word(spark):
    rng = random.Random(12)
    words = [(i, "w", float(rng.randrange(400)), float(rng.randrange(60)), 5.0, float(rng.choice([4, 6, 12])), 90.0) for i in range(150)]
    words += [(200 + i, "w", 10.0 * i, 500.0 + 3 * i, 5.0, 10.0, 90.0) for i in range(12)]      # a falling line: neighbours are near, all of them are not
    df = spark.createDataFrame([("s", *w) for w in words], "sheet_id string, ord long, text string, left double, top double, width double, height double, confidence double")
    got = {r["ord"]: r["line_mid"] for r in gt.word_lines(df).collect()}
    want, first = {}, None
    for w in sorted(words, key=lambda w: (w[3] + w[5] / 2, w[2], w[0])):
        mid = w[3] + w[5] / 2
        if first is None or mid > first[0] + 0.6 * first[1]:
            first = (mid, w[5])
        want[w[0]] = first[0]
    assert got == want and len({got[200 + i] for i in range(12)}) == 4
