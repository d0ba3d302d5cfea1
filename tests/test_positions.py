"""Places in a global order and geometry at a point, against plain versions."""

import random

from draftlake.operators import coverage, scan, texts


def _boxes(spark, rows):
    return spark.createDataFrame(rows, "sheet_id string, x0 double, y0 double, x1 double, y1 double, source_kind string, candidate_id string")


def test_reading_order_equals_sorting(spark):
    rng = random.Random(3)
    # One sheet holds most rows; many rows share y0, and some are equal in all columns.
    rows = [(rng.choice("aaaab"), rng.randrange(4) / 4, rng.randrange(3) / 4, 1.0, rng.randrange(2) + 1.0, rng.choice(["o", "v"]), str(rng.randrange(3))) for _ in range(600)]
    got = texts.canonical_order(_boxes(spark, rows)).collect()
    key = lambda r: (r[0], r[2], r[1], r[4], r[3], r[5], r[6])
    assert [tuple(r)[:7] for r in sorted(got, key=lambda r: r["position"])] == sorted(rows, key=key)
    assert sorted(r["position"] for r in got) == list(range(600))
    for sheet in "ab":
        assert sorted(r["place"] for r in got if r["sheet_id"] == sheet) == list(range(sum(r[0] == sheet for r in rows)))


def test_reading_order_of_nothing_and_of_nulls(spark):
    assert texts.canonical_order(_boxes(spark, [])).collect() == []
    got = texts.canonical_order(_boxes(spark, [("a", 0.5, 0.0, 1.0, 1.0, "v", "1"), ("a", None, None, 1.0, 1.0, "v", "2"), (None, 0.0, 0.0, 1.0, 1.0, "v", "3")])).collect()
    assert {r["candidate_id"]: (r["position"], r["place"]) for r in got} == {"3": (0, 0), "2": (1, 0), "1": (2, 1)}


def test_positions_keep_clashing_names(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(50)], "position long, v int")
    assert sorted(r["n"] for r in scan.positions(d, [d["v"]], "n").collect()) == list(range(50))


def test_geometry_at_a_point_equals_brute_force(spark):
    rng = random.Random(7)
    at = lambda: rng.randrange(-60, 60) / 2  # noqa: E731  halves, so many pairs stand at exactly the tolerance
    circles = [(rng.choice("st"), f"c{i}", at(), at()) for i in range(80)]
    edges = [(rng.choice("st"), f"e{i}", at(), at(), at(), at()) for i in range(80)]
    points = [(rng.choice("st"), at(), at(), float(rng.randrange(9))) for _ in range(150)]
    d = spark.createDataFrame(points + points[:20], "sheet_id string, x double, y double, value double")
    c = spark.createDataFrame(circles, "sheet_id string, id string, cx double, cy double")
    e = spark.createDataFrame(edges, "sheet_id string, id string, x0 double, y0 double, x1 double, y1 double")
    near = lambda a, b, x, y: abs(a - x) <= 2 and abs(b - y) <= 2
    want = {(s, x, y, i) for s, x, y, _ in points for k, i, a, b in circles if k == s and near(a, b, x, y)}
    want |= {(s, x, y, i) for s, x, y, _ in points for k, i, a, b, g, h in edges if k == s and (near(a, b, x, y) or near(g, h, x, y))}
    got = [tuple(r) for r in coverage.geometry_at(d, c, e).collect()]
    assert len(got) == len(want) and set(got) == want


def test_evidence_at_a_point(spark):
    d = spark.createDataFrame([("s", 1.0, 1.0, 5.0), ("s", 1.0, 1.0, 6.0), ("s", 50.0, 1.0, 5.0), ("s", None, 1.0, 6.0), ("s", 1.0, 1.0, None), ("s", 1.0, 1.0, 5.0)],
                              "sheet_id string, x double, y double, value double")
    c = spark.createDataFrame([("s", "c", 0.0, 3.0), ("t", "x", 1.0, 1.0)], "sheet_id string, id string, cx double, cy double")
    e = spark.createDataFrame([("s", "e", 9.0, 9.0, 3.0, 1.0)], "sheet_id string, id string, x0 double, y0 double, x1 double, y1 double")
    claims = spark.createDataFrame([("s", "e", 5.01)], "sheet_id string, geometry_id string, printed_mm double")
    printed = spark.createDataFrame([("s", 6.0)], "sheet_id string, printed double")
    got = sorted(((r["x"], r["value"], r["n_geometry"], r["level"]) for r in coverage.point_evidence(d, c, e, claims, printed).collect()), key=str)
    assert got == sorted([(1.0, 5.0, 2, "bound"), (1.0, 5.0, 2, "bound"), (1.0, 6.0, 2, "present"), (50.0, 5.0, 0, "absent"), (None, 6.0, 0, "present"), (1.0, None, 2, "absent")], key=str)
