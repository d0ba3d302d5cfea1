"""Edges of contracts: values that straddle a bucket, tolerances by size."""

from draftlake.operators import coverage


def test_labels_that_straddle_a_bucket(spark):
    labels = spark.createDataFrame([("s", "L", 1.0000004, "mm", None), ("t", "L", 1.0000004, "mm", None), ("u", "L", 5.0, None, "d")], "sheet_id string, id string, value double, unit string, kind string")
    readings = spark.createDataFrame([("s", "P", 1.0000006, "mm", None), ("s", "Q", 1.0000003, "mm", None), ("t", "P", 1.0000006, "mm", None),
                                      ("u", "A", 5.0, None, "d"), ("u", "B", 5.0, None, "r")], "sheet_id string, id string, value double, unit string, kind string")
    assert {tuple(r) for r in coverage.pair_labels(labels, readings).collect()} == {("t", "L", "P"), ("u", "L", "A")}


def test_evidence_tolerances(spark):
    decisions = spark.createDataFrame([("s", 1, 100.0), ("s", 2, 100.0), ("s", 3, 0.1), ("s", 4, 7.0)], "sheet_id string, geometry_id int, value double")
    claims = spark.createDataFrame([("s", 1, 100.9), ("s", 2, 101.1)], "sheet_id string, geometry_id int, printed_mm double")
    printed = spark.createDataFrame([("s", 100.19), ("s", 0.1049), ("s", 7.02)], "sheet_id string, printed double")
    got = {r["geometry_id"]: r["level"] for r in coverage.evidence_level(decisions, claims, printed).collect()}
    assert got == {1: "bound", 2: "present", 3: "present", 4: "absent"}
