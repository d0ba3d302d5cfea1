import pytest
from pyspark.sql import functions as F

from draftlake.functions.callouts import extract_callouts
from draftlake.functions.text import extract_dimensions
from draftlake.operators import texts

CALLOUTS = {
    "Ø8": ("parsed", "diameter", 8.0, None, None, None), "25 mm": ("parsed", "linear", 25.0, None, None, None),
    "4 × Ø8 THRU": ("parsed", "diameter", 8.0, 4, "thru", None), "4 x Ø6,80 THRU ALL": ("parsed", "diameter", 6.8, 4, "thru", None),
    "Ø10 6 DEEP": ("parsed", "diameter", 10.0, None, "blind", 6.0), ".375 DIA": ("parsed", "diameter", 0.375, None, None, None),
    "Ø8 10": ("ambiguous", "diameter", 8.0, None, None, None), "Ø8 HELLO": ("unsupported", "diameter", 8.0, None, None, None), "1,234": ("ambiguous", None, None, None, None, None),
    "": ("unsupported", None, None, None, None, None),
}
DIMENSIONS = {
    "1.563in": ("linear", 1.563, "in", 1), "1 1/4": ("linear", 1.25, "in", 1), "4 x 6.80 THRU ALL": ("linear", 6.8, "mm", 4),
    "2389K26": ("text", None, "mm", 1), "4x2-Ø30": ("diameter", 30.0, "mm", 8), "45°": ("angle", 45.0, "mm", 1), "R5": ("radius", 5.0, "mm", 1),
}


def test_callouts(spark):
    df = extract_callouts(spark.createDataFrame([(t,) for t in CALLOUTS], "t string"), "t")
    got = {r["t"]: (r["status"], r["form"], r["size"], r["count"], r["termination"], r["depth"]) for r in df.select("t", "callout.*").collect()}
    assert got == CALLOUTS
    # A filter on the result must not blow the plan up.
    assert df.where("callout.status = 'parsed'").select(F.explode("callout.warnings").alias("w")).where("w = 'unit_unresolved'").count() == 5


def test_sheet_unit_notes(spark):
    df = extract_callouts(spark.createDataFrame([("25 mm", "in"), ("Ø8", "mm")], "t string, u string"), "t", "u")
    assert [r["w"] for r in df.select(F.col("callout.warnings").alias("w")).collect()] == [["unit_differs_from_sheet"], ["unit_unresolved"]]


def test_dimensions(spark):
    df = extract_dimensions(spark.createDataFrame([(t,) for t in DIMENSIONS], "t string"), "t")
    got = {r["t"]: (r["dim_kind"], r["dim_value"], r["dim_unit"], r["dim_count"]) for r in df.collect()}
    assert got == {k: (a, pytest.approx(b) if b else b, c, d) for k, (a, b, c, d) in DIMENSIONS.items()}


def test_all_observations_of_a_region_stay(spark):
    """A region has as many provenance rows as distinct ids; repeated observations count once."""
    rows = [("a", f"t{i % 500}", "M8", "pdf-text", 10.0, 10.0, 20.0, 5.0) for i in range(700)]
    observed = spark.createDataFrame(rows, "sheet_id string, id string, text string, method string, x double, y double, w double, h double")
    frames = spark.createDataFrame([("a", "digest", 100.0, 100.0)], "sheet_id string, source_digest string, width double, height double")
    candidates, diagnostics = texts.callout_candidates(observed, frames, "d")
    one = candidates.first()
    assert (one["n_ids"], one["first_id"], one["machine_text_hint"]) == (500, "t0", "M8")
    assert texts.candidate_observations(observed, frames, "d").where(F.col("candidate_id") == one["candidate_id"]).count() == 500
    assert diagnostics.count() == 0


def test_count_names_count_on_until_free(spark):
    names = [("s", "1", "n"), ("s", "2", "n_count"), ("s", "3", "n_count_2"), ("s", "4", "n_count_4"), ("s", "5", "m"), ("r", "1", "n")]
    printed = spark.createDataFrame([(s, i, 1.0, "mm", "2 x 1", "linear", 2) for s, i, _ in names], "sheet_id string, span_id string, value double, unit string, text string, kind string, count int")
    named = spark.createDataFrame(names, "sheet_id string, span_id string, name string")
    rows, errors = texts.build_catalog(printed, named, named.selectExpr("sheet_id", "span_id", "'distance' form", "'confirmed' resolution"))
    made = {(r["sheet_id"], r["span_id"]): r["name"] for r in rows.where("quantity = 'count'").collect()}
    assert made == {("s", "1"): "n_count_3", ("s", "2"): "n_count_count", ("s", "3"): "n_count_2_count", ("s", "4"): "n_count_4_count", ("s", "5"): "m_count", ("r", "1"): "n_count"}
    assert errors.count() == 0
