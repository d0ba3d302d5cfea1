"""Verdict columns for comparing an expected with a given value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftlake.constants import MM_PER_INCH

NUM_REL, NUM_ABS = 0.02, 0.05


def _mm(value: Column, unit: Column) -> Column:
    return F.when(unit.eqNullSafe("in"), value * MM_PER_INCH).otherwise(value)


def num_verdict(expected: Column, expected_unit: Column, given: Column, given_unit: Column) -> Column:
    """correct, unit_error, value_error, omission, false_claim or not_applicable."""
    want, got = _mm(expected, expected_unit), _mm(given, given_unit)
    close = F.abs(got - want) <= F.greatest(F.lit(NUM_ABS), NUM_REL * F.abs(want))
    unit_want = F.coalesce(expected_unit, F.lit("mm"))
    unit_got = F.coalesce(given_unit, unit_want)
    return (
        F.when(expected.isNull() & given.isNull(), "not_applicable").when(given.isNull(), "omission")
        .when(expected.isNull(), "false_claim").when(close, "correct")
        .when(unit_want != unit_got, "unit_error").otherwise("value_error")
    )


def cat_verdict(expected: Column, given: Column, positive: Sequence[str] = ()) -> Column:
    """correct, mismatch, overclaim, abstained or not_applicable."""
    claimed = given.isin(*positive) if positive else F.lit(False)
    return (
        F.when(expected.isNull(), "not_applicable")
        .when(given.isNull() | (given == "unknown"), "abstained").when(given == expected, "correct")
        .when(expected.isin("underdetermined", "unknown") & claimed, "overclaim").otherwise("mismatch")
    )
