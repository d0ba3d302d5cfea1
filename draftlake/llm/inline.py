"""Long arrays inside one row, in built-in functions: values worked out once, and running values without growing lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(n: Column) -> Column:
    """array<struct<lo, hi>>: the places 0 to ``n`` - 1 in about sqrt(n) blocks of as many, both ends included; empty for 0.

    A list that grows element by element is copied at each step; kept inside a block, n elements cost n * sqrt(n).
    """
    side = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    cuts = lambda s: F.transform(F.sequence(F.lit(0), n - 1, s), lambda lo: F.struct(lo.alias("lo"), F.least(lo + s, n).alias("end")))
    spread = F.transform(bound(side, cuts), lambda b: F.struct(b["lo"].alias("lo"), (b["end"] - 1).alias("hi")))
    return F.when(n > 0, spread).otherwise(F.expr("cast(array() as array<struct<lo: int, hi: int>>)"))


def before(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of a short array, all earlier ones joined, starting with ``zero``."""
    state = F.struct(zero.alias("now"), F.filter(F.array(zero), lambda x: F.lit(False)).alias("out"))
    step = lambda acc, x: F.struct(join(acc["now"], x).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out"))
    return F.aggregate(values, state, step, lambda acc: acc["out"])
