"""Distance joins as equi-joins on (keys, cell)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.session import cut


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size)))


def neighbours(value: Column, size: float, reach: Column | float | None = None) -> Column:
    """All cells within ``reach`` of a coordinate."""
    r = F.lit(float(size)) if reach is None else (reach if isinstance(reach, Column) else F.lit(float(reach)))
    return F.sequence(cell(value - r, size), cell(value + r, size))


def once_per_pair(pairs: DataFrame, left: DataFrame, lkeys: Sequence[str], right: DataFrame, rkeys: Sequence[str]) -> DataFrame:
    """One row for each (lkeys, rkeys) of ``pairs``, in which every row of ``left`` meets a row of ``right`` once at most.

    Where the keys of both sides are unique nothing can repeat, and the pairs, which may be many times the tables, need no
    shuffle.
    """
    repeated = lambda df, keys: not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
    if repeated(left, lkeys) or repeated(right, rkeys):
        return pairs.dropDuplicates(list(dict.fromkeys([*lkeys, *rkeys])))
    return pairs


def near_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], radius: float,
    lxy: tuple[str, str], rxy: tuple[str, str], out: str = "distance_px", how: str = "inner",
) -> DataFrame:
    """Pairs of one key whose points lie within ``radius``.

    The right side keeps one row per point in its own cell; the left side is copied to the cells its disc
    touches (at most four), so each pair meets exactly once and needs no duplicate removal.
    """
    g = 2.0 * radius
    lx, ly = (F.col(c) for c in lxy)
    rx, ry = (F.col(c) for c in rxy)
    spread = (
        left.withColumn("_cx", F.explode(neighbours(lx, g, radius)))
        .withColumn("_cy", F.explode(neighbours(ly, g, radius)))
    )
    placed = right.withColumn("_cx", cell(rx, g)).withColumn("_cy", cell(ry, g))
    distance = F.sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry))
    return (
        spread.join(placed, [*keys, "_cx", "_cy"])
        .withColumn(out, distance).where(F.col(out) <= F.lit(float(radius))).drop("_cx", "_cy")
    )


def nearest_within(
    left: DataFrame, right: DataFrame, keys: Sequence[str], radius: float,
    lxy: tuple[str, str], rxy: tuple[str, str], tie: Sequence[str], out: str = "nearest",
) -> DataFrame:
    """(keys, lxy, out): for each left place the least struct (distance, *tie) of the right points within ``radius``.

    The disc begins at the mean gap between the points of a key and doubles for the places that met nothing, so a place
    meets a few points however crowded its sheet is, and the rounds grow with the logarithm of the radius in such gaps.
    Places without any point within ``radius`` are left out.
    """
    keys = list(keys)
    lx, ly, rx, ry = (F.col(c) for c in (*lxy, *rxy))
    points = right.groupBy(*keys, *rxy).agg(F.min(F.struct(*tie)).alias("_tie"))
    wide, high = F.max(rx) - F.min(rx), F.max(ry) - F.min(ry)
    gap = F.greatest(F.sqrt(wide * high / F.count(F.lit(1))), F.greatest(wide, high) / F.count(F.lit(1)), F.lit(radius / 4096))
    points = cut(points)
    start = points.groupBy(*keys).agg(F.least(gap, F.lit(float(radius))).alias("_r"))
    points = points.join(start, keys)
    opened, found, times = cut(left.select(*keys, *lxy).distinct().join(start, keys)), None, 1.0
    while True:
        r = F.least(F.col("_r") * times, F.lit(float(radius)))
        reach, size = r * (1 + 1e-9), r * 2
        at = lambda v, off: F.floor((v + off) / size)
        spread = opened.withColumn("_cx", F.explode(F.sequence(at(lx, -reach), at(lx, reach)))).withColumn("_cy", F.explode(F.sequence(at(ly, -reach), at(ly, reach))))
        placed = points.select(*keys, *rxy, "_tie", F.floor(rx / size).alias("_cx"), F.floor(ry / size).alias("_cy"))
        distance = F.sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry))
        hits = spread.join(placed, [*keys, "_cx", "_cy"]).withColumn("_d", distance).where(F.col("_d") <= r)
        hits = cut(hits.groupBy(*keys, *lxy).agg(F.min(F.struct(F.col("_d").alias("distance"), "_tie.*")).alias(out)))
        found = hits if found is None else found.unionByName(hits)
        opened = cut(opened.where(F.col("_r") * times < radius).join(hits, [*keys, *lxy], "left_anti"))
        if opened.isEmpty():
            return found
        times *= 2


def near_values(
    left: DataFrame, right: DataFrame, keys: Sequence[str], lvalue: str, rvalue: str, reach: Column, size: float,
    condition: Column,
) -> DataFrame:
    """One-dimensional band join: left rows visit the cells within ``reach`` of their value."""
    spread = left.withColumn("_cv", F.explode(neighbours(F.col(lvalue), size, reach)))
    placed = right.withColumn("_cv", cell(F.col(rvalue), size))
    return spread.join(placed, [*keys, "_cv"]).where(condition).drop("_cv")


def box_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], size: float,
    lbox: Sequence[str], rbox: Sequence[str], margin: float = 0.0,
) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1) that overlap or come within ``margin``, each pair once.

    Both sides cover their cells; the pair is kept only in the first cell they share.
    """
    lx0, ly0, lx1, ly1 = (F.col(c) for c in lbox)
    rx0, ry0, rx1, ry1 = (F.col(c) for c in rbox)
    m = F.lit(float(margin))
    a = (
        left.withColumn("_lcx", cell(lx0 - m, size)).withColumn("_lcy", cell(ly0 - m, size))
        .withColumn("_cx", F.explode(F.sequence(F.col("_lcx"), cell(lx1 + m, size))))
        .withColumn("_cy", F.explode(F.sequence(F.col("_lcy"), cell(ly1 + m, size))))
    )
    b = (
        right.withColumn("_rcx", cell(rx0, size)).withColumn("_rcy", cell(ry0, size))
        .withColumn("_cx", F.explode(F.sequence(F.col("_rcx"), cell(rx1, size))))
        .withColumn("_cy", F.explode(F.sequence(F.col("_rcy"), cell(ry1, size))))
    )
    first = (F.col("_cx") == F.greatest("_lcx", "_rcx")) & (F.col("_cy") == F.greatest("_lcy", "_rcy"))
    touch = (lx0 - m <= rx1) & (rx0 <= lx1 + m) & (ly0 - m <= ry1) & (ry0 <= ly1 + m)
    return a.join(b, [*keys, "_cx", "_cy"]).where(first & touch).drop("_cx", "_cy", "_lcx", "_lcy", "_rcx", "_rcy")
