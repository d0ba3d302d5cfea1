"""Region checks: a reason code per failure, NULL when the region is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _infinite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def region_issue(region: Column) -> Column:
    """Normalised [x0, y0, x1, y1]: wrong_length, missing, nonfinite, out_of_order."""
    x0, y0, x1, y1 = (region[i] for i in range(4))
    ordered = (x0 >= 0) & (x0 < x1) & (x1 <= 1) & (y0 >= 0) & (y0 < y1) & (y1 <= 1)
    return (
        F.when(region.isNull(), "missing").when(F.size(region) != 4, "wrong_length")
        .when(F.exists(region, lambda v: v.isNull()), "missing")
        .when(F.exists(region, _infinite), "nonfinite").when(~ordered, "out_of_order")
    )


def bbox_issue(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixel box inside its frame: nonfinite, area, outside."""
    return (
        F.when(_infinite(x) | _infinite(y) | _infinite(w) | _infinite(h), "invalid_bbox_nonfinite")
        .when((w <= 0) | (h <= 0), "invalid_bbox_area")
        .when((x < 0) | (y < 0) | (x + w > width) | (y + h > height), "bbox_outside_frame")
    )


def coordinates_valid(regions: Column) -> Column:
    """Are all coordinates of all given regions (ARRAY<ARRAY<DOUBLE>>, NULL regions allowed) in 0..1?"""
    return F.forall(regions, lambda r: r.isNull() | ((F.size(r) == 4) & F.forall(r, lambda v: F.coalesce(v.between(0, 1), F.lit(False)))))


def check_region(df: DataFrame, region_col: str) -> DataFrame:
    return df.withColumn("region_issue", region_issue(F.col(region_col)))
