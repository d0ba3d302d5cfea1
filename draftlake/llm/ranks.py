"""Gapless numbering inside groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gapless(df: DataFrame, group: list[str], out: str, bins: int = 256) -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... in each group of ``group`` (columns without nulls).

    A group is dealt over ``bins`` bins by a hash of the row; a bin starts where the counts of the earlier ones end.
    Equal rows are one row with a count until the end, so neither a hot group nor a row repeated many times meets in
    one window. The order is fixed by the rows alone. An empty table stays empty.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__m")).withColumn("__bin", F.pmod(F.xxhash64(*columns), F.lit(bins)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = counted.groupBy(*group, "__bin").agg(F.sum("__m").alias("__size")).select(
        *group, "__bin", F.coalesce(F.sum("__size").over(earlier(Window.partitionBy(*group).orderBy("__bin"))), F.lit(0)).alias("__base"))
    inside = counted.withColumn("__before", F.coalesce(F.sum("__m").over(earlier(Window.partitionBy(*group, "__bin").orderBy(*columns))), F.lit(0)))
    return inside.join(base, [*group, "__bin"]).select(
        *columns, "__base", "__before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") - 1)).alias("__copy")).select(
        *columns, (F.col("__base") + F.col("__before") + F.col("__copy")).alias(out))
