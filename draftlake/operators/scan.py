"""Ordered scans over groups of any size.

A plain window puts one whole group into one task. When a group is larger than
``draftlake.rowsPerTask`` the rows are range-partitioned on (keys, order) instead, each range is scanned on
its own, and only one summary row per range crosses to the next one. Callers that chain several scans decide
once, on the key columns of their input, and pass the answer down as ``hot``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftlake.session import cut

ROWS_PER_TASK = "draftlake.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 4_000_000


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


def has_hot_group(df: DataFrame, keys: Sequence[str]) -> bool:
    """Is any group larger than one task should hold? One count over the key columns only."""
    limit = rows_per_task(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return not sizes.where(F.col("_n") > limit).limit(1).isEmpty()


def _ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # The range bounds are sampled, so the partition number is only stable once it is written down.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    return cut(ranged.withColumn("_blk", F.spark_partition_id()))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str, hot: bool | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` within each key."""
    order = list(order)
    if not (has_hot_group(df, keys) if hot is None else hot):
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(w))
    ranged = _ranges(df.withColumn("_v", value), keys, order)
    w = W.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_t"))
        .withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    )
    local = ranged.withColumn("_local", F.sum("_v").over(w))
    return (
        local.join(offsets, [*keys, "_blk"])
        .withColumn(out, F.col("_local") + F.col("_off")).drop("_local", "_off", "_blk", "_v")
    )


def running_max_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str, hot: bool | None = None,
) -> DataFrame:
    """Maximum of ``value`` over all earlier rows of the key (NULL on the first row)."""
    order = list(order)
    if not (has_hot_group(df, keys) if hot is None else hot):
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(out, F.max(value).over(w))
    ranged = _ranges(df.withColumn("_v", value), keys, order)
    w = W.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        ranged.groupBy(*keys, "_blk").agg(F.max("_v").alias("_t"))
        .withColumn("_off", F.max("_t").over(before)).drop("_t")
    )
    local = ranged.withColumn("_local", F.max("_v").over(w))
    return (
        local.join(carried, [*keys, "_blk"])
        .withColumn(out, F.greatest("_local", "_off")).drop("_local", "_off", "_blk", "_v")
    )


def lag_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str, hot: bool | None = None,
) -> DataFrame:
    """``value`` of the previous row of the key. ``order`` must be total and ``value`` a struct (never NULL)."""
    order = list(order)
    if not (has_hot_group(df, keys) if hot is None else hot):
        return df.withColumn(out, F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))
    ranged = _ranges(df.withColumn("_v", value).withColumn("_o", F.struct(*order)), keys, order)
    last = ranged.groupBy(*keys, "_blk").agg(F.max_by("_v", "_o").alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_blk"))).drop("_last")
    local = ranged.withColumn("_local", F.lag("_v").over(W.partitionBy(*keys, "_blk").orderBy(*order)))
    return (
        local.join(carried, [*keys, "_blk"])
        .withColumn(out, F.coalesce("_local", "_carry")).drop("_local", "_carry", "_last", "_blk", "_v", "_o")
    )


def positions(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Gapless place of every row, from 0, in ``order`` over the whole table.

    Each range of the order counts on its own, and only one count per range crosses to the next one, so no task sees
    more than its range, whatever the keys. Rows that tie in ``order`` are numbered side by side in any order.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # An id holds the range in its upper bits and the place in the range in its lower 33; writing fixes both.
    numbered = cut(ranged.withColumn("_id", F.monotonically_increasing_id()))
    local = numbered.withColumn("_blk", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    before = W.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    offsets = local.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n")).select("_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return local.join(offsets, "_blk").withColumn(out, F.col("_at") + F.col("_off")).drop("_id", "_blk", "_at", "_off")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key in a total order.

    Spark cuts each input partition to its own first ``k`` rows before the shuffle (WindowGroupLimit), so a hot
    key ships at most ``k`` rows per map task.
    """
    name = rank or "_rank"
    w = W.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def attach(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Group statistics joined back onto every row: a partial aggregate and a skew-splittable join, where a
    window would hold the whole group in one task."""
    return df.join(df.groupBy(*keys).agg(*aggregates), list(keys), "left")


def rank_value(
    counts: DataFrame, keys: Sequence[str], value: str, weight: str, out: str, which: str = "upper", hot: bool | None = None,
) -> DataFrame:
    """Exact order statistic per key from (keys, value, weight) rows with distinct values.

    ``which``: ``upper`` is the element at ``size div 2``; ``mean`` averages the two middle elements.
    """
    total = counts.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    ranked = running_sum(counts, keys, [F.col(value)], F.col(weight), "_cum", hot).join(total, list(keys))
    upper = F.min(F.when(F.col("_cum") > F.floor(F.col("_total") / 2), F.col(value)))
    if which == "upper":
        return ranked.groupBy(*keys).agg(upper.alias(out))
    lower = F.min(F.when(F.col("_cum") > F.floor((F.col("_total") - 1) / 2), F.col(value)))
    return ranked.groupBy(*keys).agg(((lower + upper) / 2).alias(out))


def median_by(
    df: DataFrame, keys: Sequence[str], value: Column, out: str, which: str = "upper", hot: bool | None = None,
) -> DataFrame:
    """Exact median per key; equal values are counted before anything is shuffled."""
    counts = (
        df.select(*keys, value.alias("_value")).where(F.col("_value").isNotNull())
        .groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_weight"))
    )
    return rank_value(counts, keys, "_value", "_weight", out, which, hot)
