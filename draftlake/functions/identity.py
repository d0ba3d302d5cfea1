"""Canonical content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(*columns: Column | str) -> Column:
    """SHA-256 over canonical JSON of the named columns, fields sorted by name, NULL fields kept."""
    named = sorted(columns) if all(isinstance(c, str) for c in columns) else list(columns)
    fields = [F.col(c) if isinstance(c, str) else c for c in named]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def group_identity(df: DataFrame, keys: Sequence[str], rows: Sequence[str], order: Sequence[str], out: str = "identity") -> DataFrame:
    """One hash per key over its rows, whatever their order.

    Rows are hashed one by one and combined by a commutative exact sum of the digest words together with the
    row count, so a group of any size is reduced on the map side instead of being gathered into one list.
    Where order is part of the identity, put the position column among ``rows``.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted({*rows, *order})]), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"_w{i}") for i in range(8)]
    summed = df.withColumn("_d", digest).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *words)
    mixed = F.concat_ws(":", F.col("_n"), *[F.col(f"_w{i}") for i in range(8)])
    return summed.select(*keys, F.sha2(mixed, 256).alias(out))
