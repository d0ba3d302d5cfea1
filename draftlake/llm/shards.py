"""Sharding by jump consistent hashing (Lamping and Veach): no ring table, and an appended shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.ranks import gapless


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every unsigned 64-bit key, all keys advancing together."""
    state = keys.astype(np.uint64).copy()
    shard, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = ((shard[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards))

    return place(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """``df`` with the shard of its long ``key``. No shuffle; other columns stay as they are."""
    return df.withColumn(out, shard_of(F.col(key), shards))


def place_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its shard, its slot there and its shard once there is one shard more.

    Law ``key``: doc_id and the number of shards decide alone. size is the UTF-8 length of the text plus 1; a null text
    has size 1 and CRC 0, like an empty one; a null doc_id is placed as key 0. Repeated rows get slots of their own.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"))
    placed = rows.select("*", F.lit("key").alias("law"), shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
    return gapless(placed, ["shard"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write ``df`` as Parquet with one folder per shard; rows of a shard come from many tasks, so no shard meets in one."""
    assign_shards(df, key, shards).write.partitionBy("shard").parquet(path)
