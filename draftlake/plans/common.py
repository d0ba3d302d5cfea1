"""Loading the driver tables, and proxy relations built from them by exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.session import broadcast_by_measure, partitions_by_measure

SPREAD_BELOW = 256 << 20
_LARGEST: dict[str, int] = {}  # Bytes of the largest table read so far, by folder.


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    broadcast_by_measure(spark)
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    _LARGEST[sf] = max(_LARGEST.get(sf, 0), size)
    partitions_by_measure(spark, _LARGEST[sf])
    small = size < SPREAD_BELOW
    # A small single-file table is one row group and would keep every expansion on one core.
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as scale readings: sheet = supplier, value = quantity, length = extended price."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sheet_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("length_px"),
        F.col("l_returnflag").alias("view_id"))


READINGS_SQL = """readings as (
  select l_suppkey as sheet_id, l_orderkey * 8 + l_linenumber as ord,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey as id,
         l_quantity as value, l_extendedprice as length_px, l_returnflag as view_id,
         l_extendedprice / l_quantity as ratio
  from lineitem where l_quantity > 0 and l_extendedprice > 0)"""


def consensus_sql(keys: str, minimum: int, source: str = "readings", name: str = "cons") -> str:
    """Brute-force statement of the consensus as CTEs, used only by the DuckDB side."""
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""{name}_r as (select {keys}, ratio, count(*) n, min(ord) ord from {source} group by {keys}, ratio),
{name}_s as (select {', '.join('a.' + k for k in keys.split(', '))}, a.ratio h, any_value(a.ord) ord, sum(b.n) samples
  from {name}_r a join {name}_r b on {on} and abs(b.ratio / a.ratio - 1.0) <= 0.04::double group by {', '.join('a.' + k for k in keys.split(', '))}, a.ratio),
{name}_b as (select * from (select *, row_number() over (partition by {keys} order by samples desc, ord, h) rn from {name}_s)
  where rn = 1 and samples >= {minimum}),
{name}_i as (select {', '.join('a.' + k for k in keys.split(', '))}, a.ratio, b.h, b.samples,
  row_number() over (partition by {', '.join('a.' + k for k in keys.split(', '))} order by a.ratio) pos
  from {source} a join {name}_b b on {on} where abs(a.ratio / b.h - 1.0) <= 0.04::double),
{name} as (select {keys}, max(case when pos = samples // 2 + 1 then ratio end) px_per_mm, max(samples)::bigint samples,
  (max(ratio) - min(ratio)) / max(case when pos = samples // 2 + 1 then ratio end) spread from {name}_i group by {keys})"""


# Printed texts made from parts. One portable expression serves both engines.
CALLOUT_TEXT = """concat(
  case when p_partkey % 5 = 0 then concat(cast(p_partkey % 7 + 1 as string), 'x ')
       when p_partkey % 5 = 1 then concat(cast(p_partkey % 7 + 2 as string), 'X2-') else '' end,
  case when p_partkey % 4 = 0 then 'Ø' when p_partkey % 4 = 1 then 'R' else '' end,
  case when p_partkey % 11 = 0 then '1 1/4' when p_partkey % 3 = 0 then cast(p_partkey % 40 + 1 as string)
       when p_partkey % 3 = 1 then concat(cast(p_partkey % 40 + 1 as string), ',', cast(p_partkey % 9 + 1 as string), '0')
       else concat(cast(p_partkey % 40 + 1 as string), '.', cast(p_partkey % 10 as string)) end,
  case when p_partkey % 6 = 0 then ' THRU' when p_partkey % 6 = 1 then concat(' DEEP ', cast(p_size as string))
       when p_partkey % 6 = 2 then ' THRU ALL' when p_partkey % 6 = 3 then concat(' ', p_name)
       when p_partkey % 6 = 4 then ' TYP' else '' end,
  case when p_partkey % 8 = 0 then ' mm' when p_partkey % 8 = 1 then ' in' when p_partkey % 8 = 2 then '"' else '' end)"""
SHEET_UNIT = "case when p_partkey % 7 = 0 then 'in' when p_partkey % 7 < 4 then 'mm' end"


def callout_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as printed callouts: sheet = brand, text assembled from key residues."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey as id", "p_brand as sheet_id", f"{CALLOUT_TEXT} as text", f"{SHEET_UNIT} as sheet_unit")


CALLOUT_SQL = f"ct as (select p_partkey id, p_brand sheet_id, {CALLOUT_TEXT} as text, {SHEET_UNIT} as sheet_unit from part)"
