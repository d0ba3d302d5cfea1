"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLE_BYTES_PER_PART = 2 << 20
TASK_BYTES = 16 << 20

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "draftlake", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def broadcast_by_measure(spark: SparkSession) -> None:
    """Let a join broadcast a side only when its size was measured, at most as large as the session allows.

    Before a job runs, Spark judges a side by the bytes of its files. A part is a few compressed bytes there and a sheet
    of strokes after the first expansion, so hundreds of MB would be gathered in the driver. The same limit now holds for
    what a finished shuffle has written.
    """
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if limit != "-1":
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def partitions_by_measure(spark: SparkSession, size: int) -> None:
    """Deal shuffles into so many parts that a task's share does not grow with the tables, which take ``size`` bytes.

    A fixed number of shuffle partitions gives each task a share of the input, and its sorts and hash tables grow with it.
    Small parts are put together again at run time, up to ``TASK_BYTES`` of written shuffle;
    a scan takes twice that of a file.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TABLE_BYTES_PER_PART))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 * TASK_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so iterations survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a compressed table in the shared checkpoint folder.

    Like ``cut``, but in columns, so it takes a fraction of the disk and a reader takes only the columns it needs. Rows come
    back in no order.
    """
    spark, path = df.sparkSession, f"{ensure_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
