"""Readers and writers: fixed schemas on every reader, Spark's commit protocol on every writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.operators.scan import median_by

BOX = "struct<x:double,y:double,w:double,h:double>"
OBSERVATIONS = (
    "source struct<ref:string,sha256:string,page:int,page_size_pt:array<double>,rotation:int>, frame struct<width:double,height:double,dpi:double>,"
    f"paths array<struct<id:string,object_index:int,path_index:int,closed:boolean,bbox:{BOX},points:array<array<double>>,method:string>>,"
    "primitives array<struct<id:string,path_id:string,kind:string,start:array<double>,`end`:array<double>,centre:array<double>,radius:double,"
    "start_degrees:double,end_degrees:double,max_residual_px:double,coverage:double,method:string>>,"
    f"texts array<struct<id:string,text:string,value:double,unit:string,kind:string,count:int,bbox:{BOX},method:string,confidence:double>>,"
    "skipped array<struct<id:string,reason:string>>, notes array<string>")
CALL_LOG = (
    "run_id string, calls array<struct<call_id:string,kind:string,state:string,started_at:timestamp,finished_at:timestamp,image_attached:boolean,"
    "images_in_request:int,prompt_chars:int,server_ok:boolean,error:string>>, _corrupt_record string")
MANIFEST = "experiment string, schema_version string, reader_version string, contract_version string, producer_identity string"


def load_observations(spark: SparkSession, path: str, fmt: str = "json") -> dict[str, DataFrame]:
    """Nested observation documents as flat relations keyed by sheet_id (= source hash and page)."""
    reader = spark.read.schema(OBSERVATIONS)
    docs = reader.option("multiLine", "true").json(path) if fmt == "json" else reader.format(fmt).load(path)
    return flatten_observations(docs)


def flatten_observations(docs: DataFrame) -> dict[str, DataFrame]:
    d = docs.withColumn("sheet_id", F.concat_ws("#", "source.sha256", "source.page"))
    spread = lambda c: d.select("sheet_id", F.posexplode(c).alias("ord", "r")).select("sheet_id", "ord", "r.*")
    prims = spread("primitives")
    xy = lambda c, i: F.col(c)[i]
    prims = prims.select("sheet_id", "ord", "id", "path_id", "kind", xy("start", 0).alias("x0"), xy("start", 1).alias("y0"), xy("end", 0).alias("x1"), xy("end", 1).alias("y1"),
                         xy("centre", 0).alias("cx"), xy("centre", 1).alias("cy"), F.col("radius").alias("r"), "start_degrees", "end_degrees", "max_residual_px", "coverage", "method")
    texts = spread("texts").select("sheet_id", "ord", "id", "text", "value", "unit", "kind", "count", "bbox.x", "bbox.y", "bbox.w", "bbox.h", "method", "confidence")
    return {
        "frames": d.select("sheet_id", F.col("source.sha256").alias("source_digest"), "source.page", "frame.width", "frame.height", "frame.dpi"),
        "paths": spread("paths"), "primitives": prims, "texts": texts, "skipped": spread("skipped"),
    }


def load_call_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(calls, records): an unreadable document is a record without evidence (readable = false), not an empty one."""
    raw = spark.read.schema(CALL_LOG).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    raw = raw.withColumn("file", F.col("_metadata.file_path")).withColumn("readable", F.col("_corrupt_record").isNull() & F.col("run_id").isNotNull())
    records = raw.select(F.coalesce("run_id", "file").alias("run_id"), "file", "readable")
    calls = raw.where("readable").select("run_id", F.inline("calls"))
    return calls, records


def load_candidates(spark: SparkSession, path: str, schema: str, size_columns: list[str]) -> DataFrame:
    """JSON-lines candidate features; size columns rescaled by their sheet's own median text height."""
    df = spark.read.schema(schema).json(path)
    height = median_by(df.where("h > 0"), ["sheet_id"], F.col("h"), "text_height", "mean")
    out = df.join(height, "sheet_id", "left")
    return out.withColumns({f"{c}_rel": F.try_divide(F.col(c), F.col("text_height")) for c in size_columns})


def fingerprint_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) per input file; the same bytes are the same input."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def content_hash(df: DataFrame) -> str:
    """Order-independent hash of a DataFrame's rows, reduced by exact sums on the executors."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    words = [F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(8)]
    total = df.select(row.alias("d")).agg(F.count(F.lit(1)).alias("n"), *words)
    return total.select(F.sha2(F.concat_ws(":", *total.columns), 256).alias("h")).first()["h"]


class PublishConflict(RuntimeError):
    """The place already holds other content."""


def publish_once(df: DataFrame, path: str) -> str:
    """Write once: publishing the same content again is a no-op, other content is an error."""
    spark = df.sparkSession
    try:
        present = spark.read.parquet(path)
    except Exception as missing:  # the path does not exist yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        df.write.mode("errorifexists").parquet(path)
        return "published"
    if sorted(present.columns) != sorted(df.columns) or content_hash(present) != content_hash(df):
        raise PublishConflict(path)
    return "unchanged"


def append_results(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append only the cells not yet stored, partitioned by run_id; a killed run keeps its committed cells."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
        df = df.join(done, keys, "left_anti")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    df.write.mode("append").partitionBy("run_id").parquet(path)
    return spark.read.parquet(path)


def load_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Attempt folders ``<cell>/<attempt>/{manifest,result}.json``; a folder without a readable result is an orphan.

    ``seq`` orders a cell's attempts: by the last number in the folder's name (run-10 after run-9; none: first), then by name.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/[^/]+$", 1)
    attempt = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/[^/]+$", 2)
    read = lambda file, schema: spark.read.schema(schema).option("multiLine", "true").json(f"{path}/*/*/{file}").withColumn("cell", name).withColumn("attempt_dir", attempt)
    m = read("manifest.json", MANIFEST)
    m = m.select("cell", "attempt_dir", F.struct(*[c for c in m.columns if c not in ("cell", "attempt_dir")]).alias("manifest"))
    r = read("result.json", "attempt_id string, state string, parsed boolean").where("state is not null")
    j = m.join(r, ["cell", "attempt_dir"], "left")
    number = F.coalesce(F.expr("try_cast(regexp_extract(attempt_dir, '([0-9]+)[^0-9]*$', 1) as decimal(38,0))"), F.lit(-1))
    return j.select("cell", "attempt_dir", F.coalesce("attempt_id", F.concat_ws("/", "cell", "attempt_dir")).alias("attempt_id"), F.struct(number.alias("number"), F.col("attempt_dir").alias("name")).alias("seq"), "state",
                    F.coalesce("parsed", F.lit(False)).alias("parsed"), "manifest", F.col("state").isNotNull().alias("has_result"))
