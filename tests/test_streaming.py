import datetime as dt

from pyspark.sql import functions as F

from draftlake.streaming import ledgers

T0 = dt.datetime(2024, 1, 1)


def _stream(spark, tmp_path, rows, schema, name):
    folder = str(tmp_path / name)
    spark.createDataFrame(rows, schema).write.parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def _run(df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    return df.sparkSession.table(name).collect()


def test_stale_base_is_refused(spark, tmp_path):
    rows = [("s", 0, 0, T0), ("s", 0, 1, T0 + dt.timedelta(seconds=1)), ("s", 1, 2, T0 + dt.timedelta(seconds=2))]
    df = _stream(spark, tmp_path, rows, "session_id string, base_revision int, ord int, ts timestamp", "saves")
    got = sorted((r["ts"], r["status"], r["revision"]) for r in _run(ledgers.stream_revisions(df), "revs", tmp_path))
    assert [(s, r) for _, s, r in got] == [("accepted", 1), ("stale_base_revision", 1), ("accepted", 2)]


def test_duplicate_submissions(spark, tmp_path):
    rows = [("k", T0), ("k", T0 + dt.timedelta(minutes=1)), ("l", T0)]
    df = _stream(spark, tmp_path, rows, "idempotency_key string, ts timestamp", "jobs")
    assert len(_run(ledgers.stream_dedupe(df), "jobs_once", tmp_path)) == 2


def test_windows_match_batch(spark, tmp_path):
    rows = [("completed", T0 + dt.timedelta(minutes=m)) for m in (0, 3, 12, 40)]
    schema = "event string, ts timestamp"
    df = _stream(spark, tmp_path, rows, schema, "ev")
    want = sorted((r["window_start"], r["calls"]) for r in ledgers.stream_outcomes(spark.createDataFrame(rows, schema)).collect())
    got = sorted((r["window_start"], r["calls"]) for r in _run(ledgers.stream_outcomes(df), "wins", tmp_path, "complete"))
    assert got == want


def test_coverage_batches(spark, tmp_path):
    rows = [("s", 1, "8", 8.0), ("s", 2, "x", 9.5)]
    df = _stream(spark, tmp_path, rows, "sheet_id string, id int, text string, value double", "spans")
    printed = spark.createDataFrame([("s", 0, 8.0)], "sheet_id string, ord int, printed double")
    callouts = spark.createDataFrame([("s", "2X")], "sheet_id string, callout string")
    q = ledgers.stream_coverage(df, printed, callouts, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {(r["id"], r["class"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "found"), (2, "noise")}
