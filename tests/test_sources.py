import json

import pytest

from draftlake.operators import ledger
from draftlake.sources import landing


def test_observations(spark, tmp_path):
    doc = {"source": {"ref": "a.pdf", "sha256": "ab", "page": 0}, "frame": {"width": 100, "height": 50},
           "paths": [{"id": "p1", "closed": False, "points": [[0, 0], [1, 1]]}], "primitives": [{"id": "g1", "path_id": "p1", "kind": "line", "start": [0, 0], "end": [1, 1]}],
           "texts": [{"id": "t1", "text": "8", "value": 8, "kind": "linear", "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}}], "skipped": []}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rel = landing.load_observations(spark, str(tmp_path))
    assert rel["primitives"].first()["x1"] == 1.0 and rel["texts"].first()["sheet_id"] == "ab#0" and rel["paths"].count() == 1


def test_unreadable_log_is_missing_evidence(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"run_id": "r1", "calls": [{"call_id": "c", "state": "completed", "kind": "read"}]}))
    (tmp_path / "b.json").write_text("{not json")
    calls, records = landing.load_call_logs(spark, str(tmp_path))
    assert calls.count() == 1 and {r["readable"] for r in records.collect()} == {True, False}


def test_publish_once(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "id * 2 as v")
    path = str(tmp_path / "t")
    assert landing.publish_once(df, path) == "published"
    assert landing.publish_once(df.orderBy("id", ascending=False), path) == "unchanged"
    with pytest.raises(landing.PublishConflict):
        landing.publish_once(df.where("id < 4"), path)


def test_append_keeps_completed_cells(spark, tmp_path):
    path = str(tmp_path / "r")
    first = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "run_id string, cell string, v int")
    landing.append_results(first, path, ["run_id", "cell"])
    again = spark.createDataFrame([("r", "b", 9), ("r", "c", 3)], "run_id string, cell string, v int")
    assert {(r["cell"], r["v"]) for r in landing.append_results(again, path, ["run_id", "cell"]).collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_attempts_and_fingerprints(spark, tmp_path):
    for name, done in (("a1", True), ("a2", False)):
        folder = tmp_path / "cell" / name
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text(json.dumps({"experiment": "e"}))
        if done:
            (folder / "result.json").write_text(json.dumps({"attempt_id": "x", "state": "pass", "parsed": True}))
    got = {r["attempt_dir"]: r["has_result"] for r in landing.load_attempts(spark, str(tmp_path)).collect()}
    assert got == {"a1": True, "a2": False}
    files = landing.fingerprint_files(spark, str(tmp_path / "cell" / "a1" / "*.json"))
    assert files.count() == 2 and all(len(r["sha256"]) == 64 for r in files.collect())


def test_attempts_are_ordered_by_number(spark, tmp_path):
    for name in ("run-9", "run-10", "last"):
        folder = tmp_path / "cell" / name
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text(json.dumps({"experiment": "e"}))
        (folder / "result.json").write_text(json.dumps({"attempt_id": name, "state": "failed"}))
    rows = landing.load_attempts(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["attempt_dir"] for r in rows] == ["last", "run-9", "run-10"]
    chosen, _ = ledger.select_attempts(landing.load_attempts(spark, str(tmp_path)), dict.fromkeys(ledger.IDENTITY) | {"experiment": "e"})
    assert chosen.first()["attempt_id"] == "run-10"
