from draftlake.plans.classifier import logo_classifier


def test_folds_by_hash_keep_every_row(spark):
    """Thirty groups in three folds: no group is refused and each row is scored once."""
    rows = [(i, f"g{i % 30}", float(i % 7), float(i % 7 > 3)) for i in range(240)]
    d = spark.createDataFrame(rows, "id int, sheet string, x double, label double")
    out = logo_classifier(d, "sheet", ["x"], max_folds=3).collect()
    assert sorted(r["id"] for r in out) == list(range(240))
    assert all(0 <= r["score"] <= 1 for r in out)
    # The label follows x, so a model of the other folds tells it.
    assert sum(r["predicted"] == (r["label"] == 1) for r in out) > 200
