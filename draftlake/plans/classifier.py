"""Leave-one-group-out detector: standardised logistic regression per held-out group on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.operators.scan import running_sum
from draftlake.session import cut


def recall_threshold(scored: DataFrame, recall: float = 0.9) -> float:
    """Largest score threshold whose recall on ``scored`` (score, label) reaches ``recall``."""
    positives = scored.where("label = 1").groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(1))
    total = positives.agg(F.sum("n").alias("t")).first()["t"] or 0
    if not total:
        return 1.0
    cum = running_sum(positives, ["all"], [F.col("score").desc()], F.col("n"), "cum")
    return cum.where(F.col("cum") >= recall * total).agg(F.max("score").alias("s")).first()["s"]


def logo_classifier(df: DataFrame, group: str, features: Sequence[str], label: str = "label", recall: float = 0.9, max_folds: int = 20) -> DataFrame:
    """Predictions of every row by a model that never saw its group: (group, row columns, score, predicted).

    Scaling is fitted on the training rows only. A fold is one group; with more than ``max_folds`` groups a fold is all
    groups of one hash value, so the number of fits is bounded at any number of groups and no row is left out.
    """
    few = df.select(group).distinct().limit(max_folds + 1).count() <= max_folds
    key = F.col(group) if few else F.pmod(F.xxhash64(group), F.lit(max_folds))
    data = df.withColumn("label", F.col(label).cast("double")).withColumn("_fold", F.coalesce(key.cast("string"), F.lit("")))
    rows = cut(VectorAssembler(inputCols=list(features), outputCol="raw").transform(data))
    stages = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), LogisticRegression(maxIter=50, regParam=0.01)])
    out = None
    for fold in sorted(r[0] for r in rows.select("_fold").distinct().collect()):
        train, held = rows.where(F.col("_fold") != fold), rows.where(F.col("_fold") == fold)
        model = stages.fit(train)
        score = vector_to_array("probability")[1]
        limit = recall_threshold(model.transform(train).select(score.alias("score"), "label"), recall)
        part = model.transform(held).withColumn("score", score).withColumn("predicted", F.col("score") >= limit).select(*df.columns, "score", "predicted")
        out = part if out is None else out.unionByName(part)
    return out
