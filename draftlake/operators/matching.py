"""One-to-one assignment, region matching and tolerance matching between two relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.geometry import box_iou, centre_distance
from draftlake.operators.grid import box_pairs
from draftlake.session import cut

IOU_MIN, CENTRE_TOL, MARGIN = 0.15, 0.05, 0.05
BOX = ("x0", "y0", "x1", "y1")


def match_regions(claims: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Scored pairs of one page whose boxes share IoU >= 0.15 or whose centres lie within 0.05.

    Both relations carry normalised x0, y0, x1, y1; output (keys, claim_id, candidate_id, score, iou, centre_px).
    """
    c = [f"c_{b}" for b in BOX]
    left = claims.select(*keys, "claim_id", *BOX)
    right = candidates.select(*keys, "candidate_id", *[F.col(b).alias(n) for b, n in zip(BOX, c)])
    pairs = box_pairs(left, right, keys, 0.1, BOX, c, CENTRE_TOL)
    a, b = [F.col(n) for n in BOX], [F.col(n) for n in c]
    pairs = pairs.withColumn("iou", box_iou(a, b)).withColumn("centre_gap", centre_distance(a, b))
    score = F.round(F.least(F.lit(1.0), F.col("iou") + F.greatest(F.lit(0.0), CENTRE_TOL - F.col("centre_gap"))), 6)
    return (
        pairs.where((F.col("iou") >= IOU_MIN) | (F.col("centre_gap") <= CENTRE_TOL)).withColumn("score", score)
        .where("score > 0").select(*keys, "claim_id", "candidate_id", "score", "iou", "centre_gap"))


def assign_greedy(edges: DataFrame, left: Sequence[str], right: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Greedy one-to-one assignment over all edges in one total order.

    Each round keeps every edge that is the first of both its ends; that is exactly what a sequential pass would
    take, because no earlier edge touches either end. Rounds go on until no edge is left.
    """
    left, right = list(left), list(right)
    rest = cut(edges.withColumn("_o", F.struct(*order)))
    taken = None
    while True:
        best_l = rest.groupBy(*left).agg(F.min("_o").alias("_o"))
        best_r = rest.groupBy(*right).agg(F.min("_o").alias("_o"))
        picks = cut(rest.join(best_l, [*left, "_o"], "left_semi").join(best_r, [*right, "_o"], "left_semi"))
        taken = picks if taken is None else taken.unionByName(picks)
        rest = cut(rest.join(picks.select(*left), left, "left_anti").join(picks.select(*right), right, "left_anti"))
        if rest.isEmpty():
            return taken.drop("_o")


def ambiguity(scored: DataFrame, keys: Sequence[str], margin: float = MARGIN) -> DataFrame:
    """Claims that must not be paired: several candidates near their best, or a candidate near-best for several."""
    keys = list(keys)
    # Asked seven times below, so the pairs of boxes are found once and written down.
    scored = cut(scored.select(*keys, "claim_id", "candidate_id", "score"))
    claim, cand = [*keys, "claim_id"], [*keys, "candidate_id"]
    best_c = scored.groupBy(*claim).agg(F.max("score").alias("_b"))
    close = (
        scored.join(best_c, claim).where(F.col("_b") - F.col("score") <= margin).groupBy(*claim)
        .agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*claim, F.lit("close_scores").alias("kind")))
    best_d = scored.groupBy(*cand).agg(F.max("score").alias("_b"))
    owners = scored.join(best_d, cand).where(F.col("_b") - F.col("score") <= margin)
    contested = owners.groupBy(*cand).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = owners.join(contested.select(*cand), cand, "left_semi").select(*claim).distinct().join(close.select(*claim), claim, "left_anti")
    return close.unionByName(shared.withColumn("kind", F.lit("candidate_contested")))


def assign_unambiguous(scored: DataFrame, keys: Sequence[str] = ("page_id",)) -> tuple[DataFrame, DataFrame]:
    """(pairs, ambiguous): ambiguous claims are set aside, the rest are paired best score first."""
    keys = list(keys)
    scored = cut(scored)
    vague = cut(ambiguity(scored, keys))
    claim = [*keys, "claim_id"]
    clear = scored.join(vague.select(*claim), claim, "left_anti")
    ranked = clear.join(clear.groupBy(*claim).agg(F.max("score").alias("_best")), claim)
    order = [-F.col("_best"), F.col("claim_id"), -F.col("score"), F.col("candidate_id")]
    return assign_greedy(ranked, claim, [*keys, "candidate_id"], order).drop("_best"), vague
