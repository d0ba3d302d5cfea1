"""Corpus evaluation: predictions against gold claims, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.verdicts import cat_verdict, num_verdict
from draftlake.operators.grid import box_pairs
from draftlake.operators.matching import BOX, CENTRE_TOL, IOU_MIN, assign_unambiguous, match_regions
from draftlake.functions.geometry import box_area, box_intersection, box_iou, centre_distance

FIELDS = ["representation", "physical", "form", "size", "count_printed", "termination", "depth", "target_binding"]
SEMANTIC_FIELDS = FIELDS[:-1]
WRONG = ["mismatch", "value_error", "unit_error", "overclaim", "false_claim"]
ABSTAINED = ["abstained", "omission", "not_produced"]
ECHO_TOL = 0.0006


def evaluate_pages(gold: DataFrame, candidates: DataFrame, scopes: DataFrame, keys: Sequence[str] = ("page_id", "arm")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(field_rows, statuses, extras).

    ``gold`` (page_id, claim_id, x0..y1, the seven expected fields, unit); ``candidates`` (page_id, arm,
    candidate_id, x0..y1, the given fields, size_unit, depth_unit: NULL where not stated); ``scopes`` (page_id,
    scope full_page/regions/predicates/NULL, regions ARRAY<STRUCT<x0, y0, x1, y1>>).
    """
    keys = list(keys)
    arms = candidates.select(*keys).distinct()
    claims = gold.join(arms, "page_id")
    scored = match_regions(claims, candidates, keys)
    pairs, vague = assign_unambiguous(scored, keys)
    claim = [*keys, "claim_id"]
    state = (
        claims.select(*claim).join(pairs.select(*claim, "candidate_id", "score"), claim, "left").join(vague.select(*claim, F.lit(True).alias("_v")), claim, "left")
        .withColumn("status", F.when(F.col("candidate_id").isNotNull(), "matched").when(F.col("_v"), "ambiguous").otherwise("unmatched")).drop("_v"))
    g = lambda n: F.col(f"g.{n}")
    c = lambda n: F.col(f"c.{n}")
    joined = (
        state.alias("s").join(claims.alias("g"), claim).join(candidates.alias("c"), [*keys, "candidate_id"], "left"))
    piece = F.lit("count")
    unit = F.coalesce(g("unit"), F.lit("mm"))
    verdicts = {
        "representation": cat_verdict(g("representation"), c("representation"), ["circle", "arc"]),
        "physical": cat_verdict(g("physical"), c("physical"), ["hole", "pocket", "slot"]),
        "form": cat_verdict(g("form"), c("form")),
        "size": num_verdict(g("size"), unit, c("size"), c("size_unit")),
        "count_printed": num_verdict(g("count_printed").cast("double"), piece, c("count_printed").cast("double"), piece),
        "termination": cat_verdict(g("termination"), c("termination")),
        "depth": num_verdict(g("depth"), unit, c("depth"), c("depth_unit")),
        "target_binding": F.lit("correct"),
    }
    side = lambda which, f: F.lit(None).cast("string") if f == "target_binding" else which(f).cast("string")
    rows = F.array(*[F.struct(
        F.lit(f).alias("field"),
        F.when(F.col("status") == "matched", v).when(F.col("status") == "ambiguous", "not_scored").otherwise("not_produced").alias("verdict"),
        side(g, f).alias("expected"), side(c, f).alias("given")) for f, v in verdicts.items()])
    field_rows = joined.select(*claim, "candidate_id", "status", F.inline(rows))
    extras = candidates.select(*keys, "candidate_id", *BOX).join(pairs.select(*keys, "candidate_id"), [*keys, "candidate_id"], "left_anti")
    named = scopes.where("scope in ('full_page', 'regions', 'predicates')")
    areas = named.where("scope = 'regions'").select("page_id", F.inline("regions")).unionByName(
        named.where("scope = 'predicates'").join(gold, "page_id").select("page_id", *BOX))
    r = [f"r_{b}" for b in BOX]
    areas = areas.select("page_id", *[F.col(b).alias(n) for b, n in zip(BOX, r)]).distinct()
    a, b = [F.col(n) for n in BOX], [F.col(n) for n in r]
    inside = box_pairs(extras, areas, ["page_id"], 0.1, BOX, r, CENTRE_TOL).where((box_iou(a, b) >= IOU_MIN) | (centre_distance(a, b) <= CENTRE_TOL))
    inside = inside.select(*keys, "candidate_id").distinct().withColumn("_in", F.lit(True))
    full = named.where("scope = 'full_page'").select("page_id", F.lit(True).alias("_full"))
    scorable = F.col("_in").isNotNull() | F.col("_full").isNotNull()
    extras = extras.join(inside, [*keys, "candidate_id"], "left").join(full, "page_id", "left").select(
        *keys, "candidate_id", F.when(scorable, "false_positive").otherwise("unscorable_extra_candidate").alias("kind"))
    return field_rows, state, extras


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where there is nothing to divide by."""
    return F.bround(F.try_divide(numerator, denominator), 4)


def aggregate_metrics(field_rows: DataFrame, keys: Sequence[str] = ("arm",)) -> DataFrame:
    """Per field, and in total (field NULL): correct, wrong, abstained, accuracy and rates."""
    flags = field_rows.select(
        *keys, "field", (F.col("verdict") == "correct").alias("ok"), F.col("verdict").isin(*WRONG).alias("bad"),
        F.col("verdict").isin(*ABSTAINED).alias("none"), F.col("verdict").isin("overclaim", "false_claim").alias("over"),
        (F.col("verdict") == "not_scored").alias("skip"))
    sums = [F.count_if("ok").alias("correct"), F.count_if("bad").alias("wrong"), F.count_if("none").alias("abstained"),
            F.count_if("over").alias("overclaims"), F.count_if("skip").alias("unscored")]
    per = flags.groupBy(*keys, "field").agg(*sums)
    total = per.where(F.col("field").isin(*SEMANTIC_FIELDS)).groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in ("correct", "wrong", "abstained", "overclaims", "unscored")]).withColumn("field", F.lit("all_semantic"))
    scorable = F.col("correct") + F.col("wrong") + F.col("abstained")
    return per.unionByName(total).withColumn("scorable", scorable).withColumns({
        "accuracy": ratio(F.col("correct"), scorable), "abstention_rate": ratio(F.col("abstained"), scorable),
        "wrong_rate": ratio(F.col("wrong"), scorable), "overclaim_rate": ratio(F.col("overclaims"), scorable)})


def localisation(statuses: DataFrame, candidates: DataFrame, extras: DataFrame, keys: Sequence[str] = ("arm",)) -> DataFrame:
    """Region matching apart from field accuracy."""
    keys = list(keys)
    n = statuses.groupBy(*keys).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status") == "matched").alias("matched"),
                                    F.count_if(F.col("status") == "ambiguous").alias("ambiguous"))
    m = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"))
    e = extras.groupBy(*keys).agg(F.count_if(F.col("kind") == "false_positive").alias("false_positives"),
                                  F.count_if(F.col("kind") != "false_positive").alias("unscorable_extras"))
    return n.join(m, keys, "left").join(e, keys, "left").withColumn(
        "localization_match_rate", ratio(F.col("matched"), F.col("claims"))).withColumn("candidate_precision", ratio(F.col("matched"), F.col("candidates")))


def compare_arms(field_rows: DataFrame, base: str, arm: str) -> DataFrame:
    """Per predicate: scorable, recovered, regressed_wrong, regressed_abstention, net gain of ``arm`` over ``base``."""
    ok = F.when(F.col("status") == "ambiguous", None).when(F.col("status") == "unmatched", False).otherwise(
        F.when(F.col("verdict") != "not_scored", F.col("verdict").isin("correct", "not_applicable")))
    rows = field_rows.withColumn("ok", ok)
    key = ["page_id", "claim_id", "field"]
    side = lambda name, p: rows.where(F.col("arm") == name).select(*key, F.col("ok").alias(f"{p}_ok"), F.col("status").alias(f"{p}_status"))
    both = side(base, "b").join(side(arm, "a"), key).where("b_ok is not null and a_ok is not null")
    lost = F.col("b_ok") & ~F.col("a_ok")
    out = both.groupBy("field").agg(
        F.count(F.lit(1)).alias("scorable"), F.count_if(~F.col("b_ok") & F.col("a_ok")).alias("recovered"),
        F.count_if(lost & (F.col("a_status") == "matched")).alias("regressed_wrong"),
        F.count_if(lost & (F.col("a_status") != "matched")).alias("regressed_abstention"))
    return out.withColumn("net_gain", F.col("recovered") - F.col("regressed_wrong") - F.col("regressed_abstention"))


def overclaims(field_rows: DataFrame, keys: Sequence[str] = ("arm",)) -> DataFrame:
    """Invented fields of matched pairs: size, count, form, thru, depth, physical meaning."""
    f, v = F.col("field"), F.col("verdict")
    open_, given = F.col("expected").isNull() | F.col("expected").isin("unknown", "underdetermined"), F.col("given").isNotNull() & (F.col("given") != "unknown")
    tests = {
        "invented_size": (f == "size") & (v == "false_claim"), "invented_count": (f == "count_printed") & (v == "false_claim"),
        "invented_depth": (f == "depth") & (v == "false_claim"),
        "invented_form": (f == "form") & v.isin("overclaim", "mismatch") & open_ & given,
        "invented_thru": (f == "termination") & ((v == "overclaim") | ((v == "mismatch") & F.col("expected").eqNullSafe("unknown") & given)),
        "unsupported_physical_meaning": (f == "physical") & (v == "overclaim"),
    }
    out = field_rows.where("status = 'matched'").groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    return out.withColumn("total", sum((F.col(n) for n in tests), F.lit(0)))


def semantic_fill(flagged: DataFrame, keys: Sequence[str] = ("arm",)) -> DataFrame:
    """Candidates per arm, how many carry a semantic claim, and the rate (NULL without candidates)."""
    claims = sum((F.col(f"claim_flags.{n}").cast("int") for n in ("callout_text", "form_symbol", "size", "count_printed", "termination", "depth", "physical")), F.lit(0))
    out = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), F.sum(claims).alias("semantic_claims"), F.count_if("has_claim").alias("contentful"),
        F.count_if(~F.col("has_claim")).alias("evidence_only"))
    return out.withColumn("semantic_rate", ratio(F.col("contentful"), F.col("candidates")))


def echo(candidates: DataFrame, observations: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Candidates whose box repeats an observed box within 0.0006 on every side; first observation wins.

    ``candidates`` carries ``has_claim``; ``observations`` (keys, observation_id, ord, x0..y1).
    """
    keys = list(keys)
    cell = 4 * ECHO_TOL
    at = lambda v, d: F.floor((F.col(v) + d * ECHO_TOL) / cell)
    wide = candidates.withColumn("_cx", F.explode(F.array_distinct(F.array(at("x0", -1), at("x0", 1))))).withColumn(
        "_cy", F.explode(F.array_distinct(F.array(at("y0", -1), at("y0", 1))))).withColumn(
        "_dx", F.explode(F.array_distinct(F.array(at("x1", -1), at("x1", 1)))))
    obs = observations.select(*keys, "observation_id", "ord", *[F.col(b).alias(f"o_{b}") for b in BOX], at("x0", 0).alias("_cx"), at("y0", 0).alias("_cy"), at("x1", 0).alias("_dx"))
    near = F.lit(True)
    for b in BOX:
        near = near & (F.abs(F.col(b) - F.col(f"o_{b}")) <= ECHO_TOL)
    hits = wide.join(obs, [*keys, "_cx", "_cy", "_dx"]).where(near)
    return hits.groupBy(*keys, "candidate_id").agg(
        F.min_by("observation_id", "ord").alias("observation_id"),
        F.when(F.first("has_claim"), "contentful_observation_supported").otherwise("empty_echo").alias("class"))


def duplicates(candidates: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Duplicate classes of each candidate; the first member of a class is not a duplicate.

    ``candidates`` (keys, ord, candidate_id, x0..y1, signature, target_key, callout_text). Equality classes need
    only their smallest ``ord``; the near class looks for any earlier box that matches but is not equal, over
    distinct boxes, so copies of one box are compared once.
    """
    keys = list(keys)
    box6 = [F.round(b, 6).alias(f"q_{b}") for b in BOX]
    q = [f"q_{b}" for b in BOX]
    c = candidates.select("*", *box6)
    first = lambda cols, name, cond: c.where(cond).groupBy(*keys, *cols).agg(F.min("ord").alias(name))
    out = c.join(first(q, "_e", F.lit(True)), [*keys, *q], "left")
    out = out.join(first(["signature", "target_key"], "_s", F.lit(True)), [*keys, "signature", "target_key"], "left")
    out = out.join(first(["callout_text"], "_t", F.col("callout_text") != ""), [*keys, "callout_text"], "left")
    reps = c.groupBy(*keys, *q).agg(F.min("ord").alias("lo"), F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("x1").alias("x1"), F.first("y1").alias("y1"))
    r = [f"r_{b}" for b in BOX]
    other = reps.select(*keys, F.col("lo").alias("other_lo"), *[F.col(b).alias(n) for b, n in zip(BOX, r)])
    a, b = [F.col(n) for n in BOX], [F.col(n) for n in r]
    near = box_pairs(reps, other, keys, 0.1, BOX, r, CENTRE_TOL).where("lo <> other_lo").where((box_iou(a, b) >= IOU_MIN) | (centre_distance(a, b) <= CENTRE_TOL))
    near = near.groupBy(*keys, *q).agg(F.min("other_lo").alias("_n"))
    out = out.join(near, [*keys, *q], "left")
    flag = lambda n: F.coalesce(F.col(n) < F.col("ord"), F.lit(False))
    return out.select(*keys, "candidate_id", flag("_e").alias("exact"), flag("_n").alias("near"), flag("_s").alias("signature_target"), flag("_t").alias("callout_text_repeat"))


def partition_candidates(flags: DataFrame, keys: Sequence[str] = ("arm",)) -> DataFrame:
    """Disjoint classes by priority: matched, duplicate, echo, false_positive, unscorable_extra, other."""
    t = lambda n: F.coalesce(F.col(n), F.lit(False))
    kind = (
        F.when(t("matched"), "matched").when(t("exact") | t("near"), "duplicate").when(F.col("echo").isNotNull(), "echo")
        .when(F.col("extra_kind") == "false_positive", "false_positive")
        .when(F.col("extra_kind") == "unscorable_extra_candidate", "unscorable_extra").otherwise("other"))
    return flags.groupBy(*keys, kind.alias("class")).agg(F.count(F.lit(1)).alias("candidates"))


def gate(cells: DataFrame, checks: Sequence[str], keys: Sequence[str] = ("arm",)) -> DataFrame:
    """Fail-closed gate: an unmeasured check fails. Lists the checks that are open anywhere in the group."""
    closed = [F.bool_and(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in checks]
    out = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), *closed)
    failing = F.array_compact(F.array(*[F.when(~F.col(c), c) for c in checks]))
    return out.withColumn("open_checks", failing).withColumn("passed", F.size("open_checks") == 0)


def check_references(items: DataFrame, sent: DataFrame, allowed: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Problem rows: unknown_image, unknown_observation, duplicate_id, page_not_covered.

    ``items`` (keys, candidate_id, image_id, observation_id), ``sent`` (keys, image_id), ``allowed`` (keys,
    observation_id).
    """
    keys = list(keys)
    code = lambda df, name, ref: df.select(*keys, F.lit(name).alias("code"), F.col(ref).cast("string").alias("ref")).distinct()
    unknown_image = items.where("image_id is not null").join(sent, [*keys, "image_id"], "left_anti")
    unknown_obs = items.where("observation_id is not null").join(allowed, [*keys, "observation_id"], "left_anti")
    twice = items.groupBy(*keys, "candidate_id").count().where("count > 1")
    bare = sent.join(items.select(*keys, "image_id").distinct(), [*keys, "image_id"], "left_anti")
    return (code(unknown_image, "unknown_image", "image_id").unionByName(code(unknown_obs, "unknown_observation", "observation_id"))
            .unionByName(code(twice, "duplicate_id", "candidate_id")).unionByName(code(bare, "page_not_covered", "image_id")))


def label_candidates(candidates: DataFrame, truth: DataFrame, keys: Sequence[str] = ("page_id",), size: float = 64.0) -> DataFrame:
    """``hit``: the candidate's centre lies in a truth box and at least half its area overlaps it."""
    keys = list(keys)
    t = [f"t_{b}" for b in BOX]
    tr = truth.select(*keys, *[F.col(b).alias(n) for b, n in zip(BOX, t)]).distinct()
    a, b = [F.col(n) for n in BOX], [F.col(n) for n in t]
    cx, cy = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    hit = box_pairs(candidates, tr, keys, size, BOX, t).where(
        cx.between(b[0], b[2]) & cy.between(b[1], b[3]) & (box_intersection(a, b) >= 0.5 * box_area(a)))
    hit = hit.select(*keys, "candidate_id").distinct().withColumn("_h", F.lit(True))
    return candidates.join(hit, [*keys, "candidate_id"], "left").withColumn("hit", F.col("_h").isNotNull()).drop("_h")


def validate_gold(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """Problem rows of gold pages: missing scope, no claims, unconfirmed raster pages, duplicate ids, missing
    targets, empty evidence, raster claims without visual evidence.

    ``pages`` (page_id, page_type, scope, exhaustiveness_scope, vision_checked); ``claims`` (page_id, claim_id,
    target_observation, target_box ARRAY<DOUBLE>, evidence, source_evidence).
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    counts = claims.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    p = pages.join(counts, "page_id", "left")
    raster = F.col("page_type") == "raster"
    page_codes = F.array_compact(F.array(
        F.when(blank("scope"), "missing_scope"), F.when(blank("exhaustiveness_scope"), "missing_exhaustiveness"),
        F.when(raster & ~F.coalesce("vision_checked", F.lit(False)), "raster_not_confirmed"), F.when(F.col("n").isNull(), "no_claims")))
    none = F.lit(None).cast(claims.schema["claim_id"].dataType)
    rows = p.select("page_id", none.alias("claim_id"), F.explode(page_codes).alias("code"))
    twice = claims.groupBy("page_id", "claim_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id", "claim_id", F.lit("duplicate_id").alias("code"))
    c = claims.join(pages.select("page_id", "page_type"), "page_id")
    claim_codes = F.array_compact(F.array(
        F.when(F.col("target_observation").isNull() & F.col("target_box").isNull(), "no_target"), F.when(blank("evidence"), "empty_evidence"),
        F.when(blank("source_evidence"), "empty_source_evidence"), F.when(raster & ~F.lower(F.coalesce("source_evidence", F.lit(""))).contains("vision"), "raster_without_vision")))
    return rows.unionByName(twice).unionByName(c.select("page_id", "claim_id", F.explode(claim_codes).alias("code")))
