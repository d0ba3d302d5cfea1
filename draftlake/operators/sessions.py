"""Reviewed sessions: freshness, compilation into decisions, citation validity, coverage, readiness, bundles.

Relations (all carry session_id):
  callouts        callout_id, ord, region, ignored, unbindable, disposition, duplicate_of, disposition_reason,
                  pin STRUCT<kind, callout_id, name, value, revision, region, own_revision, own_region>
  transcriptions  callout_id, revision, source_region, raw_text              (latest row per callout)
  parses          callout_id, transcription_revision, parser_version, status, form, size, count, termination, depth, unit
  targets         callout_id, transcription_revision, parser_version, geometry_key, geometry_version, target_kind, target_ids, profile_id
  sessions        geometry_key, geometry_version, geometry_stale, sheet_unit, axis_x, axis_y
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.constants import MM_PER_INCH
from draftlake.functions.text import to_mm
from draftlake.operators.scan import top_k
from draftlake.session import written

KEY = ["session_id", "callout_id"]
MM_LIMIT = 1e6
AXIS_TOL_PX = 0.5
PARSE_FIELDS = ["status", "form", "size", "count", "termination", "depth", "unit"]
# Coverage buckets and compile reasons of the review contract.
COVERAGE_BUCKETS = ["not_model_input", "redundant", "build_applied", "build_relevant_unsupported", "unclassified",
                    "legacy_unclassified", "stale", "compile_blocked", "invalid_duplicate"]
COVERAGE_BLOCKING = ["unclassified", "legacy_unclassified", "stale", "compile_blocked", "invalid_duplicate", "build_relevant_unsupported"]
COMPILE_BLOCKED = ["missing_unit", "parse_ambiguous", "parse_unsupported", "unsupported_semantic", "unsupported_cad_feature",
                   "conflict", "view_not_confirmed", "stale_parse", "stale_target", "missing_parse"]


def _first(*pairs: tuple[Column, str]) -> Column:
    """First reason whose condition holds; NULL conditions do not."""
    out = F.lit(None).cast("string")
    for cond, reason in reversed(pairs):
        out = F.when(F.coalesce(cond, F.lit(False)), reason).otherwise(out)
    return out


def freshness(callouts: DataFrame, transcriptions: DataFrame, parses: DataFrame, targets: DataFrame, sessions: DataFrame, parser_version: str) -> DataFrame:
    """Adds (transcription, parse, target) states and reasons: current, stale or missing."""
    digest = F.sha2(F.to_json(F.struct(*PARSE_FIELDS), {"ignoreNullFields": "false"}), 256)
    t = transcriptions.select(*KEY, F.col("revision").alias("t_rev"), "source_region", "raw_text")
    p = parses.join(t.select(*KEY, "t_rev"), KEY, "left").join(
        targets.select(*KEY, F.col("transcription_revision").alias("_gr"), F.col("parser_version").alias("_gp")), KEY, "left").withColumn("_d", digest)
    exact = (F.col("transcription_revision") == F.col("t_rev")) & (F.col("parser_version") == parser_version)
    of_target = (F.col("transcription_revision") == F.col("_gr")) & (F.col("parser_version") == F.col("_gp"))
    # Smallest and largest digest say whether the rows of one pin differ; no list is kept.
    per = p.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_parse"), F.count_if(exact).alias("n_exact"),
        (F.min(F.when(exact, F.col("_d"))) != F.max(F.when(exact, F.col("_d")))).alias("exact_conflict"),
        F.count_if(~F.coalesce(F.col("transcription_revision") == F.col("t_rev"), F.lit(False))).alias("n_other_rev"),
        F.count_if(of_target).alias("n_target_parse"),
        (F.min(F.when(of_target, F.col("_d"))) != F.max(F.when(of_target, F.col("_d")))).alias("target_conflict"))
    g = targets.select(*KEY, F.col("transcription_revision").alias("g_rev"), F.col("parser_version").alias("g_parser"),
                       F.col("geometry_key").alias("g_key"), F.col("geometry_version").alias("g_version"), F.lit(True).alias("has_target"))
    s = sessions.select("session_id", "geometry_key", "geometry_version", "geometry_stale")
    j = callouts.join(t, KEY, "left").join(per, KEY, "left").join(g, KEY, "left").join(s, "session_id", "left")
    has_t, any_p = F.col("t_rev").isNotNull(), F.coalesce("n_parse", F.lit(0)) > 0
    moved = has_t & ~F.col("source_region").eqNullSafe(F.col("region"))
    stale = F.coalesce("geometry_stale", F.lit(False))
    n_exact = F.coalesce("n_exact", F.lit(0))
    t_reason = _first((~has_t, "needs_transcription"), (moved, "region_changed"))
    p_reason = _first(
        (stale & any_p, "source_unavailable"), (~has_t & any_p, "transcription_missing"), (~has_t, "needs_parse"),
        (moved & any_p, "region_changed"), (moved, "needs_parse"), ((n_exact > 0) & F.col("exact_conflict"), "parse_conflict"),
        ((n_exact == 0) & ~any_p, "needs_parse"), ((n_exact == 0) & (F.col("n_other_rev") > 0), "transcription_changed"), (n_exact == 0, "parser_version_changed"))
    has_g = F.col("has_target").isNotNull()
    g_reason = _first(
        (~has_g, "needs_target"), (stale, "source_unavailable"), (~has_t, "transcription_missing"), (moved, "region_changed"),
        (~F.col("g_rev").eqNullSafe(F.col("t_rev")), "transcription_changed"), (~F.col("g_parser").eqNullSafe(F.lit(parser_version)), "parser_version_changed"),
        (~F.col("g_key").eqNullSafe(F.col("geometry_key")) | ~F.col("g_version").eqNullSafe(F.col("geometry_version")), "geometry_changed"),
        (F.coalesce("n_target_parse", F.lit(0)) == 0, "parse_missing"), (F.col("target_conflict"), "parse_conflict"))
    state = lambda reason, absent: F.when(reason.isNull(), "current").when(absent, "missing").otherwise("stale")
    return j.select(
        *callouts.columns, F.col("t_rev").alias("revision"), "raw_text", t_reason.alias("t_reason"), state(t_reason, ~has_t).alias("t_state"),
        p_reason.alias("p_reason"), state(p_reason, p_reason == "needs_parse").alias("p_state"),
        g_reason.alias("g_reason"), state(g_reason, ~has_g).alias("g_state"))


def _same_hole(a: str, b: str) -> Column:
    c = lambda p, n: F.col(f"{p}_{n}")
    return ((c(a, "kind") == c(b, "kind")) & (F.abs(c(a, "diameter") - c(b, "diameter")) < 1e-6)
            & (c(a, "depth").isNull() | c(b, "depth").isNull() | (F.abs(c(a, "depth") - c(b, "depth")) < 1e-6)))


def compile_callouts(fresh: DataFrame, parses: DataFrame, targets: DataFrame, sessions: DataFrame, circles: DataFrame, edges: DataFrame,
                     manual_holes: DataFrame, manual_bindings: DataFrame, parser_version: str) -> dict[str, DataFrame]:
    """rows (status and reason per callout), holes, bindings and conflicts.

    ``circles`` (session_id, circle_id); ``edges`` (session_id, profile_id, edge_id, start, end); ``manual_holes``
    (session_id, circle_id, kind, diameter, depth); ``manual_bindings`` (session_id, first_id, second_id, value, unit).
    """
    mine = parses.where(F.col("parser_version") == parser_version)
    # Several equal parses of one revision are one parse; differing ones made the state stale already.
    mine = mine.groupBy(*KEY, F.col("transcription_revision").alias("revision")).agg(F.first(F.struct(*PARSE_FIELDS)).alias("parse"))
    t = targets.select(*KEY, "target_kind", "target_ids", F.col("profile_id").alias("target_profile"))
    j = fresh.join(mine, [*KEY, "revision"], "left").join(t, KEY, "left").join(sessions.select("session_id", "sheet_unit", "axis_x", "axis_y"), "session_id", "left")
    size_mm, unit_source = to_mm(F.col("parse.size"), F.col("parse.unit"), F.col("sheet_unit"))
    depth_mm, _ = to_mm(F.col("parse.depth"), F.col("parse.unit"), F.col("sheet_unit"))
    j = j.withColumns({"size_mm": size_mm, "unit_source": F.when(size_mm.isNotNull(), unit_source), "depth_mm": depth_mm})
    form, term, parsed = F.col("parse.form"), F.col("parse.termination"), F.col("parse.status")
    steps = [
        (F.col("disposition").isNotNull(), "excluded", F.col("disposition")),
        (F.col("ignored"), "excluded", F.lit("ignored")), (F.col("unbindable"), "excluded", F.lit("unbindable_declared")),
        (F.col("t_state") != "current", "missing_transcription", F.col("t_reason")),
        (F.col("p_state") == "stale", "stale_parse", F.col("p_reason")), (F.col("p_state") == "missing", "missing_parse", F.col("p_reason")),
        (parsed == "ambiguous", "parse_ambiguous", F.lit("unsupported_syntax")), (~parsed.eqNullSafe("parsed"), "parse_unsupported", F.lit("unsupported_syntax")),
        (F.col("size_mm").isNull(), "missing_unit", F.lit("unit_not_resolved")),
        (F.col("g_state") == "missing", "missing_target", F.lit("needs_target")), (F.col("g_state") == "stale", "stale_target", F.col("g_reason")),
        ((form == "diameter") & (F.col("size_mm") > MM_LIMIT), "unsupported_semantic", F.lit("diameter_out_of_range")),
        ((form == "diameter") & term.isNull(), "unsupported_cad_feature", F.lit("termination_missing")),
        ((form == "diameter") & (term == "blind") & F.col("parse.depth").isNull(), "unsupported_semantic", F.lit("depth_missing")),
        ((form == "diameter") & (term == "blind") & (F.col("depth_mm") > MM_LIMIT), "unsupported_semantic", F.lit("depth_out_of_range")),
        (form == "radius", "unsupported_cad_feature", F.lit("radius_not_buildable")),
        ((form == "linear") & ((F.col("target_kind") != "vertex_pair") | (F.size("target_ids") != 2)), "unsupported_semantic", F.lit("target_kind_not_bindable")),
        (~F.coalesce(form.isin("diameter", "linear"), F.lit(False)), "unsupported_semantic", F.lit("form_not_compilable")),
    ]
    status = reason = F.lit(None).cast("string")
    for cond, name, why in reversed(steps):
        ok = F.coalesce(cond, F.lit(False))
        status, reason = F.when(ok, name).otherwise(status), F.when(ok, why).otherwise(reason)
    # Coverage and citations read it several times, each a few of its columns.
    j = written(j.withColumn("status", status).withColumn("reason", reason))
    open_ = j.where("status is null")

    # Holes.
    wanted = open_.where("parse.form = 'diameter'").select(
        *KEY, "ord", F.posexplode("target_ids").alias("pos", "circle_id"), F.when(F.col("parse.termination") == "thru", "through").otherwise("pocket").alias("w_kind"),
        F.col("size_mm").alias("w_diameter"), F.when(F.col("parse.termination") == "blind", F.col("depth_mm")).alias("w_depth"))
    known = circles.select("session_id", "circle_id").distinct().withColumn("_known", F.lit(True))
    wanted = wanted.join(known, ["session_id", "circle_id"], "left")
    lost = wanted.where("_known is null").select(*KEY).distinct()
    wanted = wanted.join(lost, KEY, "left_anti")
    manual = manual_holes.select("session_id", "circle_id", F.lit(True).alias("_manual"), *[F.col(c).alias(f"m_{c}") for c in ("kind", "diameter", "depth")])
    wanted = wanted.join(manual, ["session_id", "circle_id"], "left")
    own = wanted.where("_manual is null")
    first = own.groupBy("session_id", "circle_id").agg(F.min_by(F.struct("callout_id", "pos", "w_kind", "w_diameter", "w_depth"), F.struct("ord", "pos")).alias("f")).select(
        "session_id", "circle_id", F.col("f.callout_id").alias("f_callout"), F.col("f.pos").alias("f_pos"),
        F.col("f.w_kind").alias("f_kind"), F.col("f.w_diameter").alias("f_diameter"), F.col("f.w_depth").alias("f_depth"))
    wanted = wanted.join(first, ["session_id", "circle_id"], "left")
    is_first = F.col("_manual").isNull() & (F.col("f_callout") == F.col("callout_id")) & (F.col("f_pos") == F.col("pos"))
    clash = F.when(F.col("_manual") & ~_same_hole("m", "w"), "manual_conflict").when(F.col("_manual").isNull() & ~is_first & ~_same_hole("f", "w"), "callout_conflict")
    judged = written(wanted.withColumn("clash", clash).withColumn("made", F.coalesce(is_first, F.lit(False))))
    per = judged.groupBy(*KEY).agg(
        F.min_by("clash", F.when(F.col("clash").isNotNull(), F.col("pos"))).alias("clash"), F.count_if("made").alias("made"),
        F.count_if(F.col("_manual") & F.col("clash").isNull()).alias("agree"))
    hole_rows = per.select(*KEY, F.when(F.col("clash").isNotNull(), "conflict").otherwise("compiled").alias("h_status"),
                           F.coalesce("clash", F.when(F.col("made") > 0, None).when(F.col("agree") > 0, "manual_decision_matches").otherwise("no_target_geometry")).alias("h_reason"))
    hole_rows = hole_rows.unionByName(lost.select(*KEY, F.lit("conflict").alias("h_status"), F.lit("unknown_geometry").alias("h_reason")))
    holes = judged.where("made").select("session_id", "circle_id", "callout_id", F.col("w_kind").alias("kind"), F.col("w_diameter").alias("diameter"), F.col("w_depth").alias("depth"))

    # Bindings.
    lin = open_.where("parse.form = 'linear'").select(
        *KEY, "size_mm", "axis_x", "axis_y", F.col("target_profile").alias("profile_id"), F.col("target_ids")[0].alias("first_id"), F.col("target_ids")[1].alias("second_id"))
    profiles = edges.select("session_id", "profile_id").distinct().withColumn("_profile", F.lit(True))
    ends = edges.select("session_id", "profile_id", F.inline(F.array(
        F.struct(F.concat("edge_id", F.lit(":start")).alias("end_id"), F.col("start").alias("at")), F.struct(F.concat("edge_id", F.lit(":end")).alias("end_id"), F.col("end").alias("at"))))).distinct()
    side = lambda which: ends.select("session_id", "profile_id", F.col("end_id").alias(f"{which}_id"), F.col("at").alias(f"{which}_at"))
    lin = lin.join(profiles, ["session_id", "profile_id"], "left").join(side("first"), ["session_id", "profile_id", "first_id"], "left").join(side("second"), ["session_id", "profile_id", "second_id"], "left")
    dx, dy = F.col("second_at")[0] - F.col("first_at")[0], F.col("second_at")[1] - F.col("first_at")[1]
    ax, ay = dx * F.col("axis_x")[0] + dy * F.col("axis_x")[1], dx * F.col("axis_y")[0] + dy * F.col("axis_y")[1]
    on_x = F.abs(ax) >= F.abs(ay)
    lin = lin.withColumn("axis", F.when(F.least(F.abs(ax), F.abs(ay)) <= AXIS_TOL_PX, F.when(on_x, "x").otherwise("y"))).withColumn(
        "direction", F.when(F.when(on_x, ax).otherwise(ay) >= 0, 1).otherwise(-1))
    mb = manual_bindings.select("session_id", "first_id", "second_id", (F.col("value") * F.when(F.col("unit") == "in", MM_PER_INCH).otherwise(1.0)).alias("_mv"))
    against = lin.join(mb, ["session_id", "first_id", "second_id"]).where(F.abs(F.col("_mv") - F.col("size_mm")) > 1e-6).select(*KEY).distinct().withColumn("_clash", F.lit(True))
    lin = lin.join(against, KEY, "left")
    b_reason = _first((F.col("_profile").isNull(), "profile_missing"), (F.col("first_at").isNull() | F.col("second_at").isNull(), "unknown_geometry"),
                      (F.col("axis_x").isNull(), "view_not_confirmed"), (F.col("axis").isNull(), "axis_not_resolved"), (F.col("_clash"), "manual_conflict"))
    b_status = F.when(b_reason.isNull(), "compiled").when(b_reason.isin("unknown_geometry", "manual_conflict"), "conflict").when(b_reason == "view_not_confirmed", "view_not_confirmed").otherwise("unsupported_semantic")
    lin = lin.withColumn("h_reason", b_reason).withColumn("h_status", b_status)
    bindings = lin.where("h_status = 'compiled'").select(*KEY, F.concat(F.lit("callout:"), F.col("callout_id").cast("string")).alias("binding_id"), "axis", "direction", "first_id", "second_id", F.col("size_mm").alias("value"))
    decided = hole_rows.unionByName(lin.select(*KEY, "h_status", "h_reason"))
    rows = j.join(decided, KEY, "left").withColumn("reason", F.when(F.col("status").isNull(), F.col("h_reason")).otherwise(F.col("reason"))).withColumn("status", F.coalesce("status", "h_status")).drop("h_status", "h_reason")
    conflicts = judged.where("clash is not null").select(*KEY, F.col("clash").alias("reason"), "circle_id")
    return {"rows": rows, "holes": holes, "bindings": bindings, "conflicts": conflicts}


def apply_compiled(manual: DataFrame, compiled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The user's own decisions, then the compiled ones that meet none of them."""
    fresh = compiled.join(manual.select(*keys), list(keys), "left_anti")
    return manual.withColumn("origin", F.lit("manual")).unionByName(fresh.withColumn("origin", F.lit("compiled")), allowMissingColumns=True)


def compile_summary(compiled: dict[str, DataFrame]) -> DataFrame:
    """Counts per status and reason."""
    return compiled["rows"].groupBy("status", "reason").agg(F.count(F.lit(1)).alias("callouts"))


def compile_provenance(compiled: dict[str, DataFrame], features: DataFrame) -> DataFrame:
    """decision <- target <- parse <- text <- callout, with the features built from each decision."""
    made = compiled["holes"].select("session_id", "callout_id", F.col("circle_id").alias("decision_key")).unionByName(
        compiled["bindings"].select("session_id", "callout_id", F.col("binding_id").alias("decision_key")))
    rows = compiled["rows"].select(*KEY, "raw_text", "revision", "target_kind", "status", "reason")
    return rows.join(made, KEY, "left").join(features.select("session_id", "decision_key", "feature_id"), ["session_id", "decision_key"], "left")


def citation_valid(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """``own_current`` and ``citation_ok`` of redundant callouts.

    ``rows``: compiled rows (with freshness and ``pin``); ``decisions`` (session_id, name, value). A chain of
    citations ends well when it reaches a covered callout or a present decision; a cycle never does. Every row
    has one citation, so chains shorten by pointer doubling: a round that settles nothing new is the last.
    """
    region3 = lambda r: F.transform(r, lambda v: F.round(v, 3))
    stale = (F.col("t_state") == "stale") | (F.col("p_state") == "stale") | (F.col("g_state") == "stale")
    base = rows.select(*KEY, "disposition", "duplicate_of", "pin", "status", "ignored", "unbindable", "revision", region3(F.col("region")).alias("region3"), stale.alias("stale"))
    own = F.col("pin.own_revision").eqNullSafe(F.col("revision")) & F.col("pin.own_region").eqNullSafe(F.col("region3"))
    red = base.where("disposition = 'redundant'").withColumn("own_current", F.coalesce(own, F.lit(False)))
    name = F.regexp_extract("duplicate_of", r"^decision:(.*)$", 1)
    red = red.withColumn("name", F.when(F.col("duplicate_of").startswith("decision:"), name))
    d = decisions.select("session_id", "name", F.col("value").alias("d_value"))
    ref = base.select("session_id", F.col("callout_id").cast("string").alias("duplicate_of"), F.col("revision").alias("r_rev"), F.col("region3").alias("r_region"), F.col("stale").alias("r_stale"),
                      F.col("disposition").alias("r_disposition"), (F.col("ignored") | F.col("unbindable")).alias("r_legacy"), F.col("status").alias("r_status"), F.lit(True).alias("r_known"))
    red = red.join(d, ["session_id", "name"], "left").join(ref, ["session_id", "duplicate_of"], "left")
    by_decision = (F.col("pin.kind") == "decision") & (F.col("pin.name") == F.col("name")) & F.col("d_value").isNotNull() & (F.col("pin.value") == F.col("d_value"))
    pin_ok = (F.col("pin.kind") == "callout") & (F.col("pin.callout_id") == F.col("duplicate_of")) & F.col("pin.revision").eqNullSafe(F.col("r_rev")) & F.col("pin.region").eqNullSafe(F.col("r_region"))
    covered = F.coalesce(F.col("r_known") & ~F.col("r_stale"), F.lit(False)) & (
        F.col("r_disposition").eqNullSafe("not_model_input") | (F.col("r_disposition").isNull() & ~F.col("r_legacy") & F.col("r_status").eqNullSafe("compiled")))
    onward = F.coalesce(F.col("r_known") & ~F.col("r_stale") & (F.col("r_disposition") == "redundant"), F.lit(False))
    verdict = (
        F.when(F.col("pin").isNull(), False).when(F.col("name").isNotNull(), F.coalesce(by_decision, F.lit(False)))
        .when(~F.coalesce(pin_ok, F.lit(False)), False).when(covered, True).when(onward, None).otherwise(False))
    # ok NULL = depends on the cited redundant row, which must also be current itself.
    links = written(red.select(*KEY, "own_current", verdict.alias("ok"), F.col("duplicate_of").alias("next")))
    while True:
        step = links.select("session_id", F.col("callout_id").cast("string").alias("next"), F.col("ok").alias("n_ok"), F.col("own_current").alias("n_own"), F.col("next").alias("n_next"))
        j = links.join(step, ["session_id", "next"], "left")
        ok = F.when(F.col("ok").isNotNull(), F.col("ok")).when(~F.coalesce("n_own", F.lit(False)), False).otherwise(F.col("n_ok"))
        # A pending row inherits the pending row's pointer; own_current of everything skipped was true.
        new = written(j.select(*KEY, "own_current", ok.alias("ok"), F.coalesce("n_next", "next").alias("next"), F.col("ok").isNull().alias("_was")))
        settled = new.where("_was and ok is not null")
        links = new.drop("_was")
        if settled.isEmpty():
            return links.select(*KEY, "own_current", F.coalesce("ok", F.lit(False)).alias("citation_ok"))


def coverage_buckets(rows: DataFrame, citations: DataFrame) -> DataFrame:
    """One bucket per callout, by fixed priority."""
    stale = (F.col("t_state") == "stale") | (F.col("p_state") == "stale") | (F.col("g_state") == "stale")
    bucket = (
        F.when(F.col("disposition") == "build_relevant_unsupported", "build_relevant_unsupported").when(F.col("disposition") == "not_model_input", "not_model_input")
        .when(F.col("disposition") == "redundant", F.when(~F.col("own_current"), "stale").when(F.col("citation_ok"), "redundant").otherwise("invalid_duplicate"))
        .when(F.col("ignored") | F.col("unbindable"), "legacy_unclassified").when(stale, "stale")
        .when(F.col("status") == "compiled", "build_applied").when(F.col("status").isin(*COMPILE_BLOCKED), "compile_blocked").otherwise("unclassified"))
    return rows.join(citations, KEY, "left").withColumn("bucket", bucket)


def coverage_counts(buckets: DataFrame) -> DataFrame:
    out = buckets.groupBy("session_id").agg(F.count(F.lit(1)).alias("callouts"), *[F.count_if(F.col("bucket") == b).alias(b) for b in COVERAGE_BUCKETS])
    blocking = sum((F.col(b) for b in COVERAGE_BLOCKING), F.lit(0))
    return out.withColumn("coverage_complete", blocking == 0)


# Issue category and the action that settles it, per compile status.
ISSUE = {
    "missing_transcription": ("missing_transcription", "transcribe"), "missing_parse": ("parse_error", "edit_transcription"),
    "stale_parse": ("parse_error", "edit_transcription"), "parse_ambiguous": ("parse_ambiguous", "edit_transcription"),
    "parse_unsupported": ("parse_error", "edit_transcription"), "missing_unit": ("missing_unit", "edit_transcription"),
    "missing_target": ("missing_target", "confirm_target"), "stale_target": ("stale_target", "confirm_target"),
    "unsupported_semantic": ("unsupported_semantic", "review_callout"), "unsupported_cad_feature": ("unsupported_cad_feature", "review_callout"),
    "conflict": ("callout_conflict", "review_conflict"), "view_not_confirmed": ("missing_view", "confirm_view"),
}


def readiness(rows: DataFrame, buckets: DataFrame, proposals: DataFrame, sheet_issues: DataFrame) -> DataFrame:
    """Issue rows per session: open compile states, sheet questions and blocking coverage.

    ``proposals`` (session_id, callout_id, n): several equal proposals make a missing target ambiguous.
    """
    cat = F.create_map(*[F.lit(v) for k, (c, _) in ISSUE.items() for v in (k, c)])
    act = F.create_map(*[F.lit(v) for k, (_, a) in ISSUE.items() for v in (k, a)])
    r = rows.where("status not in ('compiled', 'excluded')").join(proposals, KEY, "left")
    category = F.when((F.col("status") == "missing_target") & (F.col("n") > 1), "ambiguous_target").otherwise(cat[F.col("status")])
    own = r.select(*KEY, category.alias("category"), act[F.col("status")].alias("action"), "reason")
    scope = (
        F.when(F.col("bucket") == "legacy_unclassified", "legacy_unclassified").when(F.col("bucket") == "build_relevant_unsupported", "unsupported_build_relevant")
        .when((F.col("bucket") == "stale") & F.col("disposition").isNotNull(), "stale_scope_claim").when(F.col("bucket") == "invalid_duplicate", "stale_duplicate_reference"))
    cov = buckets.withColumn("category", scope).where("category is not null").select(*KEY, "category", F.lit("review_callout").alias("action"), F.col("bucket").alias("reason"))
    return own.unionByName(cov).unionByName(sheet_issues.select(*KEY, "category", "action", "reason"))


def export_bundle(fresh: DataFrame, parses: DataFrame, targets: DataFrame, proposals: DataFrame, parser_version: str, limit: int = 4) -> DataFrame:
    """One nested row per callout with freshness, parse, proposals (at most four) and the confirmed target."""
    g = targets.select(*KEY, F.col("parser_version").alias("_gp"), F.struct("target_kind", "target_ids", "geometry_key").alias("confirmed_target"))
    want = fresh.join(g, KEY, "left").withColumn("parser_version", F.coalesce("_gp", F.lit(parser_version)))
    p = parses.groupBy(*KEY, F.col("transcription_revision").alias("revision"), "parser_version").agg(F.first(F.struct(*PARSE_FIELDS)).alias("semantic_parse"))
    top = top_k(proposals, KEY, [F.col("tier"), F.col("distance"), F.col("target_ids")], limit, "place")
    top = top.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "tier", "target_ids"))).alias("target_proposals"))
    state = lambda p_: F.struct(F.col(f"{p_}_state").alias("state"), F.col(f"{p_}_reason").alias("reason"))
    return want.join(p, [*KEY, "revision", "parser_version"], "left").join(top, KEY, "left").select(
        *KEY, "region", "ignored", "unbindable", "disposition", "duplicate_of", F.struct(state("t").alias("transcription"), state("p").alias("parse"), state("g").alias("target")).alias("freshness"),
        "raw_text", "revision", "semantic_parse", "target_proposals", "confirmed_target")


# Actions, dispositions and target kinds of a bundle.
IMPORT_ACTIONS = ["transcribe", "ignore", "restore", "confirm_target", "select_target", "set_disposition"]
DISPOSITIONS = ["not_model_input", "redundant", "build_relevant_unsupported"]
TARGET_KINDS = ["circle", "circle_group", "arc", "profile", "vertex_pair"]


def validate_bundle(bundles: DataFrame, actions: DataFrame, callouts: DataFrame, sessions: DataFrame, geometry: DataFrame, decisions: DataFrame,
                    fresh: DataFrame, parser_version: str, bundle_version: str, schema_version: int, max_actions: int, max_text: int, max_targets: int) -> tuple[DataFrame, DataFrame]:
    """(valid actions, errors): one bad action refuses its whole bundle.

    ``bundles`` (bundle_id, session_id, bundle_version, schema_version, source_digest, base_revision, parser_version,
    geometry_version, geometry_key); ``actions`` (bundle_id, session_id, index, action, callout_id, raw_text, region,
    disposition, duplicate_of, disposition_reason, target_kind, target_ids); ``sessions`` also revision and
    source_digest; ``geometry`` (session_id, kind circle/arc/profile/end, geometry_id). The three maxima are part of
    the bundle's contract and have no default: whoever accepts bundles states them, and what exceeds them is refused.
    """
    b = bundles.alias("b").join(sessions.alias("s"), "session_id", "left")
    n = actions.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_actions"))
    b = b.join(n, "bundle_id", "left")
    bc, sc = (lambda c: F.col(f"b.{c}")), (lambda c: F.col(f"s.{c}"))
    head = F.array_compact(F.array(
        F.when(~bc("bundle_version").eqNullSafe(F.lit(bundle_version)), "unknown_bundle_version"),
        F.when(~bc("schema_version").eqNullSafe(F.lit(schema_version)), "schema_version_mismatch"),
        F.when(sc("geometry_key").isNull(), "session_mismatch"),
        F.when(~F.coalesce(bc("source_digest"), F.lit("")).eqNullSafe(F.coalesce(sc("source_digest"), F.lit(""))), "source_mismatch"),
        F.when(bc("base_revision").isNull(), "base_revision_invalid").when(bc("base_revision") != F.coalesce(sc("revision"), F.lit(0)), "stale_base_revision"),
        F.when(~bc("parser_version").eqNullSafe(F.lit(parser_version)), "parser_version_mismatch"),
        F.when(~bc("geometry_version").eqNullSafe(sc("geometry_version")), "geometry_version_mismatch").when(~bc("geometry_key").eqNullSafe(sc("geometry_key")), "geometry_mismatch"),
        F.when(F.col("n_actions").isNull(), "no_actions").when(F.col("n_actions") > max_actions, "too_many_actions")))
    bundle_errors = b.select("bundle_id", F.explode(head).alias("code")).select("bundle_id", F.lit(None).cast("int").alias("index"), "code")
    known = callouts.select("session_id", "callout_id").withColumn("_known", F.lit(True))
    dup = callouts.select("session_id", F.col("callout_id").cast("string").alias("duplicate_of")).withColumn("_dup", F.lit(True))
    dec = decisions.select("session_id", F.concat(F.lit("decision:"), F.col("name")).alias("duplicate_of")).withColumn("_dec", F.lit(True))
    st = fresh.select("session_id", "callout_id", F.col("revision").alias("_rev"), F.col("p_state").alias("_ps"))
    a = actions.join(known, KEY, "left").join(dup, ["session_id", "duplicate_of"], "left").join(dec, ["session_id", "duplicate_of"], "left").join(st, KEY, "left")
    # Geometry references: unknown ids counted per action.
    kind = F.when(F.col("target_kind") == "circle_group", "circle").when(F.col("target_kind") == "vertex_pair", "end").otherwise(F.col("target_kind"))
    refs = actions.where("action in ('confirm_target', 'select_target')").select("bundle_id", "session_id", "index", kind.alias("kind"), F.explode("target_ids").alias("geometry_id"))
    unknown = refs.join(geometry, ["session_id", "kind", "geometry_id"], "left_anti").select("bundle_id", "index").distinct().withColumn("_lost", F.lit(True))
    a = a.join(unknown, ["bundle_id", "index"], "left")
    text = F.trim(F.coalesce("raw_text", F.lit("")))
    ordered = lambda r: (F.size(r) == 4) & (r[0] >= 0) & (r[0] < r[2]) & (r[2] <= 1) & (r[1] >= 0) & (r[1] < r[3]) & (r[3] <= 1)
    ids, tk = F.col("target_ids"), F.col("target_kind")
    on = lambda *names: F.col("action").isin(*names)
    target, disp, red = on("confirm_target", "select_target"), on("set_disposition"), on("set_disposition") & (F.col("disposition") == "redundant")
    code = _first(
        (~F.coalesce(on(*IMPORT_ACTIONS), F.lit(False)), "unknown_action"), (F.col("_known").isNull(), "unknown_callout"),
        (on("transcribe") & (text == ""), "empty_text"), (on("transcribe") & (F.length("raw_text") > max_text), "text_too_long"),
        (on("transcribe") & F.col("region").isNotNull() & ~F.coalesce(ordered(F.col("region")), F.lit(False)), "invalid_region"),
        (disp & ~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)), "unknown_disposition"),
        (red & (F.trim(F.coalesce("duplicate_of", F.lit(""))) == ""), "missing_duplicate_reference"),
        (red & F.col("duplicate_of").startswith("decision:") & F.col("_dec").isNull(), "unknown_decision_reference"),
        (red & (F.col("duplicate_of") == F.col("callout_id").cast("string")), "self_duplicate_reference"),
        (red & ~F.col("duplicate_of").startswith("decision:") & F.col("_dup").isNull(), "unknown_duplicate_reference"),
        (disp & (F.col("disposition") == "build_relevant_unsupported") & (F.trim(F.coalesce("disposition_reason", F.lit(""))) == ""), "missing_disposition_reason"),
        (target & ~F.coalesce(tk.isin(*TARGET_KINDS), F.lit(False)), "unknown_target_kind"),
        (target & (ids.isNull() | (F.size(ids) == 0) | (F.size(ids) > max_targets)), "invalid_target_ids"),
        (target & (F.size(F.array_distinct(ids)) != F.size(ids)), "duplicate_target_ids"),
        (target & (((tk == "circle") & (F.size(ids) != 1)) | ((tk == "circle_group") & (F.size(ids) < 2)) | ((tk == "vertex_pair") & (F.size(ids) != 2))), "cardinality"),
        (target & F.col("_lost"), "unknown_geometry"), (target & F.col("_rev").isNull(), "no_transcription"), (target & (F.col("_ps") != "current"), "no_current_parse"))
    errors = bundle_errors.unionByName(a.select("bundle_id", "index", code.alias("code")).where("code is not null"))
    return actions.join(errors.select("bundle_id").distinct(), "bundle_id", "left_anti"), errors
