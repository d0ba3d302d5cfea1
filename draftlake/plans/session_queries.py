"""Registered session queries: orders as reviewed callouts of a customer's session, states from key residues."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlake.operators import sessions as ses
from draftlake.plans.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# One portable expression per column; ``o`` is the order key.
_O = "o_orderkey"
SHARED = {
    "session_id": "o_custkey", "callout_id": _O, "ord": _O,
    "disposition": f"case {_O} % 16 when 0 then 'not_model_input' when 1 then 'redundant' when 2 then 'build_relevant_unsupported' end",
    "ignored": f"{_O} % 23 = 0", "unbindable": f"{_O} % 29 = 0", "has_t": f"{_O} % 11 > 0", "moved": f"{_O} % 13 = 0", "rev": f"{_O} % 3",
    "parse_rev": f"{_O} % 3 + case when {_O} % 17 = 0 then 1 else 0 end", "parse_version": f"case when {_O} % 19 = 0 then 'p1' else 'p2' end", "has_parse": f"{_O} % 31 > 0",
    "status": f"case {_O} % 10 when 0 then 'ambiguous' when 1 then 'unsupported' else 'parsed' end", "form": f"case when {_O} % 5 < 3 then 'diameter' when {_O} % 5 = 3 then 'radius' else 'linear' end",
    "size": f"cast({_O} % 6 + 1 as double)", "termination": f"case when {_O} % 7 = 0 then null when {_O} % 2 = 0 then 'thru' else 'blind' end",
    "depth": f"case when {_O} % 2 = 1 and {_O} % 9 > 0 then 4.0 end", "unit": f"case {_O} % 4 when 0 then 'mm' when 1 then 'in' end",
    "has_target": f"{_O} % 8 > 0", "target_rev": f"{_O} % 3 + case when {_O} % 37 = 0 then 1 else 0 end", "target_key": f"case when {_O} % 41 = 0 then 'old' else 'k' end",
    "circle": f"concat('c', cast({_O} % 5 as string))", "sheet_unit": "case when o_custkey % 3 > 0 then 'mm' end",
}


def _base(spark, sf):
    return table(spark, sf, "orders").selectExpr(*[f"{e} as {n}" for n, e in SHARED.items()])


def _relations(spark, sf):
    b = _base(spark, sf)
    region = F.array(F.lit(0.1), F.lit(0.1), F.lit(0.5), F.lit(0.5))
    nul = lambda t: F.lit(None).cast(t)
    prev = F.col("callout_id") - 1
    pin = F.struct(F.lit("callout").alias("kind"), F.col("pinned").alias("callout_id"), nul("string").alias("name"), nul("string").alias("value"), F.col("pin_rev").alias("revision"), region.alias("region"),
                   F.when(F.col("has_t"), F.col("rev")).alias("own_revision"), region.alias("own_region"))
    c = b.withColumn("pinned", prev.cast("string")).withColumn("pin_rev", F.when(prev % 11 > 0, prev % 3))
    callouts = c.select("session_id", "callout_id", "ord", region.alias("region"), "ignored", "unbindable", "disposition", F.col("pinned").alias("duplicate_of"), nul("string").alias("disposition_reason"), F.when(F.col("disposition") == "redundant", pin).alias("pin"))
    moved = F.when(F.col("moved"), F.array(F.lit(0.2), F.lit(0.1), F.lit(0.5), F.lit(0.5))).otherwise(region)
    transcriptions = b.where("has_t").select("session_id", "callout_id", F.col("rev").alias("revision"), moved.alias("source_region"), F.lit("text").alias("raw_text"))
    parses = b.where("has_parse").select("session_id", "callout_id", F.col("parse_rev").alias("transcription_revision"), F.col("parse_version").alias("parser_version"), "status", "form", "size", nul("long").alias("count"), "termination", "depth", "unit")
    targets = b.where("has_target").select("session_id", "callout_id", F.col("target_rev").alias("transcription_revision"), F.lit("p2").alias("parser_version"), F.col("target_key").alias("geometry_key"), F.lit(1).alias("geometry_version"),
                                           F.lit("circle").alias("target_kind"), F.array("circle").alias("target_ids"), nul("string").alias("profile_id"))
    s = b.select("session_id", "sheet_unit").distinct().withColumn("geometry_key", F.lit("k")).withColumn("geometry_version", F.lit(1)).withColumn("geometry_stale", F.col("session_id") % 20 == 0).withColumn(
        "axis_x", nul("array<double>")).withColumn("axis_y", nul("array<double>"))
    circles = s.select("session_id", F.explode(F.array(*[F.lit(f"c{i}") for i in range(4)])).alias("circle_id"))
    manual = s.where("session_id % 6 = 0").select("session_id", F.lit("c1").alias("circle_id"), F.lit("through").alias("kind"), F.lit(3.0).alias("diameter"), nul("double").alias("depth"))
    edges = s.limit(0).selectExpr("session_id", "cast(null as string) as profile_id", "cast(null as string) as edge_id", "cast(null as array<double>) as start", "cast(null as array<double>) as end")
    ties = s.limit(0).selectExpr("session_id", "cast(null as string) as first_id", "cast(null as string) as second_id", "cast(null as double) as value", "cast(null as string) as unit")
    return dict(callouts=callouts, transcriptions=transcriptions, parses=parses, targets=targets, sessions=s, circles=circles, edges=edges, manual_holes=manual, manual_bindings=ties)


FRESH_SQL = f"""b as (select {', '.join(f'{e} as "{n}"' for n, e in SHARED.items())}, o_custkey % 20 = 0 stale from orders),
f0 as (select *, case when not has_t then 'needs_transcription' when moved then 'region_changed' end t_reason,
  case when stale and has_parse then 'source_unavailable' when not has_t then case when has_parse then 'transcription_missing' else 'needs_parse' end
    when moved then case when has_parse then 'region_changed' else 'needs_parse' end when has_parse and parse_rev = rev and parse_version = 'p2' then null when not has_parse then 'needs_parse'
    when parse_rev <> rev then 'transcription_changed' else 'parser_version_changed' end p_reason,
  case when not has_target then 'needs_target' when stale then 'source_unavailable' when not has_t then 'transcription_missing' when moved then 'region_changed' when target_rev <> rev then 'transcription_changed'
    when target_key <> 'k' then 'geometry_changed' when not (has_parse and parse_rev = target_rev and parse_version = 'p2') then 'parse_missing' end g_reason from b),
fr as (select *, case when t_reason is null then 'current' when not has_t then 'missing' else 'stale' end t_state, case when p_reason is null then 'current' when p_reason = 'needs_parse' then 'missing' else 'stale' end p_state,
  case when g_reason is null then 'current' when not has_target then 'missing' else 'stale' end g_state from f0)"""


def _fresh(r):
    return ses.freshness(r["callouts"], r["transcriptions"], r["parses"], r["targets"], r["sessions"], "p2")


def fresh(spark, sf):
    f = _fresh(_relations(spark, sf))
    return f.groupBy("t_state", "t_reason", "p_state", "p_reason", "g_state", "g_reason").agg(F.count(F.lit(1)).alias("callouts"), F.sum("callout_id").alias("ids"))


QUERIES["callout_freshness_orders"] = fresh
ORACLES["callout_freshness_orders"] = f"with {FRESH_SQL} select t_state, t_reason, p_state, p_reason, g_state, g_reason, count(*) callouts, sum(callout_id)::bigint ids from fr group by all"

COMPILE_SQL = f"""{FRESH_SQL},
z as (select *, case when unit is not null then case unit when 'in' then 25.4::double else 1 end when sheet_unit is not null then 1 end factor from fr),
c0 as (select *, size * factor mm, depth * factor dmm, case when disposition is not null then 'excluded' when ignored then 'excluded' when unbindable then 'excluded' when t_state <> 'current' then 'missing_transcription'
  when p_state = 'stale' then 'stale_parse' when p_state = 'missing' then 'missing_parse' when status = 'ambiguous' then 'parse_ambiguous' when status <> 'parsed' then 'parse_unsupported' when factor is null then 'missing_unit'
  when g_state = 'missing' then 'missing_target' when g_state = 'stale' then 'stale_target' when form = 'diameter' and termination is null then 'unsupported_cad_feature' when form = 'diameter' and termination = 'blind' and depth is null then 'unsupported_semantic'
  when form = 'radius' then 'unsupported_cad_feature' when form = 'linear' then 'unsupported_semantic' end st from z),
h as (select *, case termination when 'thru' then 'through' else 'pocket' end kind, case when termination = 'blind' then dmm end hd, circle = 'c4' lost, session_id % 6 = 0 and circle = 'c1' man from c0 where st is null),
h2 as (select *, arg_min(callout_id, ord) filter (not lost and not man) over w fid, arg_min(kind, ord) filter (not lost and not man) over w fk, arg_min(mm, ord) filter (not lost and not man) over w fm, arg_min(struct_pack(v := hd), ord) filter (not lost and not man) over w fd from h window w as (partition by session_id, circle)),
h3 as (select *, case when lost then 'conflict' when man and (kind <> 'through' or abs(mm - 3) >= 1e-6) then 'conflict' when man then 'compiled' when fid = callout_id then 'compiled'
  when kind <> fk or abs(mm - fm) >= 1e-6 or coalesce(abs(hd - fd.v) >= 1e-6, false) then 'conflict' else 'compiled' end hs,
  case when lost then 'unknown_geometry' when man and (kind <> 'through' or abs(mm - 3) >= 1e-6) then 'manual_conflict' when man then 'manual_decision_matches' when fid = callout_id then null
  when kind <> fk or abs(mm - fm) >= 1e-6 or coalesce(abs(hd - fd.v) >= 1e-6, false) then 'callout_conflict' else 'no_target_geometry' end hr from h2),
rows0 as (select c0.*, coalesce(c0.st, h3.hs) final, h3.hr from c0 left join h3 using (session_id, callout_id))"""


def _compiled(spark, sf):
    r = _relations(spark, sf)
    return ses.compile_callouts(_fresh(r), r["parses"], r["targets"], r["sessions"], r["circles"], r["edges"], r["manual_holes"], r["manual_bindings"], "p2")


def compiled(spark, sf):
    return _compiled(spark, sf)["rows"].groupBy("status", F.when(F.col("status").isin("compiled", "conflict"), F.col("reason")).alias("reason")).agg(F.count(F.lit(1)).alias("callouts"), F.sum("callout_id").alias("ids"))


QUERIES["callout_compile_orders"] = compiled
ORACLES["callout_compile_orders"] = f"with {COMPILE_SQL} select final status, hr reason, count(*) callouts, sum(callout_id)::bigint ids from rows0 group by 1, 2"


def holes(spark, sf):
    return _compiled(spark, sf)["holes"].select("session_id", "circle_id", "callout_id", "kind", F.round("diameter", 4).alias("diameter"))


QUERIES["compiled_holes_orders"] = holes
ORACLES["compiled_holes_orders"] = f"with {COMPILE_SQL} select session_id, circle circle_id, callout_id, kind, round(mm, 4) diameter from h3 where not lost and not man and fid = callout_id"


def buckets(spark, sf):
    c = _compiled(spark, sf)
    none = c["rows"].limit(0).selectExpr("session_id", "cast(null as string) as name", "cast(null as string) as value")
    b = ses.coverage_buckets(c["rows"], ses.citation_valid(c["rows"], none))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("callouts"), F.sum("callout_id").alias("ids"))


# A cited callout has key % 16 = 0, so it is always "not model input" in the same session or unknown.
QUERIES["decision_coverage_orders"] = buckets
ORACLES["decision_coverage_orders"] = f"""with {COMPILE_SQL},
ct as (select r.callout_id, p.callout_id is not null and p.t_state <> 'stale' and p.p_state <> 'stale' and p.g_state <> 'stale' ok from rows0 r left join rows0 p on p.session_id = r.session_id and p.callout_id = r.callout_id - 1 where r.disposition = 'redundant'),
bk as (select r.callout_id, case when disposition in ('build_relevant_unsupported', 'not_model_input') then disposition when disposition = 'redundant' then case when ok then 'redundant' else 'invalid_duplicate' end when ignored or unbindable then 'legacy_unclassified'
  when t_state = 'stale' or p_state = 'stale' or g_state = 'stale' then 'stale' when final = 'compiled' then 'build_applied'
  when final in ('missing_unit', 'parse_ambiguous', 'parse_unsupported', 'unsupported_semantic', 'unsupported_cad_feature', 'conflict', 'stale_parse', 'stale_target', 'missing_parse') then 'compile_blocked' else 'unclassified' end bucket from rows0 r left join ct using (callout_id))
select bucket, count(*) callouts, sum(callout_id)::bigint ids from bk group by 1"""


def ready(spark, sf):
    c = _compiled(spark, sf)
    none = c["rows"].limit(0).selectExpr("session_id", "cast(null as string) as name", "cast(null as string) as value")
    b = ses.coverage_buckets(c["rows"], ses.citation_valid(c["rows"], none))
    props = c["rows"].select(*ses.KEY, (F.col("callout_id") % 3).alias("n"))
    sheet = c["rows"].limit(0).selectExpr("session_id", "callout_id", "'x' as category", "'y' as action", "'z' as reason")
    return ses.readiness(c["rows"], b, props, sheet).groupBy("category", "action").agg(F.count(F.lit(1)).alias("issues"))


QUERIES["build_readiness_orders"] = ready
ORACLES["build_readiness_orders"] = f"""{ORACLES['decision_coverage_orders'].split('select bucket, count')[0].rstrip()},
i as (select case final when 'missing_target' then case when callout_id % 3 > 1 then 'ambiguous_target' else 'missing_target' end when 'missing_transcription' then 'missing_transcription' when 'missing_unit' then 'missing_unit' when 'parse_ambiguous' then 'parse_ambiguous'
   when 'stale_target' then 'stale_target' when 'unsupported_semantic' then 'unsupported_semantic' when 'unsupported_cad_feature' then 'unsupported_cad_feature' when 'conflict' then 'callout_conflict' else 'parse_error' end category,
  case final when 'missing_target' then 'confirm_target' when 'stale_target' then 'confirm_target' when 'missing_transcription' then 'transcribe' when 'unsupported_semantic' then 'review_callout' when 'unsupported_cad_feature' then 'review_callout' when 'conflict' then 'review_conflict' else 'edit_transcription' end as action
  from rows0 where final not in ('compiled', 'excluded')
  union all select case bucket when 'legacy_unclassified' then 'legacy_unclassified' when 'build_relevant_unsupported' then 'unsupported_build_relevant' else 'stale_duplicate_reference' end, 'review_callout' from bk where bucket in ('legacy_unclassified', 'build_relevant_unsupported', 'invalid_duplicate'))
select category, action, count(*) issues from i group by 1, 2"""


def exported(spark, sf):
    r = _relations(spark, sf)
    f = _fresh(r)
    props = f.select("session_id", "callout_id", F.explode(F.sequence(F.lit(0), (F.col("callout_id") % 7).cast("int"))).alias("distance")).withColumn("tier", F.concat(F.lit("T"), (F.col("distance") % 3).cast("string"))).withColumn("target_ids", F.array(F.col("distance").cast("string")))
    e = ses.export_bundle(f, r["parses"], r["targets"], props, "p2")
    return e.select("callout_id", F.col("freshness.parse.state").alias("parse_state"), F.size("target_proposals").alias("proposals"), F.col("target_proposals")[0]["tier"].alias("best_tier"), F.col("semantic_parse.form").alias("form"), F.col("confirmed_target.geometry_key").alias("geometry_key"))


QUERIES["review_bundle_export_orders"] = exported
ORACLES["review_bundle_export_orders"] = f"""with {FRESH_SQL}
select callout_id, p_state parse_state, least(callout_id % 7 + 1, 4)::int proposals, 'T0' best_tier, case when has_t and has_parse and parse_rev = rev and parse_version = 'p2' then form end form, case when has_target then target_key end geometry_key from fr"""


def imported(spark, sf):
    r = _relations(spark, sf)
    f = _fresh(r)
    s = r["sessions"].withColumn("revision", F.lit(3)).withColumn("source_digest", F.lit("d"))
    b = s.select(F.concat(F.lit("b"), F.col("session_id").cast("string")).alias("bundle_id"), "session_id", F.lit("1").alias("bundle_version"), F.lit(5).alias("schema_version"), F.when(F.col("session_id") % 50 == 0, "x").otherwise("d").alias("source_digest"),
                 F.when(F.col("session_id") % 40 == 1, 2).otherwise(3).alias("base_revision"), F.lit("p2").alias("parser_version"), F.lit(1).alias("geometry_version"), F.lit("k").alias("geometry_key"))
    a = _base(spark, sf).select(F.concat(F.lit("b"), F.col("session_id").cast("string")).alias("bundle_id"), "session_id", F.col("callout_id").cast("int").alias("index"),
                                F.when(F.col("callout_id") % 97 == 0, "erase").when(F.col("callout_id") % 3 == 0, "transcribe").when(F.col("callout_id") % 3 == 1, "confirm_target").otherwise("set_disposition").alias("action"), "callout_id",
                                F.when(F.col("callout_id") % 15 == 0, " ").when(F.col("callout_id") % 33 == 0, F.repeat(F.lit("t"), 201)).otherwise("t").alias("raw_text"), F.lit(None).cast("array<double>").alias("region"), F.when(F.col("callout_id") % 10 == 0, "odd").otherwise("not_model_input").alias("disposition"),
                                F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("string").alias("disposition_reason"), F.lit("circle").alias("target_kind"), F.array("circle").alias("target_ids"))
    geometry = r["circles"].select("session_id", F.lit("circle").alias("kind"), F.col("circle_id").alias("geometry_id"))
    none = s.limit(0).selectExpr("session_id", "cast(null as string) as name")
    valid, errors = ses.validate_bundle(b, a, r["callouts"], s, geometry, none, f, "p2", "1", 5, max_actions=200, max_text=200, max_targets=100)
    return errors.groupBy("code").agg(F.count(F.lit(1)).alias("rows")).unionByName(valid.groupBy(F.lit("valid").alias("code")).agg(F.count(F.lit(1)).alias("rows")))


QUERIES["review_bundle_import_orders"] = imported
ORACLES["review_bundle_import_orders"] = f"""with {FRESH_SQL},
a as (select session_id s, case when callout_id % 97 = 0 then 'unknown_action' when callout_id % 3 = 0 then case when callout_id % 15 = 0 then 'empty_text' when callout_id % 33 = 0 then 'text_too_long' end
  when callout_id % 3 = 1 then case when circle = 'c4' then 'unknown_geometry' when not has_t then 'no_transcription' when p_state <> 'current' then 'no_current_parse' end when callout_id % 10 = 0 then 'unknown_disposition' end code from fr),
e as (select s, code from a where code is not null union all select distinct s, 'source_mismatch' from a where s % 50 = 0 union all select distinct s, 'stale_base_revision' from a where s % 40 = 1)
select code, count(*) as rows from e group by 1 union all select 'valid', count(*) from a where s not in (select s from e) having count(*) > 0"""
