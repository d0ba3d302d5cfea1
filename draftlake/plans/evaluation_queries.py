"""Registered evaluation queries: parts as gold claims, jittered copies as two arms of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlake.operators import evaluation as ev
from draftlake.operators import matching
from draftlake.plans.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

K = "p_partkey"
_X, _Y = f"({K} * 7919) % 400", f"({K} * 104729) % 300"
GOLD = {
    "page_id": f"{K} div 20", "claim_id": K,
    "x0": f"cast({_X} as double) / 1000", "y0": f"cast({_Y} as double) / 1000",
    "x1": f"cast({_X} + p_size + 20 as double) / 1000", "y1": f"cast({_Y} + p_size % 17 + 20 as double) / 1000",
    "representation": f"case {K} % 3 when 0 then 'circle' when 1 then 'arc' else 'underdetermined' end",
    "physical": f"case {K} % 4 when 0 then 'hole' when 1 then 'pocket' when 2 then 'underdetermined' end",
    "form": f"case {K} % 2 when 0 then 'diameter' else 'R' end", "size": "cast(p_size as double)", "unit": "'mm'",
    "count_printed": f"case when {K} % 5 = 0 then {K} % 4 + 1 end",
    "termination": f"case {K} % 3 when 0 then 'thru' when 1 then 'finite' else 'unknown' end",
    "depth": f"case when {K} % 3 = 1 then cast({K} % 30 as double) end",
}
# ``a`` is 0 or 1: the arm.
_J = f"(({K} * (31 + a * 12)) % 61 - 30)"
CAND = {
    "page_id": f"{K} div 20", "arm": "case a when 0 then 'D' else 'V' end", "candidate_id": f"{K} * 10 + a", "ord": K,
    "x0": f"cast({_X} + {_J} as double) / 1000", "y0": f"cast({_Y} + {_J} as double) / 1000",
    "x1": f"cast({_X} + {_J} + p_size + 22 as double) / 1000", "y1": f"cast({_Y} + {_J} + p_size % 17 + 21 as double) / 1000",
    "representation": f"case ({K} + a) % 4 when 0 then 'circle' when 1 then 'arc' when 2 then 'unknown' end",
    "physical": f"case ({K} + a) % 5 when 0 then 'hole' when 1 then 'pocket' when 2 then 'unknown' end",
    "form": f"case ({K} + a) % 3 when 0 then 'diameter' when 1 then 'R' else 'unknown' end",
    "size": f"case when ({K} + a) % 7 > 0 then p_size + ({K} + a) % 2 * 0.04 + case when {K} % 6 = 0 then 3 else 0 end end",
    "size_unit": f"case when ({K} + a) % 11 = 0 then 'in' else 'mm' end",
    "count_printed": f"case when ({K} + a) % 5 < 2 then {K} % 4 + 1 end",
    "termination": f"case ({K} + a) % 3 when 0 then 'thru' when 1 then 'finite' else 'unknown' end",
    "depth": f"case when ({K} + a) % 3 = 1 then cast({K} % 30 as double) end", "depth_unit": "'mm'",
}


def gold(spark, sf):
    return table(spark, sf, "part").selectExpr(*[f"{e} as {n}" for n, e in GOLD.items()])


def candidates(spark, sf):
    p = table(spark, sf, "part").where("p_partkey % 9 > 0").withColumn("a", F.explode(F.array(F.lit(0), F.lit(1))))
    c = p.selectExpr(*[f"{e} as {n}" for n, e in CAND.items()])
    return c.withColumn("size", F.col("size").cast("double"))


def scopes(spark, sf):
    kind = "case (page_id % 4) when 0 then 'full_page' when 1 then 'regions' when 2 then 'predicates' end as scope"
    box = F.array(F.struct(F.lit(0.1).alias("x0"), F.lit(0.1).alias("y0"), F.lit(0.6).alias("x1"), F.lit(0.6).alias("y1")))
    return gold(spark, sf).select("page_id").distinct().selectExpr("page_id", kind).withColumn("regions", box)


_sql = lambda d: ", ".join(f"{e.replace(' div ', ' // ')} as {n}" for n, e in d.items())
MATCH_SQL = f"""gold as (select {_sql(GOLD)} from part),
cand as (select {_sql(CAND)} from part, (select unnest([0, 1]) a) where p_partkey % 9 > 0),
arms as (select distinct page_id, arm from cand),
g as (select gold.*, arm from gold join arms using (page_id)),
p0 as (select g.page_id, g.arm, g.claim_id, c.candidate_id,
  greatest(least(g.x1, c.x1) - greatest(g.x0, c.x0), 0) * greatest(least(g.y1, c.y1) - greatest(g.y0, c.y0), 0) inter,
  (g.x1 - g.x0) * (g.y1 - g.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) total,
  sqrt(((g.x0 + g.x1) / 2 - (c.x0 + c.x1) / 2) ** 2 + ((g.y0 + g.y1) / 2 - (c.y0 + c.y1) / 2) ** 2) gap
  from g join cand c on g.page_id = c.page_id and g.arm = c.arm),
p1 as (select *, case when inter <= 0 then 0 else inter / (total - inter) end iou from p0),
sc as (select *, round(least(1.0, iou + greatest(0.0, 0.05::double - gap)), 6) score from p1
  where (iou >= 0.15 or gap <= 0.05::double) and round(least(1.0, iou + greatest(0.0, 0.05::double - gap)), 6) > 0),
am as (select *, max(score) over (partition by page_id, arm, claim_id) bc, max(score) over (partition by page_id, arm, candidate_id) bd from sc),
close as (select page_id, arm, claim_id from am where bc - score <= 0.05::double group by all having count(*) > 1),
cont as (select distinct a.page_id, a.arm, a.claim_id from am a join (select page_id, arm, candidate_id from am where bd - score <= 0.05::double group by all having count(*) > 1) x
  using (page_id, arm, candidate_id) where bd - score <= 0.05::double),
vague as (select *, 'close_scores' kind from close union all
  select *, 'candidate_contested' from (select * from cont except select * from close))"""


def region_scores(spark, sf):
    claims = gold(spark, sf).join(candidates(spark, sf).select("page_id", "arm").distinct(), "page_id")
    m = matching.match_regions(claims, candidates(spark, sf), ["page_id", "arm"])
    return m.select("page_id", "arm", "claim_id", "candidate_id", "score")


QUERIES["region_match_parts"] = region_scores
ORACLES["region_match_parts"] = f"with {MATCH_SQL} select page_id, arm, claim_id, candidate_id, score from sc"


def vague_claims(spark, sf):
    claims = gold(spark, sf).join(candidates(spark, sf).select("page_id", "arm").distinct(), "page_id")
    m = matching.match_regions(claims, candidates(spark, sf), ["page_id", "arm"])
    return matching.ambiguity(m, ["page_id", "arm"]).groupBy("arm", "kind").agg(F.count(F.lit(1)).alias("claims"), F.sum("claim_id").alias("id_sum"))


QUERIES["ambiguous_claims_parts"] = vague_claims
ORACLES["ambiguous_claims_parts"] = f"with {MATCH_SQL} select arm, kind, count(*) claims, sum(claim_id)::bigint id_sum from vague group by 1, 2"

# Sequential greedy pairing of the unambiguous claims, stated as a recursive walk over ranked edges.
PAIR_SQL = f"""{MATCH_SQL},
ed as (select a.page_id, a.arm, a.claim_id, a.candidate_id, a.score, row_number() over (partition by a.page_id, a.arm order by bc desc, a.claim_id, a.score desc, a.candidate_id) rn
  from (select sc.*, max(score) over (partition by page_id, arm, claim_id) bc from sc where (page_id, arm, claim_id) not in (select page_id, arm, claim_id from vague)) a),
walk as (select page_id, arm, 0::bigint rn, []::bigint[] cl, []::bigint[] ca from (select distinct page_id, arm from ed)
  union all select w.page_id, w.arm, e.rn, case when list_contains(cl, e.claim_id) or list_contains(ca, e.candidate_id) then cl else list_append(cl, e.claim_id) end,
    case when list_contains(cl, e.claim_id) or list_contains(ca, e.candidate_id) then ca else list_append(ca, e.candidate_id) end
  from walk w join ed e on w.page_id = e.page_id and w.arm = e.arm and e.rn = w.rn + 1),
fin as (select page_id, arm, arg_max(cl, rn) cl, arg_max(ca, rn) ca from walk group by 1, 2),
pairs as (select page_id, arm, unnest(cl) claim_id, unnest(ca) candidate_id from fin)"""


def _evaluated(spark, sf):
    return ev.evaluate_pages(gold(spark, sf), candidates(spark, sf), scopes(spark, sf))


def paired(spark, sf):
    _, status, _ = _evaluated(spark, sf)
    return status.select("page_id", "arm", "claim_id", "candidate_id", "status")


QUERIES["unambiguous_pairs_parts"] = paired
ORACLES["unambiguous_pairs_parts"] = f"""with recursive {PAIR_SQL}
select g.page_id, g.arm, g.claim_id, p.candidate_id, case when p.candidate_id is not null then 'matched' when v.kind is not null then 'ambiguous' else 'unmatched' end status
from g left join pairs p using (page_id, arm, claim_id) left join vague v using (page_id, arm, claim_id)"""

_num = lambda e, eu, g, gu: f"""case when {e} is null and {g} is null then 'not_applicable' when {g} is null then 'omission' when {e} is null then 'false_claim'
 when abs({g} * case when {gu} = 'in' then 25.4::double else 1 end - {e} * case when {eu} = 'in' then 25.4::double else 1 end) <= greatest(0.05::double, 0.02::double * abs({e} * case when {eu} = 'in' then 25.4::double else 1 end)) then 'correct'
 when {eu} <> coalesce({gu}, {eu}) then 'unit_error' else 'value_error' end"""
_cat = lambda f, pos: f"""case when g.{f} is null then 'not_applicable' when c.{f} is null or c.{f} = 'unknown' then 'abstained' when c.{f} = g.{f} then 'correct'
 when g.{f} in ('underdetermined', 'unknown') and c.{f} in ({pos}) then 'overclaim' else 'mismatch' end"""
FIELD_SQL = f"""{PAIR_SQL},
st as (select g.*, p.candidate_id, case when p.candidate_id is not null then 'matched' when v.kind is not null then 'ambiguous' else 'unmatched' end status
  from g left join pairs p using (page_id, arm, claim_id) left join vague v using (page_id, arm, claim_id)),
vd as (select g.page_id, g.arm, g.claim_id, g.status, {_cat('representation', "'circle', 'arc'")} representation, {_cat('physical', "'hole', 'pocket', 'slot'")} physical,
  {_cat('form', "''")} form, {_num('g.size', 'g.unit', 'c.size', 'c.size_unit')} as size, {_num('g.count_printed', "'mm'", 'c.count_printed', "'mm'")} count_printed,
  {_cat('termination', "''")} termination, {_num('g.depth', 'g.unit', 'c.depth', 'c.depth_unit')} depth, 'correct' target_binding
  from st g left join cand c on g.page_id = c.page_id and g.arm = c.arm and g.candidate_id = c.candidate_id),
up as (unpivot vd on representation, physical, form, size, count_printed, termination, depth, target_binding into name field value v0),
fr as (select page_id, arm, claim_id, status, field, case status when 'matched' then v0 when 'ambiguous' then 'not_scored' else 'not_produced' end verdict from up)"""


def field_verdicts(spark, sf):
    rows, _, _ = _evaluated(spark, sf)
    return rows.groupBy("arm", "field", "verdict").agg(F.count(F.lit(1)).alias("rows"))


QUERIES["field_verdicts_parts"] = field_verdicts
ORACLES["field_verdicts_parts"] = f"with recursive {FIELD_SQL} select arm, field, verdict, count(*) as rows from fr group by 1, 2, 3"


def metrics(spark, sf):
    rows, _, _ = _evaluated(spark, sf)
    return ev.aggregate_metrics(rows).select("arm", "field", "correct", "wrong", "abstained", "unscored", F.round("accuracy", 3).alias("accuracy"))


QUERIES["evaluation_metrics_parts"] = metrics
_M = """select arm, {f} field, count(*) filter (verdict = 'correct') correct, count(*) filter (verdict in ('mismatch', 'value_error', 'unit_error', 'overclaim', 'false_claim')) wrong,
  count(*) filter (verdict in ('abstained', 'omission', 'not_produced')) abstained, count(*) filter (verdict = 'not_scored') unscored from fr {w} group by 1, 2"""
ORACLES["evaluation_metrics_parts"] = f"""with recursive {FIELD_SQL}, m as ({_M.format(f='field', w='')} union all {_M.format(f="'all_semantic'", w="where field <> 'target_binding'")})
select *, round(round(correct / nullif(correct + wrong + abstained, 0), 4), 3) accuracy from m"""


def arms(spark, sf):
    rows, _, _ = _evaluated(spark, sf)
    return ev.compare_arms(rows, "D", "V")


QUERIES["arm_comparison_parts"] = arms
ORACLES["arm_comparison_parts"] = f"""with recursive {FIELD_SQL},
o as (select *, case status when 'ambiguous' then null when 'unmatched' then false else verdict in ('correct', 'not_applicable') end ok from fr),
b as (select d.field, d.ok b_ok, v.ok a_ok, v.status from o d join o v using (page_id, claim_id, field) where d.arm = 'D' and v.arm = 'V' and d.ok is not null and v.ok is not null),
r as (select field, count(*) scorable, count(*) filter (not b_ok and a_ok) recovered, count(*) filter (b_ok and not a_ok and status = 'matched') regressed_wrong,
  count(*) filter (b_ok and not a_ok and status <> 'matched') regressed_abstention from b group by 1)
select *, recovered - regressed_wrong - regressed_abstention net_gain from r"""


def extra_kinds(spark, sf):
    _, status, extras = _evaluated(spark, sf)
    return ev.localisation(status, candidates(spark, sf), extras).select("arm", "claims", "matched", "ambiguous", "candidates", "false_positives", "unscorable_extras")


QUERIES["localisation_parts"] = extra_kinds
ORACLES["localisation_parts"] = f"""with recursive {FIELD_SQL},
ar as (select page_id, x0, y0, x1, y1 from gold where page_id % 4 = 2 union all select distinct page_id, 0.1, 0.1, 0.6, 0.6 from gold where page_id % 4 = 1),
ex as (select c.*, c.page_id % 4 = 0 or exists(select 1 from ar a where a.page_id = c.page_id and (
    greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) >= 0.15 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0)
      - greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0))
    or sqrt(((a.x0 + a.x1) / 2 - (c.x0 + c.x1) / 2) ** 2 + ((a.y0 + a.y1) / 2 - (c.y0 + c.y1) / 2) ** 2) <= 0.05::double)) fp
  from cand c where (page_id, arm, candidate_id) not in (select page_id, arm, candidate_id from pairs))
select arm, any_value(n.claims) claims, any_value(n.matched) matched, any_value(n.ambiguous) ambiguous, any_value(k.n) candidates,
  count(*) filter (fp) false_positives, count(*) filter (not fp) unscorable_extras
from ex join (select arm, count(*) claims, count(*) filter (status = 'matched') matched, count(*) filter (status = 'ambiguous') ambiguous from st group by 1) n using (arm)
join (select arm, count(*) n from cand group by 1) k using (arm) group by 1"""


def invented(spark, sf):
    rows, _, _ = _evaluated(spark, sf)
    return ev.overclaims(rows)


QUERIES["overclaims_parts"] = invented
ORACLES["overclaims_parts"] = f"""with recursive {FIELD_SQL},
j as (select st.arm, vd.*, st.form gf, st.termination gt, c.form cf, c.termination ct from vd join st using (page_id, arm, claim_id) join cand c on c.page_id = st.page_id and c.arm = st.arm and c.candidate_id = st.candidate_id
  where st.status = 'matched'),
s as (select arm, count(*) filter (size = 'false_claim') invented_size, count(*) filter (count_printed = 'false_claim') invented_count, count(*) filter (depth = 'false_claim') invented_depth,
  0::bigint invented_form, count(*) filter (termination = 'overclaim' or (termination = 'mismatch' and gt = 'unknown' and ct is not null and ct <> 'unknown')) invented_thru,
  count(*) filter (physical = 'overclaim') unsupported_physical_meaning from j group by 1)
select *, invented_size + invented_count + invented_depth + invented_form + invented_thru + unsupported_physical_meaning total from s"""


def echoes(spark, sf):
    c = candidates(spark, sf).withColumn("has_claim", F.col("size").isNotNull()).drop("ord")
    obs = candidates(spark, sf).where("arm = 'D'").select("page_id", F.col("candidate_id").alias("observation_id"), "ord", *[
        (F.col(b) + (F.col("candidate_id") % 3) * 0.0004).alias(b) for b in matching.BOX])
    return ev.echo(c, obs).select("page_id", "candidate_id", "observation_id", "class")


QUERIES["observation_echo_parts"] = echoes
ORACLES["observation_echo_parts"] = f"""with cand as (select {_sql(CAND)} from part, (select unnest([0, 1]) a) where p_partkey % 9 > 0),
ob as (select page_id, candidate_id observation_id, ord, x0 + (candidate_id % 3) * 0.0004::double x0, y0 + (candidate_id % 3) * 0.0004::double y0, x1 + (candidate_id % 3) * 0.0004::double x1,
  y1 + (candidate_id % 3) * 0.0004::double y1 from cand where arm = 'D')
select c.page_id, c.candidate_id, arg_min(o.observation_id, o.ord) observation_id, case when any_value(c.size is not null) then 'contentful_observation_supported' else 'empty_echo' end as class
from cand c join ob o on c.page_id = o.page_id and abs(c.x0 - o.x0) <= 0.0006::double and abs(c.y0 - o.y0) <= 0.0006::double and abs(c.x1 - o.x1) <= 0.0006::double and abs(c.y1 - o.y1) <= 0.0006::double
group by 1, 2"""


def copies(spark, sf):
    c = candidates(spark, sf).withColumn("ord", F.col("candidate_id")).withColumn("signature", F.when(F.col("size").isNotNull(), F.concat_ws("|", F.col("size").cast("int"), "form"))).withColumn(
        "target_key", F.col("termination")).withColumn("callout_text", F.coalesce(F.col("physical"), F.lit("")))
    d = ev.duplicates(c)
    return d.groupBy("page_id").agg(*[F.count_if(n).alias(n) for n in ("exact", "near", "signature_target", "callout_text_repeat")],
                                    F.count_if(F.col("exact") | F.col("near") | F.col("signature_target") | F.col("callout_text_repeat")).alias("total"))


QUERIES["duplicate_classes_parts"] = copies
ORACLES["duplicate_classes_parts"] = f"""with c0 as (select {_sql(CAND)} from part, (select unnest([0, 1]) a) where p_partkey % 9 > 0),
c as (select *, round(x0, 6) q0, round(y0, 6) q1, round(x1, 6) q2, round(y1, 6) q3, case when size is not null then concat_ws('|', size::int, form) end sig from c0),
d as (select c.page_id, c.candidate_id, bool_or(e.q0 = c.q0 and e.q1 = c.q1 and e.q2 = c.q2 and e.q3 = c.q3) ex,
  bool_or(not (e.q0 = c.q0 and e.q1 = c.q1 and e.q2 = c.q2 and e.q3 = c.q3) and (sqrt(((e.x0 + e.x1) / 2 - (c.x0 + c.x1) / 2) ** 2 + ((e.y0 + e.y1) / 2 - (c.y0 + c.y1) / 2) ** 2) <= 0.05::double or
    greatest(least(e.x1, c.x1) - greatest(e.x0, c.x0), 0) * greatest(least(e.y1, c.y1) - greatest(e.y0, c.y0), 0) / ((e.x1 - e.x0) * (e.y1 - e.y0) + (c.x1 - c.x0) * (c.y1 - c.y0)
      - greatest(least(e.x1, c.x1) - greatest(e.x0, c.x0), 0) * greatest(least(e.y1, c.y1) - greatest(e.y0, c.y0), 0)) >= 0.15)) nr,
  bool_or(e.sig = c.sig and e.termination = c.termination) sg, bool_or(e.physical = c.physical) tx
  from c left join c e on c.page_id = e.page_id and e.candidate_id < c.candidate_id group by 1, 2)
select page_id, count(*) filter (ex) exact, count(*) filter (nr) near, count(*) filter (sg) signature_target, count(*) filter (tx) callout_text_repeat,
  count(*) filter (coalesce(ex, false) or coalesce(nr, false) or coalesce(sg, false) or coalesce(tx, false)) total from d group by 1"""


def hits(spark, sf):
    c = candidates(spark, sf)
    t = gold(spark, sf)
    return ev.label_candidates(c, t, ["page_id"], 0.1).groupBy("page_id", "arm").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("candidates"))


QUERIES["detection_labels_parts"] = hits
ORACLES["detection_labels_parts"] = f"""with {MATCH_SQL.split('arms as')[0].rstrip().rstrip(',')},
h as (select c.*, exists(select 1 from gold t where t.page_id = c.page_id and (c.x0 + c.x1) / 2 between t.x0 and t.x1 and (c.y0 + c.y1) / 2 between t.y0 and t.y1
  and greatest(least(t.x1, c.x1) - greatest(t.x0, c.x0), 0) * greatest(least(t.y1, c.y1) - greatest(t.y0, c.y0), 0) >= 0.5 * ((c.x1 - c.x0) * (c.y1 - c.y0))) hit from cand c)
select page_id, arm, count(*) filter (hit) hits, count(*) candidates from h group by 1, 2"""


def reference_problems(spark, sf):
    li = table(spark, sf, "lineitem")
    items = li.selectExpr("l_suppkey as run_id", "l_orderkey as candidate_id", "l_partkey as image_id", "case when l_linenumber > 2 then l_orderkey end as observation_id")
    sent = table(spark, sf, "part").selectExpr("p_partkey as image_id", "p_partkey % 100 as run_id").unionByName(li.where("l_linenumber < 5").selectExpr("l_partkey as image_id", "l_suppkey as run_id")).distinct()
    allowed = table(spark, sf, "orders").selectExpr("o_orderkey as observation_id", "o_orderkey % 100 as run_id")
    return ev.check_references(items, sent, allowed).groupBy("code").agg(F.count(F.lit(1)).alias("problems"))


QUERIES["reference_checks_lineitem"] = reference_problems
ORACLES["reference_checks_lineitem"] = """with s as (select p_partkey image_id, p_partkey % 100 run_id from part union select l_partkey, l_suppkey from lineitem where l_linenumber < 5),
a as (select distinct l_suppkey, l_partkey from lineitem where (l_suppkey, l_partkey) not in (select run_id, image_id from s)),
b as (select distinct l_suppkey, l_orderkey from lineitem where l_linenumber > 2 and (l_suppkey, l_orderkey) not in (select o_orderkey % 100, o_orderkey from orders)),
d as (select l_suppkey, l_orderkey from lineitem group by 1, 2 having count(*) > 1),
u as (select * from s where (run_id, image_id) not in (select l_suppkey, l_partkey from lineitem))
select 'unknown_image' code, count(*) problems from a having count(*) > 0 union all select 'unknown_observation', count(*) from b having count(*) > 0
union all select 'duplicate_id', count(*) from d having count(*) > 0 union all select 'page_not_covered', count(*) from u having count(*) > 0"""
