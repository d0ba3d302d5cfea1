"""Registered coverage, solid, ledger and answer queries over proxy relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlake.operators import coverage as cov
from draftlake.operators import ledger, solids
from draftlake.plans.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_num = "cast({0} as double)".format


# Printed numbers: parts (by size) of a supplier's sheet; readings: line items.
def _spans(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_suppkey as sheet_id", "l_orderkey * 8 + l_linenumber as id", "concat(l_returnflag, cast(l_linenumber as string)) as text",
                                                   "case when l_linenumber % 5 > 0 then l_quantity + l_tax / 100 end as value")


def _printed(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey % 100 as sheet_id", "p_partkey as ord", "p_size + case when p_partkey % 7 = 0 then 0.5D else 0.0D end as printed")


def _callouts(spark, sf):
    return table(spark, sf, "supplier").selectExpr("s_suppkey as sheet_id", "case s_suppkey % 3 when 0 then 'A 1x' when 1 then 'R-2' else 'N3' end as callout")


_COV_SQL = """sp as (select l_suppkey sheet_id, l_orderkey * 8 + l_linenumber id, l_returnflag || l_linenumber as text, case when l_linenumber % 5 > 0 then l_quantity + l_tax / 100 end v from lineitem),
pr as (select p_partkey % 100 sheet_id, p_partkey ord, p_size + case when p_partkey % 7 = 0 then 0.5::double else 0 end printed from part),
co as (select s_suppkey sheet_id, case s_suppkey % 3 when 0 then 'a1x' when 1 then 'r2' else 'n3' end c from supplier),
vs as (select * from sp where v is not null),
ht as (select n.sheet_id, n.v, arg_min(printed, ord) hit from (select distinct sheet_id, v from vs) n join pr using (sheet_id) where abs(n.v - printed) <= greatest(1e-6, 0.001::double * abs(printed)) group by 1, 2),
cl as (select vs.*, hit, case when hit is not null then 'found' when starts_with(c, lower(text)) then 'callout' else 'noise' end as class from vs left join ht using (sheet_id, v) join co using (sheet_id)),
fd as (select p.sheet_id, p.printed, bool_or(h.hit is not null) found from (select distinct sheet_id, printed from pr) p left join ht h on h.sheet_id = p.sheet_id and h.hit = p.printed group by 1, 2)"""


def coverage_rows(spark, sf):
    classes, printed = cov.printed_coverage(_spans(spark, sf), _printed(spark, sf), _callouts(spark, sf))
    return cov.coverage_report(classes, printed)


QUERIES["printed_coverage_lineitem"] = coverage_rows
ORACLES["printed_coverage_lineitem"] = f"""with {_COV_SQL}
select sheet_id, printed, covered, n_found, n_callout, n_noise, printed - covered missing from (select sheet_id, count(*) printed, count(*) filter (found) covered from fd group by 1)
full join (select sheet_id, count(*) filter (class = 'found') n_found, count(*) filter (class = 'callout') n_callout, count(*) filter (class = 'noise') n_noise from cl group by 1) using (sheet_id)"""


def missing_rows(spark, sf):
    return cov.missing(_printed(spark, sf), _spans(spark, sf).where("value is not null"))


QUERIES["missing_numbers_parts"] = missing_rows
ORACLES["missing_numbers_parts"] = f"""with {_COV_SQL} select distinct sheet_id, printed from pr where not exists(select 1 from vs where vs.sheet_id = pr.sheet_id and abs(vs.v - printed) <= greatest(1e-6, 0.001::double * abs(printed)))"""

def class_coverage(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr("l_suppkey as sheet_id", "l_orderkey * 8 + l_linenumber as id", "case l_linenumber % 4 when 0 then 'Ø8 THRU' when 1 then 'R5' when 2 then 'Ø3' else '12' end as text", "l_quantity as value")
    raw = raw.withColumn("st", F.col("id") % 3)
    return cov.coverage_by_class(raw.where("st = 0"), raw.where("st = 1"), raw)


def label_pairs(spark, sf):
    lab = table(spark, sf, "part").selectExpr("p_partkey % 200 as sheet_id", "p_partkey as id", "cast(p_size as double) as value", "'mm' as unit", "case p_partkey % 3 when 0 then 'diameter' when 1 then 'linear' end as kind")
    rd = table(spark, sf, "customer").selectExpr("c_custkey % 200 as sheet_id", "c_custkey as id", "cast(c_custkey * 7919 % 47 + 1 as double) as value", "'mm' as unit", "case c_custkey % 3 when 0 then 'diameter' when 1 then 'linear' end as kind")
    return cov.pair_labels(lab, rd)


QUERIES["label_pairs_parts"] = label_pairs
ORACLES["label_pairs_parts"] = """with l as (select p_partkey % 200 sheet_id, p_partkey id, p_size::double v, case p_partkey % 3 when 0 then 'diameter' when 1 then 'linear' end kind from part),
r as (select c_custkey % 200 sheet_id, c_custkey id, (c_custkey * 7919 % 47 + 1)::double v, case c_custkey % 3 when 0 then 'diameter' when 1 then 'linear' end kind from customer),
j as (select l.sheet_id, l.id label_id, count(*) n, min(r.id) a, count(*) filter (r.kind = l.kind) nt, min(r.id) filter (r.kind = l.kind) t from l join r on l.sheet_id = r.sheet_id and abs(l.v - r.v) < 1e-6 group by 1, 2)
select sheet_id, label_id, case when nt = 1 then t else a end reading_id from j where nt = 1 or n = 1"""


def unique_sizes(spark, sf):
    a = table(spark, sf, "supplier").selectExpr("s_suppkey % 50 as sheet_id", "s_suppkey as id", "cast(s_suppkey % 45 + 5 as double) as diameter")
    s = table(spark, sf, "customer").selectExpr("c_custkey % 50 as sheet_id", "concat('g', cast(c_custkey as string)) as geometry_id", "cast(c_custkey % 97 as double) / 2 as diameter")
    return cov.unique_by_size(a, s).select("sheet_id", "id", "geometry_id")


QUERIES["unique_size_customers"] = unique_sizes
ORACLES["unique_size_customers"] = """with a as (select s_suppkey % 50 sheet_id, s_suppkey id, (s_suppkey % 45 + 5)::double d from supplier), s as (select c_custkey % 50 sheet_id, 'g' || c_custkey g, (c_custkey % 97)::double / 2 d from customer),
j as (select a.id, count(*) n, min(g) g from a join s on a.sheet_id = s.sheet_id and abs(s.d - a.d) <= greatest(0.03::double * a.d, 0.15) group by 1)
select sheet_id, a.id, case when n = 1 then g end geometry_id from a left join j using (id)"""


def label_hits(spark, sf):
    r = table(spark, sf, "lineitem").selectExpr("l_suppkey as sheet_id", "l_quantity as value", "l_linestatus as path", "l_returnflag as reason")
    l = table(spark, sf, "part").selectExpr("p_partkey % 100 as sheet_id", "cast(p_size as double) + 0.3 as value_mm")
    return cov.label_match_summary(cov.label_match(r, l))


QUERIES["label_match_lineitem"] = label_hits
ORACLES["label_match_lineitem"] = """with l as (select p_partkey % 100 s, p_size::double + 0.3 v from part)
select l_suppkey sheet_id, l_linestatus path, l_returnflag reason, count(*) readings, count(*) filter (exists(select 1 from l where s = l_suppkey and abs(l_quantity - v) <= greatest(0.001, 0.04::double * v))) label_matching from lineitem group by 1, 2, 3"""


def agreed(spark, sf):
    r = table(spark, sf, "lineitem").selectExpr("l_orderkey as sheet_id", "l_quantity as value", "(l_linenumber * 1000 + l_partkey) as ord")
    return cov.agreed_value(r, ["sheet_id"]).groupBy("distinct_values", "alternatives").agg(F.count(F.lit(1)).alias("sheets"), F.sum("agreed").alias("agreed"))


QUERIES["agreed_values_orders"] = agreed
ORACLES["agreed_values_orders"] = """with c as (select l_orderkey s, l_quantity v, count(*) n, min(l_linenumber * 1000 + l_partkey) o from lineitem group by 1, 2),
t as (select s, count(*) d, arg_max(v, (n, -o)) v, max(n) n from c group by 1), a as (select *, case when d = 1 or n >= 2 then v end g from t)
select d distinct_values, d - (g is not null)::int alternatives, count(*) sheets, sum(g) agreed from a group by 1, 2"""


def circular(spark, sf):
    c = table(spark, sf, "lineitem").selectExpr("l_orderkey as page_id", "l_linenumber * 10000 + l_partkey as claim_id", "l_quantity as size", "case when l_suppkey % 3 = 0 then l_quantity when l_suppkey % 3 = 1 then cast(l_partkey % 50 + 1 as double) end as basis")
    return cov.circular_basis(c).groupBy("code").agg(F.count(F.lit(1)).alias("claims"))


QUERIES["circular_basis_lineitem"] = circular
ORACLES["circular_basis_lineitem"] = """with c as (select l_orderkey p, l_linenumber * 10000 + l_partkey id, l_quantity s, case when l_suppkey % 3 = 0 then l_quantity when l_suppkey % 3 = 1 then (l_partkey % 50 + 1)::double end b from lineitem),
h as (select p, id, bool_or(abs(b - s) <= 1e-9) own from c where b is not null and exists(select 1 from c o where o.p = c.p and abs(o.s - c.b) <= 1e-9) group by 1, 2)
select case when own then 'basis_is_own_size' else 'basis_is_evaluated_size' end code, count(*) claims from h group by 1"""


def detector(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select((F.col("n_chars") > 1500).alias("predicted"), (F.col("quality") == 1).alias("truth"), "lang")
    return cov.detector_score(d, "predicted", "truth", ["lang"]).select("lang", "tp", "fp", "fn", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"))


QUERIES["detector_score_labels"] = detector
ORACLES["detector_score_labels"] = """with d as (select lang, n_chars > 1500 p, quality = 1 t from labels join documents using (doc_id)), c as (select lang, count(*) filter (p and t) tp, count(*) filter (p and not t) fp, count(*) filter (not p and t) fn from d group by 1)
select *, round(tp / nullif(tp + fp, 0), 4) as precision, round(tp / nullif(tp + fn, 0), 4) recall from c"""


def separable(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select((F.col("quality") == 1).alias("good"), "n_chars", F.length("lang").alias("lang_len"), (F.col("n_chars") % 97).alias("rest"))
    return cov.separability(d, ["n_chars", "rest"], "good").select("feature", F.round("median_gap", 3).alias("median_gap"), F.round("separability", 4).alias("separability"))


QUERIES["feature_separability_labels"] = separable
ORACLES["feature_separability_labels"] = """with d as (select quality = 1 g, n_chars::double a, (n_chars % 97)::double b from labels join documents using (doc_id))
select 'n_chars' feature, round(median(a) filter (g) - median(a) filter (not g), 3) median_gap, round(abs(median(a) filter (g) - median(a) filter (not g)) / stddev_pop(a), 4) separability from d
union all select 'rest', round(median(b) filter (g) - median(b) filter (not g), 3), round(abs(median(b) filter (g) - median(b) filter (not g)) / stddev_pop(b), 4) from d"""


def evidence_levels(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("l_suppkey as sheet_id", "l_partkey as geometry_id", "l_quantity as value")
    c = table(spark, sf, "part").selectExpr("p_partkey % 100 as sheet_id", "p_partkey as geometry_id", "cast(p_size as double) as printed_mm")
    return cov.evidence_level(d, c, _printed(spark, sf)).groupBy("sheet_id", "level").agg(F.count(F.lit(1)).alias("decisions"))


QUERIES["evidence_levels_lineitem"] = evidence_levels
ORACLES["evidence_levels_lineitem"] = f"""with p as (select p_partkey % 100 s, p_partkey g, p_size::double v, p_size + case when p_partkey % 7 = 0 then 0.5::double else 0 end pv from part)
select l_suppkey sheet_id, case when exists(select 1 from p where s = l_suppkey and g = l_partkey and abs(l_quantity - v) <= greatest(0.05::double, 0.01::double * l_quantity)) then 'bound'
  when exists(select 1 from p where s = l_suppkey and abs(l_quantity - pv) <= greatest(0.005::double, 0.002::double * l_quantity)) then 'present' else 'absent' end as level, count(*) decisions from lineitem group by 1, 2"""


def point_levels(spark, sf):
    part = table(spark, sf, "part")
    circles = part.where("p_partkey % 2 = 0").selectExpr("p_partkey % 100 as sheet_id", "p_partkey as id", "cast(p_partkey % 61 as double) as cx", "cast(p_partkey % 43 as double) as cy")
    edges = part.where("p_partkey % 2 = 1").selectExpr("p_partkey % 100 as sheet_id", "p_partkey as id", "cast(p_partkey % 61 as double) as x0", "cast(p_partkey % 43 as double) as y0",
                                                       "cast(p_partkey % 61 + p_size as double) as x1", "cast(p_partkey % 43 + p_partkey % 13 as double) as y1")
    claims = part.selectExpr("p_partkey % 100 as sheet_id", "p_partkey as geometry_id", "cast(p_size as double) as printed_mm")
    d = table(spark, sf, "lineitem").selectExpr("l_suppkey % 100 as sheet_id", "case when l_linenumber < 7 then l_orderkey % 64 + 0.5D * (l_linenumber % 2) end as x", "cast(l_partkey % 45 as double) as y", "l_quantity as value")
    return cov.point_evidence(d, circles, edges, claims, _printed(spark, sf)).groupBy("sheet_id", "level").agg(F.count(F.lit(1)).alias("decisions"), F.sum("n_geometry").alias("n_geometry"))


QUERIES["point_evidence_lineitem"] = point_levels
ORACLES["point_evidence_lineitem"] = """with p as (select p_partkey % 100 s, p_partkey g, p_size::double v, p_size + case when p_partkey % 7 = 0 then 0.5::double else 0 end pv from part),
a as (select p_partkey % 100 s, p_partkey g, (p_partkey % 61)::double ax, (p_partkey % 43)::double ay from part
  union all select p_partkey % 100, p_partkey, p_partkey % 61 + p_size, p_partkey % 43 + p_partkey % 13 from part where p_partkey % 2 = 1),
d as (select l_suppkey % 100 s, case when l_linenumber < 7 then l_orderkey % 64 + 0.5::double * (l_linenumber % 2) end x, (l_partkey % 45)::double y, l_quantity v from lineitem),
q as (select distinct s, x, y, v from d),
f as (select distinct q.s, x, y, q.v, a.g from q join a on q.s = a.s and abs(ax - x) <= 2 and abs(ay - y) <= 2),
b as (select f.s, x, y, f.v, count(*) n, bool_or(abs(p.v - f.v) <= greatest(0.05::double, 0.01::double * f.v)) tied from f join p on p.s = f.s and p.g = f.g group by 1, 2, 3, 4),
k as (select q.s, v, bool_or(abs(pv - q.v) <= greatest(0.005::double, 0.002::double * q.v)) seen from (select distinct s, v q_v from q) z join q on q.s = z.s and q.v = z.q_v join (select distinct s ps, pv from p) on ps = q.s group by 1, 2)
select d.s sheet_id, case when tied then 'bound' when seen then 'present' else 'absent' end as level, count(*) decisions, sum(coalesce(n, 0))::bigint n_geometry
from d left join b on b.s = d.s and b.x is not distinct from d.x and b.y = d.y and b.v = d.v left join k on k.s = d.s and k.v = d.v group by 1, 2"""


def qa(spark, sf):
    li = table(spark, sf, "lineitem")
    lab = li.where("l_linenumber % 3 > 0").selectExpr("l_orderkey as part_id", "l_returnflag as role", "cast(l_linenumber as string) as text", "l_quantity as value_mm", "l_linestatus as datum")
    sheet = li.where("l_linenumber % 4 > 0").selectExpr("l_orderkey as part_id", "l_returnflag as role", "cast(l_linenumber as string) as text")
    spans = li.where("l_suppkey % 2 = 0").selectExpr("l_orderkey as part_id", "l_returnflag as role", "l_quantity + l_tax as drawn_mm", "l_linestatus as datum")
    return cov.qa_labels(lab, sheet, spans).groupBy("code").agg(F.count(F.lit(1)).alias("problems"))


QUERIES["label_agreement_lineitem"] = qa
ORACLES["label_agreement_lineitem"] = """with l as (select l_orderkey p, l_returnflag r, l_linenumber t, l_quantity v, l_linestatus d from lineitem where l_linenumber % 3 > 0), s as (select l_orderkey p, l_returnflag r, l_linenumber t from lineitem where l_linenumber % 4 > 0),
x as (select l_orderkey p, l_returnflag r, l_quantity + l_tax v, l_linestatus d from lineitem where l_suppkey % 2 = 0),
a as (select coalesce(l.p, s.p) p, coalesce(l.r, s.r) r, l.n ln, s.n sn, l.ts lt, s.ts st from (select p, r, count(*) n, list(t order by t) ts from l group by 1, 2) l full join (select p, r, count(*) n, list(t order by t) ts from s group by 1, 2) s on l.p = s.p and l.r = s.r),
c as (select p, r, case when sn is null then 'missing_on_sheet' when ln is null then 'unlabelled_number' when lt <> st then 'text_differs' end code from a
  union all select distinct l.p, l.r, 'value_differs' from l join x on l.p = x.p and l.r = x.r where abs(l.v - x.v) > 0.01::double union all select distinct l.p, l.r, 'datum_differs' from l join x on l.p = x.p and l.r = x.r where l.d <> x.d)
select code, count(*) problems from c where code is not null group by 1"""


def parts_compare(spark, sf):
    p = table(spark, sf, "part")
    mk = lambda d: p.select(F.col("p_partkey").alias("part_id"), F.lit(1).alias("solids"), F.lit(True).alias("valid"), F.array(F.col("p_size") + d, F.lit(20.0), F.col("p_partkey") % 30 + 0.0).alias("vector"),
                            (F.col("p_retailprice") * (1 + d / 10)).alias("volume"), F.array(F.col("p_size") / 2 + d, F.lit(4.0)).alias("cylinders"))
    return cov.compare_parts(mk((F.col("p_partkey") % 5) * 0.7), mk(F.lit(0.0))).groupBy("shape_ok", "detail_ok", "passed").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.size("missing_radii")).alias("missing"))


QUERIES["coarse_part_compare_parts"] = parts_compare
ORACLES["coarse_part_compare_parts"] = """with d as (select p_partkey % 5 * 0.7::double d, p_size s from part),
c as (select d <= greatest(1.0, 0.02::double * s) shape_ok, (abs(s / 2.0::double - 4) <= 0.5 or d <= 0.5) cyl, d / 10 <= 0.25::double vol from d)
select shape_ok, vol and cyl detail_ok, shape_ok and vol and cyl passed, count(*) parts, sum((not cyl)::int)::bigint missing from c group by 1, 2, 3"""


def reading_checks(spark, sf):
    c = table(spark, sf, "lineitem").selectExpr("l_suppkey as part_id", "l_orderkey * 8 + l_linenumber as span_id", "case l_linenumber % 3 when 0 then 'diameter' when 1 then 'radius' else 'distance' end as form", "l_quantity * 2 as printed_mm", "true as both_centres")
    y = table(spark, sf, "customer").selectExpr("c_custkey % 100 as part_id", "cast(c_custkey % 60 as double) as radius", "cast(c_custkey * 7919 % 211 as double) as x", "cast(c_custkey * 104729 % 199 as double) as y")
    checks, _ = cov.check_readings(c, y)
    # A part without two axes has no gap to check; the table counts its distances as not kept.
    unchecked = c.where("form = 'distance'").join(checks.where("form = 'distance'").select("part_id").distinct(), "part_id", "left_anti")
    checks = checks.unionByName(unchecked.select("part_id", "span_id", "form", F.lit(False).alias("ok")))
    return checks.groupBy("part_id", "form", "ok").agg(F.count(F.lit(1)).alias("checks"))


QUERIES["reading_checks_lineitem"] = reading_checks
ORACLES["reading_checks_lineitem"] = """with c as (select l_suppkey part_id, case l_linenumber % 3 when 0 then 'diameter' when 1 then 'radius' else 'distance' end form, case l_linenumber % 3 when 0 then l_quantity else l_quantity * 2 end w from lineitem),
y as (select c_custkey % 100 part_id, (c_custkey % 60)::double r, (c_custkey * 7919 % 211)::double x, (c_custkey * 104729 % 199)::double y from customer),
g as (select a.part_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) g from y a join y b on a.part_id = b.part_id and (a.x, a.y) <> (b.x, b.y)),
k as (select c.*, case when form = 'distance' then exists(select 1 from g where g.part_id = c.part_id and abs(g.g - c.w) <= greatest(0.01::double * c.w, 0.5)) else exists(select 1 from y where y.part_id = c.part_id and abs(y.r - c.w) <= greatest(0.01::double * c.w, 0.5)) end ok from c)
select part_id, form, ok, count(*) checks from k group by 1, 2, 3"""

# Solid features: the first numbers of an embedding, scaled to a part.
_E = "cast(round(embedding[{i}] * 100, 1) as double)"


def _features(spark, sf, shift=0.0):
    e = table(spark, sf, "embeddings").withColumn("part_id", F.expr("vec_id div 5")).withColumn("ord", F.col("vec_id"))
    v = lambda i: F.round(F.col("embedding")[i].cast("double") * 40, 1)
    moved = F.when(F.col("vec_id") % 4 == 0, shift).otherwise(shift / 100)
    return e.select("part_id", "ord", F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("id"), F.lit("hole").alias("kind"), ((F.col("label") % 4) + 5.0 + F.when(F.col("vec_id") % 7 == 0, shift / 5).otherwise(0.0)).alias("diameter_mm"),
                    F.array(v(0) + moved, v(1), v(2)).alias("centre"), F.array(v(0) + moved, v(1), v(2)).alias("axis_point"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("axis_direction"),
                    (F.col("vec_id") % 3 > 0).alias("through"), F.when(F.col("vec_id") % 3 == 0, 4.0 + F.when(F.col("vec_id") % 2 == 0, shift).otherwise(0.0)).alias("depth_mm"))


def feature_pairs(spark, sf):
    pairs, extras, missing = solids.pair_features(_features(spark, sf, 1.0), _features(spark, sf).where("ord % 11 > 0"), ["part_id"])
    issues = solids.feature_issues(pairs, ["part_id"])
    tag = lambda df, n: df.groupBy("part_id").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(n))
    return tag(pairs, "pairs").unionByName(tag(extras, "extras")).unionByName(tag(missing, "missing")).unionByName(issues.groupBy("part_id", F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n")))


_FEAT_SQL = """e as (select vec_id div_id, vec_id // 5 part_id, vec_id ord, label % 4 + 5.0::double d0, round(embedding[1]::double * 40, 1) x, round(embedding[2]::double * 40, 1) y, round(embedding[3]::double * 40, 1) z, vec_id % 3 > 0 thr from embeddings),
p as (select *, x + case when ord % 4 = 0 then 1.0 else 0.01::double end px, d0 + case when ord % 7 = 0 then 0.2::double else 0 end pd, case when not thr then 4.0 + (ord % 2 = 0)::int end dep from e),
t as (select *, case when not thr then 4.0 end dep from e where ord % 11 > 0),
c as (select p.part_id, t.ord t_ord, p.ord p_ord, sqrt((px - t.x) ** 2 + (p.y - t.y) ** 2 + (p.z - t.z) ** 2) gap, abs(pd - t.d0) dd, p.thr pth, t.thr tth, p.dep pdep, t.dep tdep, px - t.x dx, p.y - t.y dy from p join t using (part_id)),
ed as (select *, row_number() over (partition by part_id order by gap + dd, t_ord, p_ord) rn from c where gap <= 8 and dd <= 1),
walk as (select part_id, 0::bigint rn, []::bigint[] ts, []::bigint[] ps from (select distinct part_id from ed) union all
  select w.part_id, e.rn, case when list_contains(ts, t_ord) or list_contains(ps, p_ord) then ts else list_append(ts, t_ord) end, case when list_contains(ts, t_ord) or list_contains(ps, p_ord) then ps else list_append(ps, p_ord) end
  from walk w join ed e on w.part_id = e.part_id and e.rn = w.rn + 1),
fin as (select part_id, arg_max(ts, rn) ts, arg_max(ps, rn) ps from walk group by 1), pk as (select part_id, unnest(ts) t_ord, unnest(ps) p_ord from fin), pr as (select ed.* from ed join pk using (part_id, t_ord, p_ord))"""
QUERIES["feature_pairing_embeddings"] = feature_pairs
ORACLES["feature_pairing_embeddings"] = f"""with recursive {_FEAT_SQL}
select part_id, count(*) n, 'pairs' what from pr group by 1 union all select part_id, count(*), 'extras' from p where (part_id, ord) not in (select part_id, p_ord from pr) group by 1
union all select part_id, count(*), 'missing' from t where (part_id, ord) not in (select part_id, t_ord from pr) group by 1
union all select part_id, count(*), 'centre' from pr where sqrt(dx ** 2 + dy ** 2) > 0.05::double group by 1 union all select part_id, count(*), 'diameter' from pr where dd > 0.05::double group by 1
union all select part_id, count(*), 'through_blind' from pr where pth <> tth group by 1 union all select part_id, count(*), 'depth' from pr where not pth and not tth and abs(pdep - tdep) > 0.05::double group by 1"""


def alignments(spark, sf):
    truth = _features(spark, sf)
    swap = lambda c: F.array(-F.col(c)[1], F.col(c)[0], F.col(c)[2])
    produced = truth.withColumn("centre", swap("centre")).withColumn("axis_point", swap("axis_point")).withColumn("axis_direction", swap("axis_direction"))
    lim = lambda df, p, below, above: df.groupBy("part_id").agg(
        *[(F.min(F.col("centre")[i]) - below[i]).alias(f"{p}lo{i}") for i in range(3)], *[(F.max(F.col("centre")[i]) + above[i]).alias(f"{p}hi{i}") for i in range(3)])
    # The body reaches differently far beyond its holes on each side, so a part with a single hole has one pose, too.
    b = lim(produced, "p", (3.0, 1.0, 1.0), (1.0, 2.0, 4.0)).join(lim(truth, "t", (1.0, 1.0, 1.0), (2.0, 3.0, 4.0)), "part_id")
    arr = lambda p, n: F.array(*[F.col(f"{p}{n}{i}") for i in range(3)])
    boxes = b.select("part_id", arr("p", "lo").alias("p_min"), arr("p", "hi").alias("p_max"), arr("t", "lo").alias("t_min"), arr("t", "hi").alias("t_max"))
    return solids.align_features(produced, truth, boxes).select("part_id", "rotation", "extras", "missing", "issues")


QUERIES["alignment_search_embeddings"] = alignments
# Every part is turned by a quarter about z, so the one pose that undoes it must win without issues.
ORACLES["alignment_search_embeddings"] = "select distinct vec_id // 5 part_id, '102+-+' rotation, 0::bigint extras, 0::bigint missing, 0::bigint issues from embeddings"


def cylinder_groups(spark, sf):
    f = table(spark, sf, "lineitem").selectExpr("l_suppkey as part_id", "l_orderkey * 8 + l_linenumber as face_id", "l_linenumber / 2 as radius", "l_returnflag as axis_key", "l_linestatus = 'O' as inner", "cast(l_partkey as double) as lo", "l_partkey + l_quantity as hi")
    return solids.group_cylinders(f).groupBy("part_id", "axis_key", "inner").agg(F.count(F.lit(1)).alias("features"), F.sum("faces").alias("faces"))


QUERIES["cylinder_groups_lineitem"] = cylinder_groups
# Openers one after the other, by a recursive walk from each key's first span to the first one beyond it.
ORACLES["cylinder_groups_lineitem"] = """with recursive f as (select l_suppkey part_id, l_linenumber r, l_returnflag axis_key, l_linestatus = 'O' "inner", l_partkey::double lo, l_partkey + l_quantity hi, l_orderkey * 8 + l_linenumber id from lineitem),
pt as (select part_id, r, axis_key, "inner", lo, arg_min(hi, id) hi from f group by 1, 2, 3, 4, 5),
nx as materialized (select a.part_id, a.r, a.axis_key, a."inner", a.lo, min(b.lo) nxt from pt a join pt b on a.part_id = b.part_id and a.r = b.r and a.axis_key = b.axis_key and a."inner" = b."inner" and b.lo > a.hi group by 1, 2, 3, 4, 5),
op as (select part_id, r, axis_key, "inner", min(lo) lo from pt group by 1, 2, 3, 4
  union all select o.part_id, o.r, o.axis_key, o."inner", n.nxt from op o join nx n on o.part_id = n.part_id and o.r = n.r and o.axis_key = n.axis_key and o."inner" = n."inner" and o.lo = n.lo),
c as (select part_id, axis_key, "inner", count(*) features from op group by 1, 2, 3), n as (select part_id, axis_key, "inner", count(*) faces from f group by 1, 2, 3)
select part_id, axis_key, "inner", features, faces from c join n using (part_id, axis_key, "inner")"""


def verdict_rows(spark, sf):
    c = table(spark, sf, "lineitem").selectExpr("l_orderkey as part_id", "case l_linenumber when 1 then 'unmodelled' else concat('c', cast(l_linenumber as string)) end as name", "case when l_suppkey % 9 = 0 then null else l_suppkey % 5 > 0 end as ok", "l_linenumber > 2 as gating",
                                                "case when l_partkey % 97 = 0 then 'not_evaluated' end as override")
    return solids.part_verdict(c).groupBy("verdict").agg(F.count(F.lit(1)).alias("parts"), F.sum("failed_checks").alias("failed"))


QUERIES["part_verdicts_orders"] = verdict_rows
ORACLES["part_verdicts_orders"] = """with c as (select l_orderkey p, max(case when l_partkey % 97 = 0 then 'not_evaluated' end) o, count(*) filter (l_linenumber > 2 and not coalesce(l_suppkey % 9 <> 0 and l_suppkey % 5 > 0, false)) f,
  bool_or(l_linenumber = 1 and not (l_suppkey % 9 <> 0 and l_suppkey % 5 > 0)) un from lineitem group by 1)
select coalesce(o, case when f > 0 then 'fail' when un then 'not_evaluated' else 'pass' end) verdict, count(*) parts, sum(f)::bigint failed from c group by 1"""

# Ledgers from the event stream.
_CALLS = "select user_id run_id, event_type, ts, value from events"


def call_rollup(spark, sf):
    e = table(spark, sf, "events")
    calls = e.selectExpr("user_id as run_id", "case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'started' end as state", "case when event_type <> 'view' then event_type end as kind",
                         "value > 50 as image_attached", "cast(value as int) % 7 as images_in_request", "case when event_type = 'purchase' then true end as server_ok")
    records = e.selectExpr("user_id as run_id", "user_id % 10 > 0 as readable").distinct()
    return ledger.merge_calls(calls, records)


QUERIES["call_rollup_events"] = call_rollup
ORACLES["call_rollup_events"] = """with c as (select user_id run_id, count(*) attempts, count(*) filter (event_type = 'purchase') completed, count(*) filter (event_type = 'error') failed, count(*) filter (event_type not in ('purchase', 'error')) unfinished,
  count(distinct nullif(event_type, 'view')) kinds, max(trunc(value)::int % 7) images_in_request, bool_or(value > 50) image_attached, count(*) filter (event_type = 'purchase') > 0 server_ok from events group by 1)
select run_id, case when run_id % 10 > 0 then attempts end attempts, case when run_id % 10 > 0 then completed end completed, case when run_id % 10 > 0 then failed end failed, case when run_id % 10 > 0 then unfinished end unfinished,
  case when run_id % 10 > 0 then kinds end kinds, case when run_id % 10 > 0 then images_in_request end images_in_request, case when run_id % 10 > 0 then image_attached end image_attached, case when run_id % 10 > 0 then server_ok end server_ok,
  case when run_id % 10 > 0 then true end inference_called from c"""


def traces(spark, sf):
    s = table(spark, sf, "events").selectExpr("user_id as part_id", "'a' as arm", "event_id as pos", "event_type as stage", "value < 60 as ok", "case when event_id % 3 = 0 then true when event_id % 3 = 1 then false end as ran")
    return ledger.stage_trace(s)[1].drop("arm")


QUERIES["stage_traces_events"] = traces
ORACLES["stage_traces_events"] = """with s as (select user_id part_id, event_id pos, event_type stage, value < 60 ok, case when event_id % 3 = 0 then true when event_id % 3 = 1 then false end ran from events),
b as (select *, coalesce(max((not ok and coalesce(ran, true))::int) over (partition by part_id order by pos rows between unbounded preceding and 1 preceding), 0) = 1 bl from s),
t as (select *, case when ok then 'completed' when coalesce(ran, false) then 'failed' when bl then 'blocked_by_previous' when ran = false then 'not_started' else 'failed' end st from b)
select part_id, arg_min(stage, pos) filter (not ok) first_divergence, arg_max(stage, pos) filter (st = 'failed') terminal_failure, arg_max(stage, pos) filter (st in ('completed', 'failed')) last_stage_reached,
  count(*) filter (st = 'completed') completed, count(*) filter (st = 'failed') failed, count(*) filter (st = 'not_started') not_started, count(*) filter (st = 'blocked_by_previous') blocked from t group by 1"""


def runs(spark, sf):
    r = table(spark, sf, "events").selectExpr("event_type as condition", "value as seconds", "'s' as status", "'e' as error_class")
    return ledger.run_summary(r)[0].select("condition", "cases", F.round("total_seconds", 2).alias("total_seconds"), "median_seconds")


QUERIES["run_summary_events"] = runs
ORACLES["run_summary_events"] = """with r as (select event_type condition, coalesce(value, 0) v, row_number() over (partition by event_type order by coalesce(value, 0)) rn, count(*) over (partition by event_type) n from events)
select condition, count(*) cases, round(sum(v), 2) total_seconds, max(v) filter (rn = n // 2 + 1) median_seconds from r group by 1"""


def chosen(spark, sf):
    expected = {f: "v2" for f in ledger.IDENTITY}
    man = F.struct(*[F.when(F.col("event_id") % (5 + i) == 0, "v1").otherwise("v2").alias(f) for i, f in enumerate(ledger.IDENTITY)])
    a = table(spark, sf, "events").select(F.col("user_id").alias("cell"), F.col("event_id").alias("attempt_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "pass").otherwise("failed").alias("state"),
                                          man.alias("manifest"), (F.col("event_id") % 13 > 0).alias("has_result"), (F.col("event_id") % 2 == 0).alias("parsed"))
    picked, ignored = ledger.select_attempts(a, expected)
    n = ignored.groupBy("cell").agg(F.count_if(F.col("ignored") == "orphan").alias("orphans"), F.count_if(F.col("ignored") != "orphan").alias("not_eligible"))
    return picked.join(n, "cell", "full").select("cell", "attempt_id", "state", "orphans", "not_eligible")


QUERIES["attempt_selection_events"] = chosen
_INEL = "(" + " or ".join(f"event_id % {5 + i} = 0" for i in range(5)) + ")"
ORACLES["attempt_selection_events"] = f"""with a as (select user_id cell, event_id, case event_type when 'purchase' then 'pass' else 'failed' end state, event_id % 13 > 0 res, {_INEL} inel, event_id % 2 = 0 parsed from events),
c as (select cell, arg_max(event_id, (state = 'pass' and parsed, event_id)) attempt_id, arg_max(state, (state = 'pass' and parsed, event_id)) state from a where res and not inel group by 1),
n as (select cell, count(*) filter (not res) orphans, count(*) filter (res and inel) not_eligible from a where not res or inel group by 1)
select cell, attempt_id, state, orphans, not_eligible from c full join n using (cell)"""


def frozen(spark, sf):
    m = table(spark, sf, "customer").selectExpr("c_custkey as case_id", "c_mktsegment as scope_class")
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg((F.max("o_totalprice") > 400000).alias("verdict_pass")).where("case_id % 4 > 0").withColumn("failure_codes", F.array(F.lit("x")))
    return ledger.frozen_rate(m, c)[0].select("scope_class", "cases", "evaluated", "correct", F.round("correct_rate", 3).alias("correct_rate"), F.round("conditional_rate", 3).alias("conditional_rate"))


QUERIES["frozen_rates_customers"] = frozen
ORACLES["frozen_rates_customers"] = """with c as (select o_custkey case_id, max(o_totalprice) > 400000 ok from orders where o_custkey % 4 > 0 group by 1), r as (select c_mktsegment scope_class, count(*) cases, count(ok) evaluated, count(*) filter (ok) correct from customer left join c on c_custkey = case_id group by 1)
select *, round(round(correct / cases, 4), 3) correct_rate, round(round(correct / nullif(evaluated, 0), 4), 3) conditional_rate from r"""


def drifted(spark, sf):
    p = table(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey as a", "c_mktsegment as b")
    m = p.where("c_custkey % 10 > 0").withColumn("a", F.when(F.col("c_custkey") % 7 == 0, F.col("a") + 1).otherwise(F.col("a"))).withColumn("b", F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise(F.col("b")))
    return ledger.drift(p.where("c_custkey % 8 > 0"), m, ["c_custkey"], ["a", "b"]).groupBy("drift", F.array_join("columns", ",").alias("columns")).agg(F.count(F.lit(1)).alias("rows"))


QUERIES["table_drift_customers"] = drifted
ORACLES["table_drift_customers"] = """with c as (select c_custkey k, c_custkey % 8 > 0 p, c_custkey % 10 > 0 m, c_custkey % 7 = 0 a, c_custkey % 9 = 0 b from customer),
d as (select case when p and not m then 'not_measured' when m and not p then 'not_published' when p and m and (a or b) then 'differs' end drift, case when p and m then concat_ws(',', case when a then 'a' end, case when b then 'b' end) when m and b then 'a' else 'a,b' end as columns from c)
select drift, columns, count(*) as rows from d where drift is not null group by 1, 2"""


def splits(spark, sf):
    parts = table(spark, sf, "part").selectExpr("p_partkey as part_id", "p_type as family")
    clean, out = ledger.quarantine(ledger.split_by_family(parts, ["ECONOMY", "PROMO"]), table(spark, sf, "lineitem").where("l_quantity > 49").selectExpr("l_partkey as part_id", "l_returnflag as reason").distinct())
    return clean.groupBy("split").agg(F.count(F.lit(1)).alias("parts")).unionByName(out.groupBy(F.concat(F.lit("q_"), "reason").alias("split")).agg(F.count(F.lit(1)).alias("parts")))


QUERIES["family_split_quarantine_parts"] = splits
ORACLES["family_split_quarantine_parts"] = """with q as (select distinct l_partkey k, l_returnflag r from lineitem where l_quantity > 49)
select case when p_type in ('ECONOMY', 'PROMO') then 'held_out' else 'train' end split, count(*) parts from part where p_partkey not in (select k from q) group by 1 union all select 'q_' || r, count(*) from q join part on k = p_partkey group by r"""


def revisions(spark, sf):
    log = table(spark, sf, "events").selectExpr("user_id as k", "event_id % 50 as revision", "event_type as text", "cast(value as int) % 3 as flag")
    return ledger.latest_revision(log, ["k"], ["text", "flag"]).select("k", "revision", "conflict")


QUERIES["latest_revisions_events"] = revisions
ORACLES["latest_revisions_events"] = """with l as (select user_id k, event_id % 50 revision, event_type t, trunc(value)::int % 3 f from events), m as (select k, max(revision) revision from l group by 1)
select k, revision, count(distinct (t, f)) > 1 as conflict from l join m using (k, revision) group by 1, 2"""


def changes(spark, sf):
    log = table(spark, sf, "events").selectExpr("user_id as k", "event_id as revision", "event_type as text", "cast(value as int) % 3 as flag", "'u' as actor")
    return ledger.field_changes(log, ["k"], ["text", "flag"]).groupBy("k", "field").agg(F.count(F.lit(1)).alias("changes"))


QUERIES["field_changes_events"] = changes
ORACLES["field_changes_events"] = """with l as (select user_id k, event_type t, trunc(value)::int % 3 f, lag(event_id) over w p, lag(event_type) over w pt, lag(trunc(value)::int % 3) over w pf from events window w as (partition by user_id order by event_id))
select k, 'text' field, count(*) changes from l where p is not null and t is distinct from pt group by 1 union all select k, 'flag', count(*) from l where p is not null and f is distinct from pf group by 1"""


def jobs(spark, sf):
    j = table(spark, sf, "orders").selectExpr("concat('k', cast(o_orderkey % 4000 as string)) as idempotency_key", "case when o_orderstatus = 'P' then o_orderpriority end as blocked_by")
    r = table(spark, sf, "lineitem").selectExpr("concat('k', cast(l_orderkey % 4000 as string)) as idempotency_key", "case when l_quantity > 30 then 'completed' else 'failed' end as state")
    return ledger.job_report(j, r)


QUERIES["job_report_orders"] = jobs
ORACLES["job_report_orders"] = """with r as (select distinct l_orderkey % 4000 k from lineitem where l_quantity > 30), j as (select case when r.k is not null then 'cached' when o_orderstatus = 'P' then 'blocked' else 'pending' end status, o_orderpriority b from orders left join r on o_orderkey % 4000 = r.k)
select status, case when status = 'blocked' then b end reason, count(*) jobs from j group by 1, 2"""


def cells(spark, sf):
    m = table(spark, sf, "customer").selectExpr("c_custkey as page_id", "c_mktsegment as arm")
    a = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).selectExpr("o_custkey as page_id", "c_mktsegment as arm", "case o_orderstatus when 'F' then 'pass' when 'O' then 'failed' else 'started' end as state").where("page_id % 3 > 0")
    return ledger.dispositions(m, a).groupBy("arm", "disposition").agg(F.count(F.lit(1)).alias("cells"), F.sum("attempts").alias("attempts"))


QUERIES["cell_dispositions_customers"] = cells
ORACLES["cell_dispositions_customers"] = """with a as (select o_custkey k, count(*) n, bool_or(o_orderstatus = 'F') p, bool_or(o_orderstatus = 'O') f from orders where o_custkey % 3 > 0 group by 1)
select c_mktsegment arm, case when n is null then 'not_run' when p then 'passed' when f then 'failed' else 'unfinished' end disposition, count(*) cells, sum(coalesce(n, 0))::bigint attempts from customer left join a on k = c_custkey group by 1, 2"""


def uses(spark, sf):
    r = table(spark, sf, "lineitem").selectExpr("l_linestatus as arm", "l_partkey as part_id", "l_suppkey % 20 = 0 as quarantined", "case when l_linenumber % 4 > 0 then l_quantity > 25 end as passed")
    return ledger.training_decision(ledger.classify_rows(r))


QUERIES["row_use_decision_lineitem"] = uses
ORACLES["row_use_decision_lineitem"] = """with u as (select l_linestatus arm, l_partkey p, case when l_suppkey % 20 = 0 then 'excluded' when l_linenumber % 4 = 0 then 'unknown' when l_quantity > 25 then 'positive' else 'negative' end u from lineitem),
t as (select arm, count(*) as rows, count(distinct case when u = 'positive' then p end) positive_parts, count(distinct case when u = 'negative' then p end) negative_parts, count(*) filter (u = 'unknown') as unknown, count(*) filter (u = 'excluded') excluded from u group by 1)
select *, case when positive_parts + negative_parts >= 10 and positive_parts > 0 and negative_parts > 0 then 'train' else 'collect_more' end decision from t"""


def budgets(spark, sf):
    return ledger.budget(table(spark, sf, "events").selectExpr("event_type as phase", "value > 20 as dispatched").where("dispatched is not null"))


QUERIES["call_budget_events"] = budgets
ORACLES["call_budget_events"] = "select event_type phase, count(*) filter (value > 20) dispatched, count(*) filter (value <= 20) held from events where value is not null group by 1"


def lab(spark, sf):
    r = table(spark, sf, "lineitem").selectExpr("l_returnflag as arm", "l_partkey as part_id", "case when l_linenumber % 3 > 0 then l_quantity > 10 end as called", "l_tax > 0.02 as built")
    return ledger.lab_summary(r, ["called", "built"], ["arm"])


QUERIES["attempt_summary_lineitem"] = lab
ORACLES["attempt_summary_lineitem"] = """select l_returnflag arm, count(*) attempts, count(distinct l_partkey) unique_parts, count(*) filter (l_linenumber % 3 > 0 and l_quantity > 10) called, count(*) filter (l_linenumber % 3 = 0) called_unmeasured,
  count(*) filter (l_tax > 0.02::double) built, 0::bigint built_unmeasured from lineitem group by 1"""


def failures(spark, sf):
    s = F.array(F.struct(F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("ölçek yok"))).otherwise(F.array().cast("array<string>")).alias("refusals"), (F.col("o_orderkey") % 3).cast("int").alias("exit_code"), F.when(F.col("o_orderkey") % 5 == 0, "x\nCadFailure: y").otherwise("a\nbellek doldu").alias("stderr_tail")))
    r = table(spark, sf, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.when(F.col("o_orderkey") % 2 == 0, "pass").otherwise("fail")).alias("verdict"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("units"))).otherwise(F.array(F.lit("holes"))).alias("failed_checks"), s.alias("steps"))
    return ledger.failure_class(r).groupBy("o_orderstatus", "failure_layer").agg(F.count(F.lit(1)).alias("runs"))


QUERIES["failure_layers_orders"] = failures
ORACLES["failure_layers_orders"] = """with k as (select o_orderstatus, o_orderkey o from orders)
select o_orderstatus, case when o % 7 = 0 then case when o % 2 = 0 then 'pass' when o % 3 = 0 then 'calibration' else 'binding' end when o % 4 = 0 then 'calibration' when o % 3 = 0 then 'input' when o % 5 = 0 then 'cad' else 'resources' end failure_layer, count(*) runs from k group by 1, 2"""
QUERIES["coverage_by_class_lineitem"] = class_coverage
ORACLES["coverage_by_class_lineitem"] = """with u as (select l_suppkey s, (l_orderkey * 8 + l_linenumber) % 3 st, case l_linenumber % 4 when 0 then 'diameter_callout' when 1 then 'radius' when 2 then 'diameter' else 'linear' end c, l_quantity v from lineitem)
select s sheet_id, c as class, count(*) filter (st = 0) kept, count(*) filter (st = 1) unpaired, count(*) filter (st = 2) not_accounted,
  count(*) filter (st = 1 and (s, v) in (select s, v from u where st = 0)) hidden_by_equal_value from u group by 1, 2"""
