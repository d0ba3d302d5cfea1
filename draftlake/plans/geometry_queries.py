"""Registered geometry queries over proxy relations: points, strokes, circles and contours from key residues."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlake.operators import binding, claims, coverage, geometry_tables as gt, graph
from draftlake.operators.scan import top_k
from draftlake.plans.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

ANCHORS = {
    "sheet_id": "c_custkey % 25", "span_id": "c_custkey", "k": "0", "ax": "cast(c_custkey * 7919 % 1009 as double)", "ay": "cast(c_custkey * 104729 % 1013 as double)",
    "ox": "cast(case when c_custkey % 3 = 0 then c_custkey * 7919 % 1009 else (c_custkey * 7919 + 240) % 1009 end as double)",
    "oy": "cast(case when c_custkey % 3 = 1 then c_custkey * 104729 % 1013 else (c_custkey * 104729 + 130) % 1013 end as double)",
}
STROKES = {
    "sheet_id": "o_orderkey % 25", "geometry_id": "concat('g', cast(o_orderkey as string))", "ord": "o_orderkey",
    "x0": "cast(o_orderkey * 611953 % 1009 as double)", "y0": "cast(o_orderkey * 224737 % 1013 as double)",
    "x1": "cast(o_orderkey * 350377 % 1009 as double)", "y1": "cast(o_orderkey * 746773 % 1013 as double)",
}
CIRCLES = {
    "sheet_id": "p_partkey % 25", "geometry_id": "concat('c', cast(p_partkey as string))", "ord": "p_partkey", "kind": "case when p_partkey % 4 = 0 then 'arc' else 'circle' end",
    "cx": "cast(p_partkey * 7919 % 1009 as double)", "cy": "cast(p_partkey * 104729 % 1013 as double)", "r": "cast(p_size + 3 as double)",
}
_sql = lambda d: ", ".join(f"{e} as {n}" for n, e in d.items())
_df = lambda spark, sf, name, d: table(spark, sf, name).selectExpr(*[f"{e} as {n}" for n, e in d.items()])
BASE_SQL = f"""an as (select {_sql(ANCHORS)} from customer), st as (select {_sql(STROKES)} from orders), ci as (select {_sql(CIRCLES)} from part)"""


def _strokes(spark, sf):
    s = _df(spark, sf, "orders", STROKES)
    return s.withColumn("points", F.array(F.array("x0", "y0"), F.array("x1", "y1"))).drop("x0", "y0", "x1", "y1")


def strokes_at_anchors(spark, sf):
    a = binding.attach_strokes(_df(spark, sf, "customer", ANCHORS), _strokes(spark, sf))
    return a.select("sheet_id", "span_id", "geometry_id", "role", "far_x", "far_y")


_SD = """(case when x0 = x1 and y0 = y1 then sqrt((ax - x0) ** 2 + (ay - y0) ** 2) else
 sqrt((x0 + least(greatest(((ax - x0) * (x1 - x0) + (ay - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2), 0), 1) * (x1 - x0) - ax) ** 2
    + (y0 + least(greatest(((ax - x0) * (x1 - x0) + (ay - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2), 0), 1) * (y1 - y0) - ay) ** 2) end)"""
QUERIES["anchor_strokes_orders"] = strokes_at_anchors
ORACLES["anchor_strokes_orders"] = f"""with {BASE_SQL},
j as (select *, sqrt((ax - x0) ** 2 + (ay - y0) ** 2) d0, sqrt((ax - x1) ** 2 + (ay - y1) ** 2) d1, {_SD} body from an join st using (sheet_id)),
f as (select *, case when d0 > d1 then x0 else x1 end far_x, case when d0 > d1 then y0 else y1 end far_y from j where least(d0, d1) <= 3.5 or body <= 3.5)
select sheet_id, span_id, geometry_id, case when least(d0, d1) > 3.5 then 'crossing' when sqrt((far_x - ox) ** 2 + (far_y - oy) ** 2) <= 3.5 then 'row' else 'stub' end as role, far_x, far_y from f"""


def _points(spark, sf):
    own = _df(spark, sf, "orders", STROKES).select("sheet_id", "geometry_id", F.col("ord").alias("o"), F.inline(F.array(
        F.struct(F.lit(0).alias("n"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("n"), F.col("x1").alias("x"), F.col("y1").alias("y")))))
    arcs = _df(spark, sf, "part", CIRCLES).select("sheet_id", "geometry_id", F.col("ord").alias("o"), F.lit(0).alias("n"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.concat("kind", F.lit("-centre")).alias("kind"))
    both = own.withColumn("kind", F.lit("line-end")).unionByName(arcs)
    return both.select("sheet_id", "geometry_id", F.struct(F.when(F.col("kind") == "line-end", 1).otherwise(0).alias("s"), "o", "n").alias("ord"), "kind", "x", "y")


_PTS_SQL = """pts as (select sheet_id, geometry_id, 'line-end' kind, x0 x, y0 y, (1, ord, 0) o from st union all select sheet_id, geometry_id, 'line-end', x1, y1, (1, ord, 1) from st
  union all select sheet_id, geometry_id, kind || '-centre', cx, cy, (0, ord, 0) from ci)"""


def features(spark, sf):
    sites = _df(spark, sf, "customer", ANCHORS).select(
        "sheet_id", "span_id", "k", F.lit(0).alias("pos"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit("anchor").alias("at"), F.array().cast("array<string>").alias("chain"), F.array().cast("array<string>").alias("exclude"))
    f = binding.features_at(sites, _df(spark, sf, "part", CIRCLES), _points(spark, sf))
    return f.select("sheet_id", "span_id", "geometry_id", "kind", "site_rank", F.round("distance_px", 2).alias("distance_px"))


QUERIES["features_at_sites_parts"] = features
ORACLES["features_at_sites_parts"] = f"""with {BASE_SQL}, {_PTS_SQL},
r as (select a.sheet_id, span_id, geometry_id, sqrt((ax - cx) ** 2 + (ay - cy) ** 2) d, r, kind, ord from an a join ci using (sheet_id)),
h as (select sheet_id, span_id, geometry_id, kind || case when d <= 4 then '-centre' else '-rim' end kind, round(case when d <= 4 then d else abs(d - r) end, 2) px, (0, (0, ord, 0)) o from r where d <= 4 or (abs(d - r) <= 4 and d > 0)
  union all select a.sheet_id, span_id, geometry_id, kind, round(sqrt((ax - x) ** 2 + (ay - y) ** 2), 2), (1, o) from an a join pts using (sheet_id) where kind <> 'circle-centre' and sqrt((ax - x) ** 2 + (ay - y) ** 2) <= 4)
select sheet_id, span_id, geometry_id, kind, site_rank, px distance_px from (select *, row_number() over (partition by sheet_id, span_id order by px, o) site_rank from h) where site_rank <= 4"""


def aligned(spark, sf):
    a = _df(spark, sf, "customer", ANCHORS).withColumn("exclude", F.array().cast("array<string>"))
    f = binding.aligned_at(a, _points(spark, sf))
    return f.select("sheet_id", "span_id", "geometry_id", "kind", "aligned_rank", F.round("perpendicular_px", 2).alias("perpendicular_px"))


QUERIES["aligned_candidates_parts"] = aligned
ORACLES["aligned_candidates_parts"] = f"""with {BASE_SQL}, {_PTS_SQL},
u as (select *, (ox - ax) / sqrt((ox - ax) ** 2 + (oy - ay) ** 2) ux, (oy - ay) / sqrt((ox - ax) ** 2 + (oy - ay) ** 2) uy from an where ox <> ax or oy <> ay),
j as (select u.*, p.geometry_id, p.kind, p.x, p.y, p.o, (x - ax) * ux + (y - ay) * uy al, round(abs((y - ay) * ux - (x - ax) * uy), 2) perp, abs((y - ay) * ux - (x - ax) * uy) rp,
  case kind when 'circle-centre' then 0 when 'arc-centre' then 1 else 4 end rk from u join pts p using (sheet_id)),
g as (select *, row_number() over (partition by sheet_id, span_id, round_even(x / 2, 0), round_even(y / 2, 0) order by rk, perp, o) gi from j where abs(al) <= 3 and rp > 4),
k as (select *, row_number() over (partition by sheet_id, span_id order by rk, perp, o) aligned_rank from g where gi = 1)
select sheet_id, span_id, geometry_id, kind, aligned_rank, perp perpendicular_px from k where aligned_rank <= 8"""


def counts_near(spark, sf):
    spans = _df(spark, sf, "customer", ANCHORS).select("sheet_id", "span_id", F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(10.0).alias("w"), F.lit(4.0).alias("h"))
    texts = _df(spark, sf, "part", CIRCLES).select("sheet_id", "ord", F.concat((F.col("ord") % 9 + 1).cast("string"), F.when(F.col("ord") % 5 == 0, " x").otherwise(" mm")).alias("text"),
                                                   F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(6.0).alias("w"), F.lit(4.0).alias("h"))
    return claims.count_near(spans, texts)


QUERIES["nearest_count_note_parts"] = counts_near
ORACLES["nearest_count_note_parts"] = f"""with {BASE_SQL},
j as (select a.sheet_id, span_id, ord, sqrt((ax + 5 - cx - 3) ** 2 + (ay - cy) ** 2) d from an a join ci using (sheet_id) where ord % 5 = 0)
select sheet_id, span_id, arg_min(ord % 9 + 1, (d, ord)) count from j where d <= 260 group by 1, 2"""


def nearest(spark, sf):
    pts = _df(spark, sf, "customer", ANCHORS).select("sheet_id", "span_id", F.col("ax").alias("x"), F.col("ay").alias("y"))
    m = _df(spark, sf, "part", CIRCLES).select("sheet_id", "ord", "geometry_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    return coverage.nearest_id(pts, m, 120.0).select("sheet_id", "span_id", "geometry_id", F.round("distance", 4).alias("distance"))


QUERIES["nearest_geometry_customers"] = nearest
ORACLES["nearest_geometry_customers"] = f"""with {BASE_SQL},
j as (select a.sheet_id, span_id, geometry_id, ord, sqrt((ax - cx) ** 2 + (ay - cy) ** 2) d from an a join ci using (sheet_id)),
b as (select sheet_id, span_id, arg_min(geometry_id, (d, ord)) geometry_id, round(min(d), 4) distance from j where d <= 120 group by 1, 2)
select an.sheet_id, an.span_id, geometry_id, distance from an left join b using (sheet_id, span_id)"""


def size_matches(spark, sf):
    spans = table(spark, sf, "supplier").selectExpr("s_suppkey % 25 as sheet_id", "s_suppkey as span_id", "cast(s_suppkey % 40 + 4 as double) as value", "'mm' as unit", "case s_suppkey % 2 when 0 then 'diameter' else 'radius' end as form")
    scales = spans.select("sheet_id").distinct().withColumn("px_per_mm", 1.0 + F.col("sheet_id") % 4 * 0.5)
    none = spans.limit(0).selectExpr("sheet_id", "span_id", "cast(null as string) as geometry_id")
    anchors = spans.selectExpr("sheet_id", "span_id", "cast(span_id * 37 % 1009 as double) as ax", "cast(span_id * 53 % 1013 as double) as ay")
    c, _ = claims.size_claims(spans, {"features": none, "aligned": none, "anchors": anchors}, _df(spark, sf, "part", CIRCLES), scales)
    return c.select("sheet_id", "span_id", "form", "first_id", "first_kind", "covered", F.round("deviation_mm", 2).alias("deviation_mm"))


QUERIES["size_claims_parts"] = size_matches
ORACLES["size_claims_parts"] = f"""with {BASE_SQL},
sp as (select s_suppkey % 25 sheet_id, s_suppkey span_id, (s_suppkey % 40 + 4)::double v, case s_suppkey % 2 when 0 then 'diameter' else 'radius' end form, 1.0::double + (s_suppkey % 25) % 4 * 0.5::double s from supplier),
m as (select sp.*, geometry_id, kind, ord, case form when 'diameter' then 2.0 else 1.0 end * r / s drawn, sqrt((span_id * 37 % 1009 - cx) ** 2 + (span_id * 53 % 1013 - cy) ** 2) d from sp join ci using (sheet_id)),
k as (select * from m where abs(drawn - v) <= greatest(0.03::double * v, 0.15))
select sheet_id, span_id, form, arg_min(geometry_id, (d, ord)) first_id, arg_min(kind, (d, ord)) || '-centre' first_kind, count(*) covered, round(abs(round(arg_min(abs(drawn - v), (d, ord)), 2)), 2) deviation_mm from k group by 1, 2, 3"""

CHARS = {
    "sheet_id": "o_custkey % 40", "ord": "o_orderkey", "char": "cast(o_orderkey % 10 as string)",
    "left": "cast(o_orderkey % 400 * 4 + o_orderkey % 7 as double)", "bottom": "cast(o_orderkey % 3 * 2 as double)",
    "right": "cast(o_orderkey % 400 * 4 + o_orderkey % 7 + 60 as double)", "top": "cast(o_orderkey % 3 * 2 + 90 + o_orderkey % 5 as double)",
}


def phrases(spark, sf):
    return gt.group_phrases(_df(spark, sf, "orders", CHARS)).select("sheet_id", "phrase_no", "text", "left", "right", "bottom", "top", "chars")


def _gap(axis):
    s, e, lo, hi = ('"left"', '"right"', "bottom", "top") if axis == "row" else ("bottom", "top", '"left"', '"right"')
    p = lambda c: "p" + c.strip('"')
    gap = f"greatest(0, greatest({p(s)}, {s}) - least({p(e)}, {e}))"
    ea, eb = f"({p(hi)} - {p(lo)})", f"({hi} - {lo})"
    return gap, f"greatest({ea}, {eb})", f"({gap} <= 0.9::double * greatest({ea}, {eb}) and least({p(hi)}, {hi}) - greatest({p(lo)}, {lo}) > 0.5 * least({ea}, {eb}))"


_RG, _RB, _RA = _gap("row")
_CG, _CB, _CA = _gap("col")
QUERIES["phrase_grouping_orders"] = phrases
ORACLES["phrase_grouping_orders"] = f"""with ch as (select {', '.join(f'{e} as "{n}"' for n, e in CHARS.items())} from orders),
l as (select *, lag("left") over w pleft, lag("right") over w pright, lag(bottom) over w pbottom, lag(top) over w ptop from ch window w as (partition by sheet_id order by ord)),
a as (select *, coalesce({_RA} or {_CA}, false) j, case when {_RA} then {_RG} > 0.3::double * {_RB} else {_CG} > 0.3::double * {_CB} end sp from l),
s as (select *, sum(case when j then 0 else 1 end) over (partition by sheet_id order by ord) phrase_no from a)
select sheet_id, phrase_no::bigint phrase_no, string_agg(case when j and coalesce(sp, false) then ' ' else '' end || "char", '' order by ord) as text, min("left") as "left", max("right") as "right",
  min(bottom) bottom, max(top) top, count(*) chars from s group by 1, 2"""


def intervals(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_suppkey as sheet_id", "cast(l_partkey as double) as low", "l_partkey + l_quantity % 4 as high")
    return gt.merge_intervals(li, ["sheet_id"], 2.0).select("sheet_id", "interval_no", "low", "high", "members")


QUERIES["interval_merge_lineitem"] = intervals
ORACLES["interval_merge_lineitem"] = """with b as (select l_suppkey sheet_id, l_partkey::double low, max(l_partkey + l_quantity % 4) high, count(*) n from lineitem group by 1, 2),
t as (select *, max(high) over (partition by sheet_id order by low rows between unbounded preceding and 1 preceding) top from b),
g as (select *, sum(case when top is null or low - top > 2 then 1 else 0 end) over (partition by sheet_id order by low) interval_no from t)
select sheet_id, interval_no::bigint interval_no, min(low) low, max(high) high, sum(n)::bigint members from g group by 1, 2"""

WORDS = {
    "sheet_id": "o_custkey % 30", "ord": "o_orderkey", "text": "case when o_orderkey % 4 = 0 then concat(cast(o_orderkey % 90 as string), 'Ø') else cast(o_orderkey % 100 as string) end",
    "left": "cast(o_orderkey * 7919 % 900 as double)", "top": "cast(o_orderkey * 104729 % 700 as double)", "width": "cast(o_orderkey % 20 + 8 as double)", "height": "cast(o_orderkey % 4 + 2 as double)",
    "confidence": "cast(o_orderkey % 100 as double)",
}


def word_phrases(spark, sf):
    p = gt.words_to_phrases(_df(spark, sf, "orders", WORDS))
    return p.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("phrases"), F.sum("words").alias("words"), F.max("words").alias("longest"), F.sum("w").alias("width"), F.sum("confidence").alias("confidence"))


QUERIES["words_to_phrases_orders"] = word_phrases
ORACLES["words_to_phrases_orders"] = f"""with recursive w as (select {', '.join(f'{e} as "{n}"' for n, e in WORDS.items())} from orders),
m as (select *, top + height / 2 mid from w),
pt as (select sheet_id, mid, arg_min(height, ("left", ord)) h from m group by 1, 2),
nx as materialized (select a.sheet_id, a.mid, min(b.mid) nxt from pt a join pt b on a.sheet_id = b.sheet_id and b.mid > a.mid + 0.6::double * a.h group by 1, 2),
op as (select sheet_id, min(mid) mid from pt group by 1 union all select o.sheet_id, n.nxt from op o join nx n on o.sheet_id = n.sheet_id and o.mid = n.mid),
n as (select m.*, op.mid ln from m asof join op on m.sheet_id = op.sheet_id and m.mid >= op.mid),
p as (select *, lag("left") over z pl, lag(width) over z pw, lag(height) over z ph2 from n window z as (partition by sheet_id, ln order by "left", ord)),
q as (select *, sum(case when pl is null or "left" - (pl + pw) > 1.5 * greatest(height, ph2) then 1 else 0 end) over (partition by sheet_id, ln order by "left", ord) pn from p),
r as (select sheet_id, ln, pn, count(*) words, max("left" + width) - min("left") w, min(confidence) c from q group by 1, 2, 3)
select sheet_id, count(*) phrases, sum(words)::bigint words, max(words) longest, sum(w) width, sum(c) confidence from r group by 1"""


def line_numbers(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_suppkey as sheet_id", "l_orderkey * 8 + l_linenumber as ord", "l_partkey as id", "l_quantity as w", "cast(l_linenumber as double) as h",
                                                 "array(array(cast(l_partkey % 300 as double), cast(l_orderkey % 90 as double)), array(cast(l_partkey % 300 + 40 as double), cast(l_orderkey % 90 as double))) as anchors")
    kept = gt.one_per_line(li)
    return kept.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("w") * F.col("h")).alias("area"))


QUERIES["one_number_per_line_lineitem"] = line_numbers
ORACLES["one_number_per_line_lineitem"] = """with l as (select l_suppkey sheet_id, l_quantity * l_linenumber area, row_number() over (partition by l_suppkey, round_even((l_partkey % 300) / 8.0::double, 0), round_even((l_orderkey % 90) / 8.0::double, 0),
  round_even((l_partkey % 300 + 40) / 8.0::double, 0) order by l_quantity * l_linenumber desc, l_orderkey * 8 + l_linenumber) rn from lineitem)
select sheet_id, count(*) kept, sum(area) area from l where rn = 1 group by 1"""


def ranked(spark, sf):
    c = _df(spark, sf, "part", CIRCLES)
    return top_k(c, ["sheet_id"], [-F.col("r"), F.col("ord")], 5, "place").select("sheet_id", "geometry_id", "place", "r")


QUERIES["top_k_largest_circles_parts"] = ranked
ORACLES["top_k_largest_circles_parts"] = f"with {BASE_SQL} select * from (select sheet_id, geometry_id, row_number() over (partition by sheet_id order by r desc, ord) place, r from ci) where place <= 5"


def fitted(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    arc = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array(
        (F.col("k") % 500) + (F.col("s") + 4 + F.when((F.col("k") % 6 == 0) & (i == 7), 3.0).otherwise(0.0)) * F.cos(i * (F.col("k") % 5 + 1) * 0.08),
        (F.col("k") % 300) + (F.col("s") + 4 + F.when((F.col("k") % 6 == 0) & (i == 7), 3.0).otherwise(0.0)) * F.sin(i * (F.col("k") % 5 + 1) * 0.08)))
    line = F.array(F.array(F.col("k").cast("double"), F.lit(1.0)), F.array(F.lit(2.0), F.col("s").cast("double")))
    paths = p.select((F.col("k") % 25).alias("sheet_id"), F.col("k").alias("id"), F.col("k").alias("ord"), F.lit(False).alias("closed"), F.when(F.col("k") % 7 == 0, line).otherwise(arc).alias("points"))
    return gt.fit_primitives(paths).select("path_id", "kind", F.round("cx", 1).alias("cx"), F.round("cy", 1).alias("cy"), F.round("r", 1).alias("r"), F.round(F.abs(F.col("end_degrees") - F.col("start_degrees")), 0).alias("sweep"))


QUERIES["fitted_primitives_parts"] = fitted
ORACLES["fitted_primitives_parts"] = """with q as (select p_partkey k, p_size s from part),
r as (select *, case when k % 7 = 0 then 'line' when k % 6 = 0 then null when 15 * (k % 5 + 1) * 0.08 * 180 / pi() >= 355 then 'circle' else 'arc' end kind from q)
select k path_id, kind, case when kind <> 'line' then (k % 500)::double end cx, case when kind <> 'line' then (k % 300)::double end cy, case when kind <> 'line' then (s + 4)::double end r,
  case when kind <> 'line' then round(15 * (k % 5 + 1) * 0.08 * 180 / pi(), 0) end sweep from r where kind is not null"""

# Polygons: the parts of an order in line order are its corners.
_POLY = """cn as (select l_orderkey profile_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 pos, count(*) over (partition by l_orderkey) n,
  (l_partkey * 31 % 97)::double x, (l_suppkey * 17 % 89)::double y from lineitem),
ed as (select a.profile_id, a.pos, a.n, a.x x0, a.y y0, b.x x1, b.y y1 from cn a join cn b on a.profile_id = b.profile_id and b.pos = (a.pos + 1) % a.n)"""


def _polygons(spark, sf):
    from pyspark.sql import Window as W

    # An order has a handful of line items.
    w = W.partitionBy("l_orderkey")
    li = table(spark, sf, "lineitem").withColumn("pos", F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1)
    c = li.select(F.col("l_orderkey").alias("profile_id"), "pos", (F.col("l_partkey") * 31 % 97).cast("double").alias("x"), (F.col("l_suppkey") * 17 % 89).cast("double").alias("y"))
    n = c.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
    nxt = c.select("profile_id", F.col("pos").alias("np"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    e = c.join(n, "profile_id").withColumn("np", (F.col("pos") + 1) % F.col("n")).join(nxt, ["profile_id", "np"])
    null = F.lit(None).cast("double")
    return e.select("profile_id", "pos", F.col("pos").cast("string").alias("id"), F.lit("line").alias("kind"), F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1",
                    *[null.alias(c) for c in ("cx", "cy", "r", "a", "b")])


def contour_issues(spark, sf):
    return gt.audit_contours(_polygons(spark, sf), ["profile_id"]).groupBy("profile_id", "kind").agg(F.count(F.lit(1)).alias("issues"))


_DEN = "((p.x0 - p.x1) * (q.y0 - q.y1) - (p.y0 - p.y1) * (q.x0 - q.x1))"
_T = f"(((p.x0 - q.x0) * (q.y0 - q.y1) - (p.y0 - q.y0) * (q.x0 - q.x1)) / {_DEN})"
_U = f"(((p.x0 - q.x0) * (p.y0 - p.y1) - (p.y0 - q.y0) * (p.x0 - p.x1)) / {_DEN})"
_on = lambda px, py, s: f"""(({s}.x1 - {s}.x0) ** 2 + ({s}.y1 - {s}.y0) ** 2 > 0 and (({px} - {s}.x0) * ({s}.x1 - {s}.x0) + ({py} - {s}.y0) * ({s}.y1 - {s}.y0)) / sqrt(({s}.x1 - {s}.x0) ** 2 + ({s}.y1 - {s}.y0) ** 2) > 0.5
 and (({px} - {s}.x0) * ({s}.x1 - {s}.x0) + ({py} - {s}.y0) * ({s}.y1 - {s}.y0)) / sqrt(({s}.x1 - {s}.x0) ** 2 + ({s}.y1 - {s}.y0) ** 2) < sqrt(({s}.x1 - {s}.x0) ** 2 + ({s}.y1 - {s}.y0) ** 2) - 0.5
 and abs(({px} - {s}.x0) * ({s}.y1 - {s}.y0) - ({py} - {s}.y0) * ({s}.x1 - {s}.x0)) / sqrt(({s}.x1 - {s}.x0) ** 2 + ({s}.y1 - {s}.y0) ** 2) <= 0.5)"""
_near = lambda s: f"least(sqrt((mx - {s}x0) ** 2 + (my - {s}y0) ** 2), sqrt((mx - {s}x1) ** 2 + (my - {s}y1) ** 2)) <= 0.5"
QUERIES["contour_audit_orders"] = contour_issues
ORACLES["contour_audit_orders"] = f"""with {_POLY},
pr as (select p.profile_id, q.pos = p.pos + 1 or (p.pos = 0 and q.pos = p.n - 1) adj, p.x0 px0, p.y0 py0, p.x1 px1, p.y1 py1, q.x0 qx0, q.y0 qy0, q.x1 qx1, q.y1 qy1,
  case when abs({_DEN}) >= 1e-12 and {_T} between -1e-9 and 1 + 1e-9 and {_U} between -1e-9 and 1 + 1e-9 then p.x0 + least(greatest({_T}, 0), 1) * (p.x1 - p.x0) end mx,
  case when abs({_DEN}) >= 1e-12 and {_T} between -1e-9 and 1 + 1e-9 and {_U} between -1e-9 and 1 + 1e-9 then p.y0 + least(greatest({_T}, 0), 1) * (p.y1 - p.y0) end my,
  {_on('p.x0', 'p.y0', 'q')}::int + {_on('p.x1', 'p.y1', 'q')}::int + {_on('q.x0', 'q.y0', 'p')}::int + {_on('q.x1', 'q.y1', 'p')}::int touch,
  sqrt((p.x1 - p.x0) ** 2 + (p.y1 - p.y0) ** 2) pl, sqrt((q.x1 - q.x0) ** 2 + (q.y1 - q.y0) ** 2) ql
  from ed p join ed q on p.profile_id = q.profile_id and p.pos < q.pos),
ov as (select *, (px1 - px0) / pl ux, (py1 - py0) / pl uy from pr where pl >= 1e-9 and ql >= 1e-9),
o2 as (select *, ux * (qx0 - px0) + uy * (qy0 - py0) t0, ux * (qx1 - px0) + uy * (qy1 - py0) t1 from ov),
ar as (select profile_id, sum(x0 * y1 - x1 * y0) / 2 area from ed group by 1 having count(*) > 1),
al as (select profile_id, 'zero_length' kind from ed where sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) <= 0.5
  union all select profile_id, 'self_intersection' from pr where mx is not null and not (adj and {_near('p')} and {_near('q')})
  union all select profile_id, 'endpoint_touch' from (select profile_id, unnest(range(touch)) from pr where not adj)
  union all select profile_id, 'overlap' from o2 where abs(ux * (qy1 - qy0) - uy * (qx1 - qx0)) <= 1e-3 * ql and abs(ux * (qy0 - py0) - uy * (qx0 - px0)) <= 1.0 and least(pl, greatest(t0, t1)) - greatest(0, least(t0, t1)) > 1.0
  union all select profile_id, 'zero_area' from ar where abs(area) <= 1)
select profile_id, kind, count(*) issues from al group by 1, 2"""


def turns(spark, sf):
    t = gt.edge_turns(_polygons(spark, sf), ["profile_id"])
    return t.select("profile_id", "pos", F.round("gap_px", 4).alias("gap_px"), F.round("turn_degrees", 2).alias("turn_degrees"))


QUERIES["edge_turns_orders"] = turns
ORACLES["edge_turns_orders"] = f"""with {_POLY}
select a.profile_id, a.pos, round(sqrt((b.x0 - a.x1) ** 2 + (b.y0 - a.y1) ** 2), 4) gap_px,
  round(degrees(acos(least(greatest(((a.x1 - a.x0) * (b.x1 - b.x0) + (a.y1 - a.y0) * (b.y1 - b.y0)) / nullif(sqrt((a.x1 - a.x0) ** 2 + (a.y1 - a.y0) ** 2) * sqrt((b.x1 - b.x0) ** 2 + (b.y1 - b.y0) ** 2), 0), -1), 1))), 2) turn_degrees
from ed a join ed b on a.profile_id = b.profile_id and b.pos = (a.pos + 1) % a.n"""


def shapes(spark, sf):
    s = gt.loop_shape(_polygons(spark, sf), ["profile_id"])
    return s.select("profile_id", "lines", "arcs", F.round("area", 3).alias("area"), "bx0", "by0", "bx1", "by1", "rounded_rectangle")


QUERIES["loop_shapes_orders"] = shapes
ORACLES["loop_shapes_orders"] = f"""with {_POLY} select profile_id, count(*) as lines, 0::bigint arcs, round(abs(sum(x0 * y1 - x1 * y0) / 2), 3) area, min(x0) bx0, min(y0) by0, max(x0) bx1, max(y0) by1, false rounded_rectangle from ed group by 1"""

# Sequential leader clustering, stated as a recursive walk with the list of leaders so far.
_lead = lambda src, cond: f"""it as (select *, row_number() over (partition by sheet_id order by ord) rn from {src}),
walk as (select sheet_id, 0::bigint rn, 0::bigint ord, 0::bigint leader, []::struct(o bigint, x double, y double, r double)[] ls from (select distinct sheet_id from it)
  union all select w.sheet_id, i.rn, i.ord, coalesce(list_min([l.o for l in ls if {cond}]), i.ord),
    case when len([l.o for l in ls if {cond}]) > 0 then ls else list_append(ls, {{'o': i.ord, 'x': i.cx, 'y': i.cy, 'r': i.r}}) end
  from walk w join it i on w.sheet_id = i.sheet_id and i.rn = w.rn + 1)"""
_CENTRED = {**CIRCLES, "cx": "cast(p_partkey * 7919 % 40 * 6 as double)", "cy": "cast(p_partkey * 104729 % 30 * 6 as double)", "r": "cast(p_size * 5 + 3 as double)"}


def families(spark, sf):
    return gt.circle_families(_df(spark, sf, "part", _CENTRED)).select("sheet_id", "ord", "family")


QUERIES["concentric_families_parts"] = families
ORACLES["concentric_families_parts"] = f"""with recursive cc as (select {_sql(_CENTRED)} from part), {_lead('cc', 'sqrt((i.cx - l.x) ** 2 + (i.cy - l.y) ** 2) <= greatest(2.0, 0.03::double * greatest(i.r, l.r))')}
select sheet_id, ord, leader family from walk where rn > 0"""


def size_groups(spark, sf):
    return gt.equal_diameters(_df(spark, sf, "part", _CENTRED)).select("sheet_id", "ord", "size_group")


QUERIES["equal_diameter_groups_parts"] = size_groups
ORACLES["equal_diameter_groups_parts"] = f"""with recursive cc as (select {_sql(_CENTRED)} from part), {_lead('cc', 'abs(i.r - l.r) <= 0.03::double * greatest(i.r, l.r)')}
select sheet_id, ord, leader size_group from walk where rn > 0"""


def rings(spark, sf):
    b = gt.bolt_rings(_df(spark, sf, "part", _CENTRED))
    return b.select("sheet_id", "family", "size_group", "holes", F.round("ring_radius_px", 3).alias("ring_radius_px"), F.round("spread", 4).alias("spread"))


QUERIES["bolt_rings_parts"] = rings
ORACLES["bolt_rings_parts"] = f"""with recursive cc as (select {_sql(_CENTRED)} from part),
{_lead('cc', 'sqrt((i.cx - l.x) ** 2 + (i.cy - l.y) ** 2) <= greatest(2.0, 0.03::double * greatest(i.r, l.r))')},
{_lead('cc', 'abs(i.r - l.r) <= 0.03::double * greatest(i.r, l.r)').replace('it as', 'it2 as').replace('walk', 'walk2').replace('from it)', 'from it2)').replace('join it i', 'join it2 i')},
sk as (select w.sheet_id, w.leader family, arg_min(cx, cc.ord) sx, arg_min(cy, cc.ord) sy from walk w join cc on cc.sheet_id = w.sheet_id and cc.ord = w.ord where rn > 0 group by 1, 2 having count(*) >= 3 and count(distinct round(2 * r, 1)) >= 3),
sg as (select w.sheet_id, w.leader size_group, cx, cy from walk2 w join cc on cc.sheet_id = w.sheet_id and cc.ord = w.ord where rn > 0 qualify count(*) over (partition by w.sheet_id, w.leader) >= 3),
d as (select sheet_id, family, size_group, sqrt((cx - sx) ** 2 + (cy - sy) ** 2) d from sk join sg using (sheet_id) where sqrt((cx - sx) ** 2 + (cy - sy) ** 2) > 1),
wn as (select a.sheet_id, a.family, a.size_group, a.d, count(*) holes, avg(b.d) m, max(b.d) - min(b.d) w from (select distinct * from d) a join d b on a.sheet_id = b.sheet_id and a.family = b.family and a.size_group = b.size_group and b.d >= a.d and b.d <= a.d * 1.05::double group by 1, 2, 3, 4)
select sheet_id, family, size_group, holes, round(m, 3) ring_radius_px, round(w / m, 4) spread from wn where holes >= 3 qualify row_number() over (partition by sheet_id, family, size_group order by holes desc, d) = 1"""

_W = "(p_size * 8 + 20)"
LOOPS = {
    "sheet_id": "p_partkey % 60", "loop_id": "p_partkey", "x0": "cast(p_partkey * 7919 % 700 as double)", "y0": "cast(p_partkey * 104729 % 500 as double)",
    "x1": f"cast(p_partkey * 7919 % 700 + case when p_partkey % 41 = 0 then 290 else {_W} end as double)", "y1": f"cast(p_partkey * 104729 % 500 + {_W} as double)"}
FRAME = "1000.0 as width, 700.0 as height"


def _loops(spark, sf):
    l = _df(spark, sf, "part", LOOPS)
    big = l.select("sheet_id").distinct().withColumn("loop_id", -F.col("sheet_id") - 1).withColumn("x0", F.lit(10.0)).withColumn("y0", F.lit(10.0)).withColumn(
        "x1", F.when(F.col("sheet_id") % 2 == 0, 990.0).otherwise(860.0)).withColumn("y1", F.when(F.col("sheet_id") % 2 == 0, 690.0).otherwise(600.0))
    return l.unionByName(big)


_LOOPS_SQL = f"lp as (select {_sql(LOOPS)} from part union all select distinct p_partkey % 60, -(p_partkey % 60) - 1, 10.0, 10.0, case when p_partkey % 60 % 2 = 0 then 990.0 else 860.0 end, case when p_partkey % 60 % 2 = 0 then 690.0 else 600.0 end from part)"


def _frames(df):
    return df.select("sheet_id").distinct().withColumn("width", F.lit(1000.0)).withColumn("height", F.lit(700.0))


def loop_classes(spark, sf):
    l = _loops(spark, sf)
    texts = table(spark, sf, "customer").selectExpr("c_custkey % 60 as sheet_id", "case when c_custkey % 3 = 0 then c_mktsegment else '12' end as text", "case when c_custkey % 3 = 0 then null else 12.0 end as value",
                                                    "cast(c_custkey * 31 % 900 as double) as x", "cast(c_custkey * 47 % 650 as double) as y", "10.0D as w", "6.0D as h")
    return gt.classify_loops(l, texts, _frames(l)).groupBy("sheet_id", "class").agg(F.count(F.lit(1)).alias("loops"), F.sum("loop_id").alias("ids"))


QUERIES["loop_classes_parts"] = loop_classes
ORACLES["loop_classes_parts"] = f"""with {_LOOPS_SQL},
tx as (select c_custkey % 60 sheet_id, c_custkey % 3 = 0 word, (c_custkey * 31 % 900)::double + 5 px, (c_custkey * 47 % 650)::double + 3 py from customer),
a as (select l.*, (x1 - x0) * (y1 - y0) / 700000 share, exists(select 1 from lp o where o.sheet_id = l.sheet_id and o.loop_id <> l.loop_id and l.x0 - 1 <= o.x0 and o.x1 <= l.x1 + 1 and l.y0 - 1 <= o.y0 and o.y1 <= l.y1 + 1) holds,
  (select count(*) from tx where tx.sheet_id = l.sheet_id and x0 < px and px < x1 and y0 < py and py < y1) n, (select count(*) from tx where tx.sheet_id = l.sheet_id and word and x0 < px and px < x1 and y0 < py and py < y1) w from lp l)
select sheet_id, case when share >= 0.8 or (share >= 0.6 and holds) then 'frame' when n >= 3 and w >= 0.5 * n then 'annotation' else 'part' end as class, count(*) loops, sum(loop_id)::bigint ids from a group by 1, 2"""


def view_owners(spark, sf):
    l = _loops(spark, sf)
    g = l.select("sheet_id", F.col("loop_id").alias("geometry_id"), "x0", "y0", "x1", "y1")
    v = l.where("loop_id % 3 = 0").select("sheet_id", F.col("loop_id").alias("view_id"), F.col("x0"), F.col("y0"), (F.col("x1") + 120).alias("x1"), (F.col("y1") + 90).alias("y1"))
    return gt.assign_views(g, v).groupBy("sheet_id", "view_id").agg(F.count(F.lit(1)).alias("geometries"))


QUERIES["view_ownership_parts"] = view_owners
ORACLES["view_ownership_parts"] = f"""with {_LOOPS_SQL},
c as (select g.sheet_id, g.loop_id, count(v.loop_id) n, min(v.loop_id) view_id from lp g left join lp v on v.sheet_id = g.sheet_id and v.loop_id % 3 = 0 and
  greatest(least(g.x1, v.x1 + 120) - greatest(g.x0, v.x0), 0) * greatest(least(g.y1, v.y1 + 90) - greatest(g.y0, v.y0), 0) / greatest((g.x1 - g.x0) * (g.y1 - g.y0), 1e-9) >= 0.95::double group by 1, 2)
select sheet_id, case when n = 1 then view_id end view_id, count(*) geometries from c group by 1, 2"""


def view_names(spark, sf):
    l = _df(spark, sf, "part", LOOPS)
    v = l.select("sheet_id", F.col("loop_id").alias("view_id"), F.col("loop_id").alias("ord"), (F.col("loop_id") % 23 == 0).alias("hatched"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    return gt.name_views(v, _frames(l)).select("sheet_id", "view_id", "kind")


QUERIES["view_names_parts"] = view_names
ORACLES["view_names_parts"] = f"""with {_LOOPS_SQL},
v as (select *, x1 - x0 w, y1 - y0 h, (x0 + x1) / 2 cx, (y0 + y1) / 2 cy, case when loop_id % 23 = 0 then 'section' when x0 > 550 and x1 - x0 < 450 then 'isometric' end fx from lp where loop_id > -1),
f as (select sheet_id, arg_max(loop_id, (cx < 620, cy, -loop_id)) fid, arg_max(cx, (cx < 620, cy, -loop_id)) fcx, arg_max(cy, (cx < 620, cy, -loop_id)) fcy, arg_max(w, (cx < 620, cy, -loop_id)) fw from v where fx is null group by 1)
select v.sheet_id, loop_id view_id, case when fx is not null then fx when loop_id = fid then 'front' when cx > fcx + 0.25 * fw then 'side' when cy < fcy - 20 then 'plan' else 'unknown' end kind from v left join f using (sheet_id)"""


def loop_rings(spark, sf):
    """Each part draws four strokes around its own box; residues drop one or add a diagonal."""
    l = _df(spark, sf, "part", LOOPS).withColumn("bx", (F.col("loop_id") * 2000).cast("double"))
    x0, y0, x1, y1 = F.col("bx") + F.col("x0"), F.col("y0"), F.col("bx") + F.col("x1"), F.col("y1")
    leg = lambda n, a, b, c, d: F.struct(F.lit(n).alias("leg"), a.alias("x0"), b.alias("y0"), (c + 0.3).alias("x1"), d.alias("y1"))
    legs = F.array_compact(F.array(leg(0, x0, y0, x1, y0), leg(1, x1, y0, x1, y1), leg(2, x1, y1, x0, y1), F.when(F.col("loop_id") % 7 > 0, leg(3, x0, y1, x0, y0)), F.when(F.col("loop_id") % 10 == 0, leg(4, x0, y0, x1, y1))))
    s = l.select("sheet_id", "loop_id", F.inline(legs)).select("sheet_id", F.concat_ws("-", "loop_id", "leg").alias("geometry_id"), "x0", "y0", "x1", "y1")
    loops, _ = graph.closed_loops(s, 3.0)
    return loops.groupBy("sheet_id", "state", "edges").agg(F.count(F.lit(1)).alias("loops"), F.round(F.sum("area"), 0).alias("area"))


QUERIES["closed_loops_parts"] = loop_rings
ORACLES["closed_loops_parts"] = f"""with l as (select {_sql(LOOPS)} from part),
s as (select *, case when loop_id % 10 = 0 then 'branchy' when loop_id % 7 = 0 then 'open' else 'ring' end state, 3 + (loop_id % 7 > 0)::int + (loop_id % 10 = 0)::int edges from l)
select sheet_id, state, edges::bigint edges, count(*) loops, round(sum(case when state = 'ring' then (x1 - x0) * (y1 - y0) end), 0) area from s group by 1, 2, 3"""

def branching(spark, sf):
    """Each part draws a box; residues leave a side out, add a diagonal, a leader that ends free, or a second box below on the same side."""
    l = _df(spark, sf, "part", LOOPS).withColumn("bx", (F.col("loop_id") * 2000).cast("double"))
    x0, y0, x1, y1, low = F.col("bx") + F.col("x0"), F.col("y0"), F.col("bx") + F.col("x1"), F.col("y1"), F.col("y0") - 30
    n = F.col("loop_id")
    leg = lambda k, a, b, c, d: F.struct(F.lit(k).alias("leg"), a.alias("x0"), b.alias("y0"), (c + 0.3).alias("x1"), d.alias("y1"))
    legs = [leg(0, x0, y0, x1, y0), leg(1, x1, y0, x1, y1), leg(2, x1, y1, x0, y1), F.when(n % 7 > 0, leg(3, x0, y1, x0, y0)), F.when((n % 10 == 0) & (n % 11 != 1), leg(4, x0, y0, x1, y1)), F.when(n % 3 == 0, leg(5, x1, y1, x1 + 30, y1 + 40))]
    legs += [F.when(n % 11 == 1, leg(k, *way)) for k, way in ((6, (x0, y0, x0, low)), (7, (x0, low, x1, low)), (8, (x1, low, x1, y0)))]
    s = l.select("sheet_id", "loop_id", F.inline(F.array_compact(F.array(*legs)))).select("sheet_id", F.concat_ws("-", "loop_id", "leg").alias("geometry_id"), "x0", "y0", "x1", "y1")
    loops, _ = graph.branching_loops(s, 3.0)
    return loops.groupBy("sheet_id", "edges").agg(F.count(F.lit(1)).alias("loops"), F.round(F.sum("area"), 0).alias("area"))


QUERIES["branching_loops_parts"] = branching
# What the residues leave closed: both boxes' outline, the box, the box below alone, or the triangle of two sides and the diagonal.
ORACLES["branching_loops_parts"] = f"""with l as (select {_sql(LOOPS)} from part),
k as (select *, loop_id % 7 > 0 as whole, loop_id % 11 = 1 as low, x1 - x0 w, y1 - y0 h from l),
c as (select sheet_id, case when whole and low then 6 when whole or low then 4 when loop_id % 10 = 0 then 3 end edges, case when whole and low then w * (h + 30) when whole then w * h when low then w * 30 else w * h / 2 end area from k)
select sheet_id, edges::bigint edges, count(*) loops, round(sum(area), 0) area from c where edges is not null group by 1, 2"""



def fragments(spark, sf):
    c = _df(spark, sf, "part", CIRCLES)
    l = _df(spark, sf, "orders", STROKES)
    return graph.drop_ring_fragments(l, c).groupBy("sheet_id").agg(F.count(F.lit(1)).alias("strokes"))


QUERIES["ring_fragments_orders"] = fragments
ORACLES["ring_fragments_orders"] = f"""with {BASE_SQL},
b as (select distinct st.sheet_id, st.geometry_id from st join ci using (sheet_id) where sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) <= 80 and abs(sqrt((x0 - cx) ** 2 + (y0 - cy) ** 2) - r) <= 7 and abs(sqrt((x1 - cx) ** 2 + (y1 - cy) ** 2) - r) <= 7
  and abs(sqrt(((x0 + x1) / 2 - cx) ** 2 + ((y0 + y1) / 2 - cy) ** 2) - r) <= 7)
select sheet_id, count(*) strokes from st where (sheet_id, geometry_id) not in (select sheet_id, geometry_id from b) group by 1"""


def constraints(spark, sf):
    """Orders of a customer as points on one axis; consecutive orders are tied by their price difference."""
    from pyspark.sql import Window as W

    # A customer has a handful of orders.
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.lag("o_orderkey").over(w).alias("prev"), F.lag("o_totalprice").over(w).alias("prev_price"), F.lag("o_orderkey", 2).over(w).alias("prev2"), F.lag("o_totalprice", 2).over(w).alias("prev2_price"), F.row_number().over(w).alias("rn"))
    pts = o.select(F.col("o_custkey").alias("sheet_id"), F.lit("x").alias("axis"), F.col("o_orderkey").alias("point_id"), F.col("o_totalprice").alias("trace"), (F.col("rn") == 1).alias("is_datum"))
    chain = o.where("prev is not null and o_orderkey % 5 > 0").select(F.col("o_custkey").alias("sheet_id"), F.lit("x").alias("axis"), (F.col("o_orderkey") * 2).alias("ord"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("id"),
                                                                     F.col("prev").alias("first"), F.col("o_orderkey").alias("second"), (F.col("o_totalprice") - F.col("prev_price")).alias("delta"))
    skip = o.where("prev2 is not null and o_orderkey % 3 = 0").select(F.col("o_custkey").alias("sheet_id"), F.lit("x").alias("axis"), (F.col("o_orderkey") * 2 + 1).alias("ord"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("id"),
                                                                     F.col("prev2").alias("first"), F.col("o_orderkey").alias("second"), (F.col("o_totalprice") - F.col("prev2_price") + F.when(F.col("o_orderkey") % 2 == 0, 0.0).otherwise(7.0)).alias("delta"))
    out = graph.propagate_constraints(pts, chain.unionByName(skip))
    return out["status"].groupBy("status").agg(F.count(F.lit(1)).alias("sheets"), F.sum("dof").alias("dof"), F.sum(F.col("conflicts") + F.col("redundant")).alias("closing"))


QUERIES["constraint_propagation_orders"] = constraints


def diffs(spark, sf):
    old = _df(spark, sf, "part", CIRCLES).select("sheet_id", "geometry_id", "kind", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("r").alias("size"))
    new = old.where("size % 9 > 0").withColumn("x", F.col("x") + F.when(F.col("size") % 4 == 0, 0.25).otherwise(0.0001)).withColumn("geometry_id", F.when(F.col("size") == 20, F.concat("geometry_id", F.lit("n"))).otherwise(F.col("geometry_id")))
    return gt.geometry_diff(old, new)[1]


QUERIES["geometry_diff_parts"] = diffs
ORACLES["geometry_diff_parts"] = f"""with {BASE_SQL},
c as (select sheet_id, r, r % 9 > 0 kept, r = 20 renamed, r % 4 = 0 moved from ci)
select sheet_id, count(*) filter (kept and renamed) added, count(*) filter (not kept or renamed) removed, count(*) filter (kept and not renamed and moved) changed, count(*) filter (kept and not renamed and not moved) same,
  count(*) filter (kept and not renamed and moved) moved from c group by 1"""


def checks(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_returnflag as name", "l_quantity as printed_mm", "l_quantity + l_tax * 10 - 0.4 as measured_mm")
    return gt.measurement_checks(li).groupBy("name", "ok").agg(F.count(F.lit(1)).alias("checks"), F.count("refusal").alias("refusals"))


QUERIES["measurement_checks_lineitem"] = checks
ORACLES["measurement_checks_lineitem"] = """with l as (select l_returnflag as name, abs(l_quantity + l_tax * 10 - 0.4 - l_quantity) <= greatest(0.01::double * l_quantity, 0.5) ok from lineitem)
select name, ok, count(*) checks, count(*) filter (not ok) refusals from l group by 1, 2"""


def reached(spark, sf):
    """A line item binds its part's circle on the sheet of its supplier, so only some meet the circle's own sheet."""
    f = _df(spark, sf, "part", CIRCLES).select("sheet_id", "geometry_id")
    b = table(spark, sf, "lineitem").selectExpr("l_suppkey % 25 as sheet_id", "concat('c', cast(l_partkey as string)) as first_id", "case when l_linenumber = 1 then concat('c', cast(l_orderkey as string)) end as second_id")
    return gt.unbound(f, b).groupBy("sheet_id").agg(F.count(F.lit(1)).alias("unbound"))


QUERIES["unbound_features_parts"] = reached
ORACLES["unbound_features_parts"] = f"""with {BASE_SQL}, b as (select l_suppkey % 25 s, 'c' || l_partkey id from lineitem union select l_suppkey % 25, 'c' || l_orderkey from lineitem where l_linenumber = 1)
select sheet_id, count(*) as unbound from ci where (sheet_id, geometry_id) not in (select s, id from b) group by 1"""


def evidence(spark, sf):
    prims = _df(spark, sf, "part", CIRCLES).select("sheet_id", F.col("geometry_id").alias("id"), "kind", *[F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.when(F.col("ord") % 6 > 0, F.col("cx")).alias("cx"), "cy", "r")
    texts = table(spark, sf, "customer").selectExpr("c_custkey % 25 as sheet_id", "concat('t', cast(c_custkey as string)) as id", "'linear' as kind", "case when c_custkey % 4 > 0 then c_mktsegment end as text", "case when c_custkey % 8 = 0 then 1.0D end as value",
                                                    "cast(c_custkey % 700 as double) as x", "cast(c_custkey % 500 as double) as y", "20.0D as w", "10.0D as h")
    rows, dropped = gt.evidence_table(prims, texts, _frames(prims))
    return rows.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("x1"), 3).alias("sum_x1")).join(dropped.groupBy("sheet_id").agg(F.sum("rows").alias("dropped")), "sheet_id", "left")


QUERIES["evidence_table_parts"] = evidence
ORACLES["evidence_table_parts"] = f"""with {BASE_SQL},
e as (select sheet_id, ord % 6 > 0 ok, round(least((cx + r) / 1000, 1), 4) x1 from ci union all select c_custkey % 25, c_custkey % 4 > 0 or c_custkey % 8 = 0, round((c_custkey % 700 + 20) / 1000.0::double, 4) from customer)
select sheet_id, count(*) filter (ok) as rows, round(sum(x1) filter (ok), 3) sum_x1, count(*) filter (not ok) dropped from e group by 1"""
