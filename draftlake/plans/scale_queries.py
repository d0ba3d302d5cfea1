"""Registered queries over the proxy readings (line items as dimension lines)."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlake.operators import scale
from draftlake.plans.common import READINGS_SQL, consensus_sql, readings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def scale_consensus(spark, sf):
    return scale.consensus(readings(spark, sf)).select(
        "sheet_id", F.round("px_per_mm", 6).alias("px_per_mm"), "samples", F.round("spread", 6).alias("spread"))


QUERIES["scale_consensus_lineitem"] = scale_consensus
ORACLES["scale_consensus_lineitem"] = f"""with {READINGS_SQL}, {consensus_sql('sheet_id', 3)}
select sheet_id, round(px_per_mm, 6) px_per_mm, samples, round(spread, 6) spread from cons"""


def scale_inliers(spark, sf):
    r = readings(spark, sf)
    return scale.inliers(r, scale.consensus(r)).groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("inliers"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


QUERIES["scale_inliers_lineitem"] = scale_inliers
ORACLES["scale_inliers_lineitem"] = f"""with {READINGS_SQL}, {consensus_sql('sheet_id', 3)}
select a.sheet_id, count(*) inliers, min(id) first_id, max(id) last_id
from readings a join cons_b b on a.sheet_id = b.sheet_id where abs(a.ratio / b.h - 1.0) <= 0.04::double group by 1"""


def scale_calibrate(spark, sf):
    return scale.calibrate(readings(spark, sf)).select(
        "sheet_id", F.round("px_per_mm", 6).alias("px_per_mm"), "samples", F.round("spread", 6).alias("spread"))


QUERIES["scale_trimmed_median_lineitem"] = scale_calibrate
ORACLES["scale_trimmed_median_lineitem"] = f"""with {READINGS_SQL},
a as (select *, row_number() over (partition by sheet_id order by ratio) pos, count(*) over (partition by sheet_id) n from readings),
m as (select sheet_id, max(ratio) filter (where pos = n // 2 + 1) middle, max(n) n from a group by 1 having max(n) >= 3),
k as (select r.*, m.middle, count(*) filter (where abs(r.ratio / m.middle - 1.0) <= 0.04::double) over (partition by r.sheet_id) n_near
  from readings r join m using (sheet_id)),
f as (select *, row_number() over (partition by sheet_id order by ratio) pos, count(*) over (partition by sheet_id) n
  from k where n_near < 3 or abs(ratio / middle - 1.0) <= 0.04::double)
select sheet_id, round(max(ratio) filter (where pos = n // 2 + 1), 6) px_per_mm, count(*) samples,
  round((max(ratio) - min(ratio)) / max(ratio) filter (where pos = n // 2 + 1), 6) spread from f group by 1"""


def scale_fit(spark, sf):
    rows = scale.fit_scale(readings(spark, sf), conflict_mm=10.0)
    return rows.groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(F.abs("error_mm") > 10.0).alias("conflicts"),
        F.round(F.max("px_per_mm"), 3).alias("px_per_mm"), F.round(F.max("error_mm"), 2).alias("worst_mm"))


QUERIES["scale_least_squares_lineitem"] = scale_fit
ORACLES["scale_least_squares_lineitem"] = f"""with {READINGS_SQL},
f as (select sheet_id, sum(length_px * value) / sum(value * value) px from readings group by 1),
r as (select sheet_id, px, length_px / px - value res from readings join f using (sheet_id))
select sheet_id, count(*) readings, count(*) filter (where abs(res) > 10.0) conflicts, round(max(px), 3) px_per_mm,
  round(max(res), 2) worst_mm from r group by 1"""


def scale_audit(spark, sf):
    _, suspects = scale.audit_scale(readings(spark, sf))
    return suspects.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("suspects"), F.min("id").alias("first_id"))


_DISAGREES = "abs(length_px - value * px_per_mm) > greatest(0.04::double * (value * px_per_mm), 2.5)"
QUERIES["scale_suspects_lineitem"] = scale_audit
ORACLES["scale_suspects_lineitem"] = f"""with {READINGS_SQL}, {consensus_sql('sheet_id', 3)}
select r.sheet_id, count(*) suspects, min(id) first_id from readings r join cons using (sheet_id) where {_DISAGREES} group by 1"""


def view_scale_rows(spark, sf):
    return scale.view_scales(readings(spark, sf)).select(
        "sheet_id", "view_id", "readings", F.round("px_per_mm", 4).alias("px_per_mm"), "samples", "own_scale")


QUERIES["view_scales_lineitem"] = view_scale_rows
ORACLES["view_scales_lineitem"] = f"""with {READINGS_SQL}, {consensus_sql('sheet_id', 3)},
{consensus_sql('sheet_id, view_id', 2, name='vc')}
select s.sheet_id, s.view_id, s.readings, round(v.px_per_mm, 4) px_per_mm, coalesce(v.samples, 0) samples,
  coalesce(abs(v.px_per_mm / c.px_per_mm - 1.0) > 0.04::double, false) own_scale
from (select sheet_id, view_id, count(*) readings from readings group by all) s
left join vc v using (sheet_id, view_id) left join cons c using (sheet_id)"""


def verdict(spark, sf):
    return scale.scale_verdict(readings(spark, sf)).select(
        "sheet_id", "readings", "usable_readings", F.round("px_per_mm", 4).alias("px_per_mm"), "samples", "suspects", "state")


QUERIES["scale_verdict_lineitem"] = verdict
ORACLES["scale_verdict_lineitem"] = f"""with {READINGS_SQL}, {consensus_sql('sheet_id', 3)},
s as (select sheet_id, count(*) n from readings group by 1),
b as (select r.sheet_id, count(*) n from readings r join cons using (sheet_id) where {_DISAGREES} group by 1)
select s.sheet_id, s.n readings, s.n usable_readings, round(c.px_per_mm, 4) px_per_mm, coalesce(c.samples, 0) samples,
  coalesce(b.n, 0) suspects,
  case when c.px_per_mm is null then 'uncalibrated' when b.n is null then 'calibrated' else 'calibrated_with_suspects' end state
from s left join cons c using (sheet_id) left join b using (sheet_id)"""


# Orders as small sheets, so that every verdict state occurs.
def _order_readings(spark, sf):
    return readings(spark, sf).withColumn("sheet_id", F.floor(F.col("ord") / 8).cast("long")).withColumn("ord", F.col("ord") * 1000 + F.col("value").cast("long"))


_ORDER_SQL = """readings as (select l_orderkey as sheet_id, (l_orderkey * 8 + l_linenumber) * 1000 + l_quantity::bigint as ord,
  l_quantity as value, l_extendedprice as length_px, l_extendedprice / l_quantity as ratio from lineitem)"""


def verdict_orders(spark, sf):
    return scale.scale_verdict(_order_readings(spark, sf)).groupBy("state", "usable_readings").agg(
        F.count(F.lit(1)).alias("sheets"), F.sum("suspects").alias("suspects"), F.sum("samples").alias("samples"))


QUERIES["scale_verdict_states_by_order"] = verdict_orders
ORACLES["scale_verdict_states_by_order"] = f"""with {_ORDER_SQL}, {consensus_sql('sheet_id', 3)},
s as (select sheet_id, count(*) n from readings group by 1),
b as (select r.sheet_id, count(*) n from readings r join cons using (sheet_id) where {_DISAGREES} group by 1),
q as (select *, row_number() over (order by ord, ratio) rn from readings),
g as (select distinct a.sheet_id from q a join q b on a.sheet_id = b.sheet_id and a.rn < b.rn
  where abs(b.ratio / a.ratio - 1.0) <= 0.04::double),
v as (select s.n, coalesce(c.samples, 0) samples, case when c.px_per_mm is null then 0 else coalesce(b.n, 0) end suspects,
  case when c.px_per_mm is not null and b.n is null then 'calibrated' when c.px_per_mm is not null then 'calibrated_with_suspects'
    when s.n >= 2 and g.sheet_id is null then 'contradictory' else 'uncalibrated' end state
  from s left join cons c using (sheet_id) left join b using (sheet_id) left join g using (sheet_id))
select state, n usable_readings, count(*) sheets, sum(suspects)::bigint suspects, sum(samples)::bigint samples from v group by 1, 2"""


def _witnesses(spark, sf):
    """Line items of an order, each part a reading with several candidate strokes."""
    return _order_readings(spark, sf).withColumn("sheet_id", F.col("sheet_id") % 500).withColumn("reading_id", F.col("value").cast("long"))


def witness_rows(spark, sf):
    return scale.witness_scale(_witnesses(spark, sf)).select(
        "sheet_id", F.round("px_per_mm", 6).alias("px_per_mm"), "samples", F.round("spread", 6).alias("spread"))


_WITNESS_SQL = """w as (select l_orderkey % 500 as sheet_id, (l_orderkey * 8 + l_linenumber) * 1000 + l_quantity::bigint as ord,
  l_quantity::bigint as reading_id, l_extendedprice / l_quantity as ratio from lineitem),
p as (select *, min(ord) over (partition by sheet_id, reading_id) ro from w)"""
QUERIES["witness_scale_lineitem"] = witness_rows
ORACLES["witness_scale_lineitem"] = f"""with {_WITNESS_SQL},
c as (select sheet_id, ratio, min((ro, ord)) pl from p group by 1, 2),
v as (select c.sheet_id, c.ratio, any_value(c.pl) pl, count(distinct p.reading_id) n, list(distinct p.reading_id) ids
  from c join p on c.sheet_id = p.sheet_id and c.ratio / (1 + 0.04::double) <= p.ratio and p.ratio <= c.ratio * (1 + 0.04::double) group by 1, 2),
b as (select * from (select *, row_number() over (partition by sheet_id order by n desc, pl) rn from v) where rn = 1 and n >= 3),
rival as (select distinct v.sheet_id from v join b on v.sheet_id = b.sheet_id where v.n >= b.n and not list_has_any(v.ids, b.ids)),
m as (select p.sheet_id, p.reading_id, arg_min(p.ratio, (abs(p.ratio - b.ratio), p.ord)) ratio
  from p join b on p.sheet_id = b.sheet_id and b.ratio / (1 + 0.04::double) <= p.ratio and p.ratio <= b.ratio * (1 + 0.04::double)
  where p.sheet_id not in (select sheet_id from rival) group by 1, 2),
o as (select *, row_number() over (partition by sheet_id order by ratio) pos, count(*) over (partition by sheet_id) n from m)
select sheet_id, round(max(ratio) filter (where pos = n // 2 + 1), 6) px_per_mm, count(*) samples,
  round((max(ratio) - min(ratio)) / max(ratio) filter (where pos = n // 2 + 1), 6) spread from o group by 1"""


def bootstrap_rows(spark, sf):
    pairs = scale.usable(_witnesses(spark, sf)).withColumn("stroke_id", F.col("ord") % 97)
    return scale.bootstrap_scale(pairs).select(
        "sheet_id", F.round("px_per_mm", 6).alias("px_per_mm"), "samples", F.round("spread", 6).alias("spread"))


QUERIES["bootstrap_scale_lineitem"] = bootstrap_rows
ORACLES["bootstrap_scale_lineitem"] = f"""with {_WITNESS_SQL},
c as (select sheet_id, ratio from p group by 1, 2),
v as (select c.sheet_id, c.ratio, count(distinct p.reading_id) n, count(distinct p.ord % 97) s, list(distinct p.reading_id) ids
  from c join p on c.sheet_id = p.sheet_id and c.ratio / (1 + 0.04::double) <= p.ratio and p.ratio <= c.ratio * (1 + 0.04::double) group by 1, 2),
b as (select * from (select *, row_number() over (partition by sheet_id order by n desc, s desc, ratio) rn from v) where rn = 1 and n >= 3 and s >= 3),
rival as (select distinct v.sheet_id from v join b on v.sheet_id = b.sheet_id where v.n >= b.n and not list_has_any(v.ids, b.ids)),
o as (select p.sheet_id, p.ratio, b.n bn, row_number() over (partition by p.sheet_id order by p.ratio) pos, count(*) over (partition by p.sheet_id) n
  from p join b on p.sheet_id = b.sheet_id and b.ratio / (1 + 0.04::double) <= p.ratio and p.ratio <= b.ratio * (1 + 0.04::double)
  where p.sheet_id not in (select sheet_id from rival))
select sheet_id, round(max(ratio) filter (where pos = n // 2 + 1), 6) px_per_mm, max(bn) samples,
  round((max(ratio) - min(ratio)) / max(ratio) filter (where pos = n // 2 + 1), 6) spread from o group by 1"""


def rejection_rows(spark, sf):
    r = readings(spark, sf).withColumn("text_id", F.col("value").cast("long"))
    frames = r.groupBy("sheet_id").agg(F.lit(60000.0).alias("width"), F.lit(45000.0).alias("height"))
    out = scale.scale_rejections(r, scale.consensus(r), frames)
    return out.select("sheet_id", "largest", "numbers", F.array_join("rejections", ",").alias("rejections"))


QUERIES["scale_rejections_lineitem"] = rejection_rows
ORACLES["scale_rejections_lineitem"] = f"""with {READINGS_SQL}, {consensus_sql('sheet_id', 3)},
x as (select r.sheet_id, max(value) largest, max(c.px_per_mm) px,
  count(distinct value) filter (where abs(r.ratio / b.h - 1.0) <= 0.04::double) numbers
  from readings r join cons c using (sheet_id) join cons_b b using (sheet_id) group by 1)
select sheet_id, largest, numbers, concat_ws(',', case when largest * px > 0.95 * sqrt(60000.0*60000.0 + 45000.0*45000.0) then 'longer_than_page' end,
  case when numbers < 3 then 'too_few_numbers' end) rejections from x"""


def text_heights(spark, sf):
    return scale.text_height(readings(spark, sf).withColumn("h", F.col("length_px"))).select(
        "sheet_id", F.round("text_height", 4).alias("text_height"))


QUERIES["text_height_median_lineitem"] = text_heights
ORACLES["text_height_median_lineitem"] = """select l_suppkey sheet_id, round(median(l_extendedprice), 4) text_height
from lineitem where l_extendedprice > 0 group by 1"""
