"""Registered queries of the text columns: printed callouts made from parts, and whole corpus texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftlake.functions import callouts, geometry, identity, regions, text, verdicts
from draftlake.operators import texts
from draftlake.plans.common import CALLOUT_SQL, callout_texts, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_WORDS = "thru|through|all|deep|typ|typical|c''bore|cbore|c''sink|csink|spotface|counterbore|countersink|eq|eqsp|pcd|ref"
DIM_SQL = rf"""{CALLOUT_SQL},
p as (select *, regexp_extract(text, '^\s*(\d{{1,2}})\s*(?:[xX×]\s*(\d{{1,2}}))?\s*(?:[-–]\s*|[xX×]\s*)[ØÖ⌀ΦRrCc\d]', 0) pre,
  regexp_extract(text, '^\s*(\d{{1,2}})\s*(?:[xX×]\s*(\d{{1,2}}))?\s*(?:[-–]\s*|[xX×]\s*)[ØÖ⌀ΦRrCc\d]', 1) c1,
  regexp_extract(text, '^\s*(\d{{1,2}})\s*(?:[xX×]\s*(\d{{1,2}}))?\s*(?:[-–]\s*|[xX×]\s*)[ØÖ⌀ΦRrCc\d]', 2) c2 from ct),
b as (select *, greatest(case when pre = '' then 1 else c1::int * coalesce(nullif(c2, '')::int, 1) end, 1) cnt,
  regexp_replace(trim(case when pre = '' then text else substr(text, length(pre)) end),
    '(?i)(\s+[.,;:]*({_WORDS})[.,;:]*)+$', '') head from p),
u as (select *, case when regexp_matches(head, '(?i)(^|[^A-Za-z])(inch|inches|in)($|[^A-Za-z])') or head like '%"%'
    or regexp_full_match(head, '\d+\s+\d+\s*/\s*\d+') then 'in' else 'mm' end unit,
  case when regexp_matches(head, '^[Rr]') then 'radius' when head like '%Ø%' then 'diameter' else 'linear' end knd,
  trim(regexp_replace(regexp_replace(regexp_replace(replace(head, ',', '.'), '[Ø"]', '', 'g'), '(?i)(^|[^A-Za-z])(in|mm)($|[^A-Za-z])', '\1\3', 'g'),
    '^[Rr](\d)', '\1')) raw from b),
v as (select *, case when regexp_matches(raw, '[A-Za-z]') or raw = '' then null
    when regexp_full_match(raw, '\d+ \d+/\d+') then split_part(raw, ' ', 1)::double + split_part(split_part(raw, ' ', 2), '/', 1)::double / split_part(raw, '/', 2)::double
    else try_cast(regexp_extract(replace(raw, ' ', ''), '(\.\d*|\d+(?:\.\d*)?)', 1) as double) end val from u)"""


def dimensions(spark, sf):
    d = text.extract_dimensions(callout_texts(spark, sf), "text")
    return d.select("id", F.col("dim_count").cast("int").alias("dim_count"), "dim_kind", "dim_value", "dim_unit")


QUERIES["dimension_extraction_parts"] = dimensions
ORACLES["dimension_extraction_parts"] = f"""with {DIM_SQL}
select id, cnt dim_count, case when val is null then 'text' else knd end dim_kind, val dim_value, unit dim_unit from v"""


def count_profile(spark, sf):
    d = callout_texts(spark, sf)
    return d.groupBy(text.count_prefix(F.col("text")).cast("int").alias("printed_count")).agg(F.count(F.lit(1)).alias("texts"))


QUERIES["count_prefix_profile_parts"] = count_profile
ORACLES["count_prefix_profile_parts"] = f"with {DIM_SQL} select cnt printed_count, count(*) texts from v group by 1"


def sheet_units(spark, sf):
    d = text.extract_dimensions(callout_texts(spark, sf), "text").withColumnsRenamed({"dim_value": "value", "dim_unit": "unit"})
    d = text.apply_sheet_unit(d)
    return d.groupBy("sheet_id", "unit").agg(F.count(F.lit(1)).alias("readings"), F.count("value").alias("valued"))


QUERIES["sheet_unit_parts"] = sheet_units
ORACLES["sheet_unit_parts"] = f"""with {DIM_SQL},
s as (select sheet_id, val, unit, bool_or(unit = 'in' and val is not null) over (partition by sheet_id) inch from v)
select sheet_id, case when inch and unit = 'mm' and val is not null then 'in' else unit end unit, count(*) readings, count(val) valued
from s group by 1, 2"""

CALLOUT_PARSE_SQL = rf"""{CALLOUT_SQL},
tl as (select id, sheet_unit, text, regexp_extract_all(text, 'Ø|\d+(?:[.,]\d+)?|\.\d+|[A-Za-z]+|"|\S') toks from ct),
tk as (select id, generate_subscripts(toks, 1) - 1 i, unnest(toks) raw from tl),
k1 as (select *, case when raw = 'Ø' then 'diameter' when upper(raw) = 'R' then 'radius'
  when regexp_full_match(raw, '\d+(?:[.,]\d+)?|\.\d+') then 'number' when upper(raw) = 'X' then 'times'
  when upper(raw) in ('THRU', 'THROUGH') then 'thru' when upper(raw) = 'ALL' then 'all'
  when upper(raw) in ('DEEP', 'DEPTH') then 'depthword' when upper(raw) = 'MM' then 'mm'
  when upper(raw) in ('IN', 'INCH', 'INCHES', '"') then 'inch' when regexp_full_match(raw, '[A-Za-z]+') then 'word' else 'other' end k from tk),
k2 as (select *, lag(k) over w pk, coalesce(lead(k) over w, '') nk,
  case when k = 'number' and not regexp_full_match(raw, '\d+,\d{{3}}') then replace(raw, ',', '.')::double end v
  from k1 window w as (partition by id order by i)),
sym as (select id, count(*) nsym, min(i) anchor, arg_min(k, i) symk from k2 where k in ('diameter', 'radius') group by id),
unit as (select id, count(*) nunit, case arg_min(k, i) when 'mm' then 'mm' else 'in' end u from k2 where k in ('mm', 'inch') group by id),
cnt as (select id, count(*) filter (where v >= 1 and v = floor(v)) ngood, arg_min(v, i) filter (where v >= 1 and v = floor(v)) c,
  bool_or(v < 1 or v <> floor(v)) badc from k2 where k = 'number' and nk = 'times' group by id),
dw as (select distinct id from k2 where k = 'depthword'),
f0 as (select k2.id, i, v, row_number() over (partition by k2.id order by abs(i - anchor), (i < anchor)) rn, sym.id is not null hs
  from k2 left join sym using (id) where k = 'number' and v is not null and nk <> 'times'),
pick as (select id, v from f0 where hs and rn = 1),
f1 as (select f.*, exists(select 1 from k2 d where d.id = f.id and d.k = 'depthword' and d.i = f.i - 1) aft,
  exists(select 1 from k2 d where d.id = f.id and d.k = 'depthword' and d.i = f.i + 1) bef from f0 f where not (hs and rn = 1)),
f2 as (select *, bool_or(aft) over (partition by id) anya from f1),
near as (select id, count(*) nn, min(v) nv, min(i) ni from f2 where case when anya then aft else bef end group by id),
lf as (select f2.id, count(*) nl, min(v) lv from f2 left join near using (id) where not coalesce(nn = 1 and f2.i = ni, false) group by f2.id),
g as (select tl.id, tl.text, tl.sheet_unit, coalesce(nsym, 0) nsym, symk, u, coalesce(nunit, 0) nunit, c, coalesce(ngood, 0) ngood, coalesce(badc, false) badc,
  dw.id is not null hd, coalesce(nn, 0) nn, nv, coalesce(nl, 0) nl, lv, pick.v pv,
  exists(select 1 from k2 where k2.id = tl.id and k = 'number' and v is null) ambn,
  exists(select 1 from k2 where k2.id = tl.id and k = 'times' and pk is distinct from 'number') stray,
  exists(select 1 from k2 where k2.id = tl.id and (k in ('word', 'other') or (k = 'all' and pk is distinct from 'thru'))) unk,
  exists(select 1 from k2 where k2.id = tl.id and k = 'thru') thru
  from tl left join sym using (id) left join unit using (id) left join cnt using (id) left join dw using (id)
  left join near using (id) left join lf using (id) left join pick using (id)),
h as (select *, case when nsym = 1 then symk when nsym = 0 and nl = 1 then 'linear' end form,
  case when nsym > 0 then pv when nl = 1 then lv end size0, case when hd and nn = 1 then nv end depth0 from g),
z as (select *, case when size0 > 0 and size0 <= 1e6 then size0 end size, case when depth0 > 0 and depth0 <= 1e6 then depth0 end depth,
  ambn or ngood > 1 or (hd and nn > 1) or (nl > 0 and not (nsym = 0 and nl = 1)) amb,
  (size0 is not null and not (size0 > 0 and size0 <= 1e6)) or (depth0 is not null and not (depth0 > 0 and depth0 <= 1e6)) or badc bad from h),
y as (select *, size is null and not (amb or stray or unk or (hd and nn = 0) or nsym > 1 or nunit > 1 or bad) silent from z),
x as (select *, concat_ws(',', case when stray or (silent and form is null) then 'unsupported_syntax' end, case when amb then 'ambiguous_number' end,
  case when silent and form is not null then 'missing_value_after_symbol' end, case when hd and nn = 0 then 'missing_depth_value' end,
  case when nsym > 1 then 'conflicting_symbols' end, case when nunit > 1 then 'conflicting_units' end,
  case when c is not null and coalesce(form, '') not in ('diameter', 'radius') then 'count_without_feature' end,
  case when unk then 'unknown_tokens' end, case when thru and depth is not null then 'thru_with_depth' end, case when bad then 'invalid_value' end,
  case when form is not null and size is not null and u is null then 'unit_unresolved' end,
  case when form is not null and size is not null and u <> sheet_unit then 'unit_differs_from_sheet' end) warnings from y),
parsed as (select id, form, size, c::bigint count, case when thru and depth is null then 'thru' when depth is not null and not thru then 'blind' end termination,
  depth, u unit, warnings, sheet_unit, case when regexp_matches(warnings, 'unsupported|missing|conflicting|count_without|unknown|thru_with|invalid') then 'unsupported'
  when warnings like '%ambiguous_number%' then 'ambiguous' else 'parsed' end status from x)"""


def callout_rows(spark, sf):
    d = callouts.extract_callouts(callout_texts(spark, sf), "text", "sheet_unit")
    return d.select("id", "callout.status", "callout.form", "callout.size", "callout.count", "callout.termination",
                    "callout.depth", "callout.unit", F.array_join("callout.warnings", ",").alias("warnings"))


QUERIES["callout_extraction_parts"] = callout_rows
ORACLES["callout_extraction_parts"] = f"""with {CALLOUT_PARSE_SQL}
select id, status, form, size, count, termination, depth, unit, warnings from parsed"""


def callout_codes(spark, sf):
    d = callouts.extract_callouts(callout_texts(spark, sf), "text", "sheet_unit")
    return d.select("sheet_id", F.explode("callout.warnings").alias("code")).groupBy("sheet_id", "code").agg(F.count(F.lit(1)).alias("texts"))


QUERIES["callout_code_profile_parts"] = callout_codes
ORACLES["callout_code_profile_parts"] = f"""with {CALLOUT_PARSE_SQL},
e as (select id, unnest(string_split(warnings, ',')) code from parsed where warnings <> '')
select sheet_id, code, count(*) texts from e join ct using (id) group by 1, 2"""


def normalised(spark, sf):
    d = callouts.extract_callouts(callout_texts(spark, sf), "text")
    mm, source = text.to_mm(F.col("callout.size"), F.col("callout.unit"), F.col("sheet_unit"))
    return d.groupBy(source.alias("unit_source")).agg(
        F.count(F.lit(1)).alias("texts"), F.round(F.sum(mm), 3).alias("sum_mm"), F.round(F.max(mm), 4).alias("max_mm"))


QUERIES["unit_normalisation_parts"] = normalised
ORACLES["unit_normalisation_parts"] = f"""with {CALLOUT_PARSE_SQL},
m as (select size, case when size is not null then case when unit is not null then 'printed' when sheet_unit is not null then 'sheet' else 'missing_unit' end end src,
  coalesce(unit, sheet_unit) un from parsed)
select src unit_source, count(*) texts, round(sum(case when un = 'in' then size * 25.4::double when un = 'mm' then size end), 3) sum_mm,
  round(max(case when un = 'in' then size * 25.4::double when un = 'mm' then size end), 4) max_mm from m group by 1"""


def roles(spark, sf):
    d = text.extract_dimensions(callout_texts(spark, sf), "text")
    choice = F.array_join(text.role_choices(F.col("text"), F.lit(None).cast("string")), ",")
    return d.groupBy(choice.alias("roles")).agg(F.count(F.lit(1)).alias("texts"))


QUERIES["role_choices_parts"] = roles
ORACLES["role_choices_parts"] = rf"""with {DIM_SQL},
r as (select trim(case when pre = '' then text else substr(text, length(pre)) end) body from v)
select case when body like '%Ø%' then 'outer_diameter,inner_diameter,hole_diameter'
  when regexp_matches(body, '^[Rr]') and not regexp_matches(body, '^(?i)ra') then 'bend_radius,corner_radius,fillet'
  when regexp_matches(body, '(?i)THRU|TAP|CBORE|C''BORE|CSK|6H|PILOT') then 'outer_diameter,inner_diameter,hole_diameter'
  else 'edge,thickness,hole_spacing' end roles, count(*) texts from r group by 1"""


def corpus_classes(spark, sf):
    d = table(spark, sf, "documents").select("source", "text")
    return d.groupBy("source", text.text_class(F.col("text")).alias("class")).agg(
        F.count(F.lit(1)).alias("texts"), F.count(text.number_in(F.col("text"))).alias("with_number"),
        F.round(F.log10(F.max(text.number_in(F.col("text"))) + 1), 3).alias("largest_first_number"))


QUERIES["text_class_documents"] = corpus_classes
ORACLES["text_class_documents"] = r"""with d as (select source, text, try_cast(replace(nullif(regexp_extract(text, '(\d+(?:[.,]\d+)?)', 1), ''), ',', '.') as double) num from documents)
select source, case when contains(text, 'Ø') then case when regexp_matches(text, 'THRU|DEPTH') then 'diameter_callout' else 'diameter' end
  when regexp_matches(text, 'THRU|DEPTH') then 'callout' when starts_with(text, 'R') then 'radius' else 'linear' end as class,
  count(*) texts, count(num) with_number, round(log10(max(num) + 1), 3) largest_first_number from d group by 1, 2"""


def text_keys(spark, sf):
    d = table(spark, sf, "documents").select("text").withColumn("key", text.squash(F.col("text")))
    d = d.withColumn("key", F.md5("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.max(F.length(text.normalize_text(F.col("text")))).alias("longest"))
    return d


QUERIES["text_keys_documents"] = text_keys
ORACLES["text_keys_documents"] = r"""select md5(regexp_replace(lower(text), '[^0-9a-z]', '', 'g')) as key, count(*) copies,
  max(length(trim(regexp_replace(text, '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+', ' ', 'g')))) longest
from documents group by 1"""

_TERMS = ["TODO", "tbd", "placeholder", "secret", "@", "gold", "the "]


def leaks(spark, sf):
    d = texts.forbidden_terms(table(spark, sf, "documents").select("source", "text"), "text", _TERMS)
    return d.select("source", F.explode("leaks").alias("term")).groupBy("source", "term").agg(F.count(F.lit(1)).alias("documents"))


QUERIES["forbidden_terms_documents"] = leaks
ORACLES["forbidden_terms_documents"] = f"""select source, term, count(*) documents from documents,
  (select unnest([{', '.join(repr(t) for t in _TERMS)}]) term) where contains(lower(text), lower(term)) group by 1, 2"""

BOX = {
    "x0": "cast((p_partkey * 7919) % 997 as double) / 1000", "y0": "cast((p_partkey * 104729) % 991 as double) / 1000",
    "x1": "cast((p_partkey * 7919) % 997 + p_size - 3 as double) / 1000", "y1": "cast((p_partkey * 104729) % 991 + p_size % 17 as double) / 1000",
}


def region_codes(spark, sf):
    d = table(spark, sf, "part").selectExpr(*[f"{e} as {n}" for n, e in BOX.items()])
    d = regions.check_region(d.withColumn("region", F.array("x0", "y0", "x1", "y1")), "region")
    valid = regions.coordinates_valid(F.array("region"))
    return d.groupBy("region_issue").agg(F.count(F.lit(1)).alias("regions"), F.count_if(valid).alias("in_unit_square"))


_BOX_SQL = "bx as (select p_partkey, p_brand, p_size, p_name, p_type, " + ", ".join(f"{e} as {n}" for n, e in BOX.items()) + " from part)"
QUERIES["region_checks_parts"] = region_codes
ORACLES["region_checks_parts"] = f"""with {_BOX_SQL}
select case when not (0 <= x0 and x0 < x1 and x1 <= 1 and 0 <= y0 and y0 < y1 and y1 <= 1) then 'out_of_order' end region_issue, count(*) regions,
  count(*) filter (where x0 between 0 and 1 and x1 between 0 and 1 and y0 between 0 and 1 and y1 between 0 and 1) in_unit_square from bx group by 1"""

_OBS = {
    "x": "cast(l_partkey % 40 as double) * 25", "y": "cast(l_orderkey % 30 as double) * 25 - 50",
    "w": "cast(l_linenumber as double) * 10", "h": "cast(l_suppkey % 3 as double) * 8",
}


def _observed(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as sheet_id", "concat('t', l_orderkey, '-', l_linenumber) as id", "l_returnflag as text",
        "case l_linestatus when 'O' then 'pdf-text' else 'other' end as method", *[f"{e} as {n}" for n, e in _OBS.items()])
    frames = table(spark, sf, "supplier").selectExpr("s_suppkey as sheet_id", "s_name as source_digest", "1000.0D as width", "800.0D as height")
    return li, frames


_OBS_SQL = "ob as (select l_suppkey sheet_id, concat('t', l_orderkey, '-', l_linenumber) id, l_returnflag as text, l_linestatus st, " + ", ".join(
    f"{e} as {n}" for n, e in _OBS.items()) + " from lineitem)"
_REGIONS_SQL = f"""{_OBS_SQL},
ok as (select *, case when st = 'O' then 'vector_text' else 'observation' end source_kind, round(x / 1000, 8) x0, round(y / 800, 8) y0, round((x + w) / 1000, 8) x1, round((y + h) / 800, 8) y1
  from ob where w > 0 and h > 0 and x >= 0 and y >= 0 and x + w <= 1000 and y + h <= 800)"""


def candidate_rows(spark, sf):
    cands, _ = texts.callout_candidates(*_observed(spark, sf), "detector/1")
    return cands.select("sheet_id", "x0", "y0", "x1", "y1", "source_kind", "n_ids", "machine_text_hint", "first_id")


QUERIES["callout_candidates_lineitem"] = candidate_rows
ORACLES["callout_candidates_lineitem"] = f"""with {_REGIONS_SQL}
select sheet_id, x0, y0, x1, y1, source_kind, count(distinct id) n_ids, case when min(text) = max(text) then min(text) end machine_text_hint, min(id) first_id
from ok group by 1, 2, 3, 4, 5, 6"""


def reading_order(spark, sf):
    cands, _ = texts.callout_candidates(*_observed(spark, sf), "detector/1")
    return texts.canonical_order(cands).select("sheet_id", "x0", "y0", "x1", "y1", "source_kind", "place", "position")


QUERIES["reading_order_lineitem"] = reading_order
ORACLES["reading_order_lineitem"] = f"""with {_REGIONS_SQL},
c as (select distinct sheet_id, x0, y0, x1, y1, source_kind from ok)
select *, row_number() over (partition by sheet_id order by y0, x0, y1, x1, source_kind) - 1 as place, row_number() over (order by sheet_id, y0, x0, y1, x1, source_kind) - 1 as position from c"""


def candidate_ids(spark, sf):
    return texts.candidate_observations(*_observed(spark, sf), "detector/1").select("sheet_id", "x0", "y0", "x1", "y1", "source_kind", "id")


QUERIES["candidate_observations_lineitem"] = candidate_ids
ORACLES["candidate_observations_lineitem"] = f"with {_REGIONS_SQL}\nselect distinct sheet_id, x0, y0, x1, y1, source_kind, id from ok"


def candidate_diagnostics(spark, sf):
    _, diag = texts.callout_candidates(*_observed(spark, sf), "detector/1")
    return diag.groupBy("sheet_id", "code").agg(F.count(F.lit(1)).alias("observations"))


QUERIES["callout_diagnostics_lineitem"] = candidate_diagnostics
ORACLES["callout_diagnostics_lineitem"] = f"""with {_REGIONS_SQL},
d as (select sheet_id, 'unknown_text_method' code, id from ob where st <> 'O'
  union select sheet_id, case when w <= 0 or h <= 0 then 'invalid_bbox_area' else 'bbox_outside_frame' end, id from ob
    where not (w > 0 and h > 0 and x >= 0 and y >= 0 and x + w <= 1000 and y + h <= 800)
  union select sheet_id, 'duplicate_hint_conflict', min(id) from ok group by sheet_id, x0, y0, x1, y1, source_kind having min(text) <> max(text))
select sheet_id, code, count(*) observations from d group by 1, 2"""


def inside(spark, sf):
    obs, frames = _observed(spark, sf)
    return texts.inside_area(obs, frames).groupBy("sheet_id").agg(F.count(F.lit(1)).alias("inside"), F.sum("x").alias("sum_x"))


QUERIES["drawing_area_filter_lineitem"] = inside
ORACLES["drawing_area_filter_lineitem"] = f"""with {_OBS_SQL}
select sheet_id, count(*) inside, sum(x) sum_x from ob where x + w / 2 between 40 and 960 and y + h / 2 between 32 and 768 group by 1"""


def flags(spark, sf):
    d = callouts.extract_callouts(callout_texts(spark, sf), "text")
    s = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    nested = d.select(
        "sheet_id", s(text=F.when(F.col("id") % 3 > 0, F.col("text"))).alias("callout"),
        s(symbol=F.when(F.col("callout.form") == "radius", "R").otherwise(F.col("callout.form"))).alias("form"),
        s(state=F.when(F.col("callout.size").isNotNull(), "known").otherwise("unknown")).alias("size"),
        s(printed=F.col("callout.count"), found_circles=F.when(F.col("id") % 5 == 0, F.col("id"))).alias("count"),
        s(kind=F.col("callout.termination")).alias("termination"),
        s(state=F.when(F.col("callout.depth").isNotNull(), "known").otherwise("not_stated")).alias("depth"),
        s(kind=F.when(F.col("id") % 9 == 0, "hole").otherwise("unknown")).alias("physical"),
        s(kind=F.when(F.col("id") % 2 == 0, "circle").otherwise("unknown")).alias("representation"),
        s(state=F.when(F.col("id") % 4 == 0, "bound"), observation_id=F.when(F.col("id") % 8 == 0, F.col("id"))).alias("target"),
        s(region=F.when(F.col("id") % 7 > 0, F.array(F.lit(0.1)))).alias("source"),
        s(fields=F.array().cast("array<string>"), reason=F.when(F.col("id") % 10 == 0, "unclear")).alias("uncertainty"))
    f = texts.claim_flags(nested)
    names = [("claim_flags", n) for n in ("callout_text", "form_symbol", "size", "count_printed", "termination", "depth", "physical")]
    names += [("evidence_flags", n) for n in ("representation", "found_circles", "target_state", "target_observation_id", "source_region", "uncertainty")]
    return f.groupBy("sheet_id").agg(
        *[F.count_if(f"{a}.{n}").alias(f"n_{n}") for a, n in names], F.count_if("has_claim").alias("contentful"), F.count_if("has_evidence").alias("evidence"))


QUERIES["claim_flags_parts"] = flags
ORACLES["claim_flags_parts"] = f"""with {CALLOUT_PARSE_SQL},
j as (select sheet_id, p.*, (id % 3 > 0) f1, coalesce(form in ('radius', 'diameter'), false) f2, size is not null f3, count is not null f4, coalesce(termination = 'thru', false) f5,
  depth is not null f6, id % 9 = 0 f7, id % 2 = 0 e1, id % 5 = 0 e2, id % 4 = 0 e3, id % 8 = 0 e4, id % 7 > 0 e5, id % 10 = 0 e6
  from parsed p join (select id, sheet_id from ct) using (id))
select sheet_id, count(*) filter (f1) n_callout_text, count(*) filter (f2) n_form_symbol, count(*) filter (f3) n_size, count(*) filter (f4) n_count_printed,
  count(*) filter (f5) n_termination, count(*) filter (f6) n_depth, count(*) filter (f7) n_physical, count(*) filter (e1) n_representation,
  count(*) filter (e2) n_found_circles, count(*) filter (e3) n_target_state, count(*) filter (e4) n_target_observation_id, count(*) filter (e5) n_source_region,
  count(*) filter (e6) n_uncertainty, count(*) filter (f1 or f2 or f3 or f4 or f5 or f6 or f7) contentful,
  count(*) filter (e1 or e2 or e3 or e4 or e5 or e6) evidence from j group by 1"""


def boxes(spark, sf):
    none = F.lit(None).cast("array<struct<start:array<double>,end:array<double>,center:array<double>,radius:double>>")
    d = table(spark, sf, "part").selectExpr("p_partkey", *[f"{e} as {n}" for n, e in BOX.items()]).withColumn("r", (F.col("p_partkey") % 5) / 100)
    circle = F.struct(F.array("x1", "y1").alias("center"), F.col("r").alias("radius"))
    box = geometry.geometry_bbox(F.array(F.array("x0", "y0"), F.array("x1", "y0")), none, F.array(circle))
    return d.select("p_partkey", box.alias("b")).select("p_partkey", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


QUERIES["geometry_bbox_parts"] = boxes
ORACLES["geometry_bbox_parts"] = f"""with {_BOX_SQL}, r as (select *, (p_partkey % 5) / 100.0::double r from bx)
select p_partkey, round(case when r > 0 then least(x0, x1, x1 - r) else least(x0, x1) end, 6) x0, round(case when r > 0 then least(y0, y1 - r) else y0 end, 6) y0,
  round(case when r > 0 then greatest(x0, x1 + r) else greatest(x0, x1) end, 6) x1, round(case when r > 0 then greatest(y0, y1 + r) else y0 end, 6) y1 from r"""


def identities(spark, sf):
    d = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_size").withColumn("row_identity", identity.identity("p_partkey", "p_name", "p_size"))
    return d.select("p_partkey", "row_identity")


QUERIES["identity_hash_parts"] = identities
ORACLES["identity_hash_parts"] = """select p_partkey,
  sha256('{"p_name":"' || p_name || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') row_identity from part"""


def group_identities(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return identity.group_identity(li, ["l_suppkey"], ["l_orderkey", "l_partkey"], ["l_linenumber"])


QUERIES["group_identity_lineitem"] = group_identities
ORACLES["group_identity_lineitem"] = """with h as (select l_suppkey, sha256('{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"l_partkey":' || l_partkey || '}') d from lineitem),
w as (select l_suppkey, count(*) n, """ + ", ".join(f"sum(('0x' || substr(d, {1 + 8 * i}, 8))::bigint)::hugeint w{i}" for i in range(8)) + """ from h group by 1)
select l_suppkey, sha256(concat_ws(':', n, w0, w1, w2, w3, w4, w5, w6, w7)) as identity from w"""


def verdict_columns(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr(
        "case when l_linenumber % 5 > 0 then l_quantity end as want", "case when l_linenumber % 3 > 0 then l_quantity + l_tax * 20 - 0.5 end as got",
        "case when l_suppkey % 4 = 0 then 'in' else 'mm' end as wu", "case when l_suppkey % 6 = 0 then 'in' when l_suppkey % 6 = 1 then null else 'mm' end as gu",
        "l_returnflag as wc", "case when l_partkey % 4 = 0 then 'unknown' when l_partkey % 4 = 1 then null when l_partkey % 4 = 2 then l_returnflag else l_linestatus end as gc")
    return li.groupBy(
        verdicts.num_verdict(F.col("want"), F.col("wu"), F.col("got"), F.col("gu")).alias("num"),
        verdicts.cat_verdict(F.when(F.col("wc") == "N", "underdetermined").otherwise(F.col("wc")), F.col("gc"), ["O", "F"]).alias("cat"),
    ).agg(F.count(F.lit(1)).alias("rows"))


QUERIES["field_verdicts_lineitem"] = verdict_columns
ORACLES["field_verdicts_lineitem"] = """with l as (select case when l_linenumber % 5 > 0 then l_quantity end w, case when l_linenumber % 3 > 0 then l_quantity + l_tax * 20 - 0.5 end g,
  case when l_suppkey % 4 = 0 then 'in' else 'mm' end wu, case when l_suppkey % 6 = 0 then 'in' when l_suppkey % 6 = 1 then null else 'mm' end gu,
  case when l_returnflag = 'N' then 'underdetermined' else l_returnflag end wc,
  case when l_partkey % 4 = 0 then 'unknown' when l_partkey % 4 = 1 then null when l_partkey % 4 = 2 then l_returnflag else l_linestatus end gc from lineitem),
m as (select *, case when wu = 'in' then w * 25.4::double else w end wm, case when gu = 'in' then g * 25.4::double else g end gm from l)
select case when w is null and g is null then 'not_applicable' when g is null then 'omission' when w is null then 'false_claim'
  when abs(gm - wm) <= greatest(0.05::double, 0.02::double * abs(wm)) then 'correct' when wu <> coalesce(gu, wu) then 'unit_error' else 'value_error' end num,
  case when gc is null or gc = 'unknown' then 'abstained' when gc = wc then 'correct' when wc = 'underdetermined' and gc in ('O', 'F') then 'overclaim' else 'mismatch' end cat,
  count(*) as rows from m group by 1, 2"""


def measures(spark, sf):
    o = table(spark, sf, "orders").selectExpr(
        "o_orderkey", *[f"cast((o_orderkey * {p}) % 1009 as double) as {n}" for n, p in zip(("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"), (7919, 104729, 1299709, 15485863, 611953, 224737, 350377, 746773))])
    seg = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    other = [F.col(c) for c in ("cx", "cy", "dx", "dy")]
    meet = geometry.segments_meet(seg, other)
    poly = F.array(F.array("ax", "ay"), F.array("bx", "by"), F.array("dx", "dy"))
    overlap = geometry.arc_overlap(F.radians("ax"), F.radians(F.col("ay") % 360), F.radians("bx"), -F.radians(F.col("by") % 360))
    return o.select(
        "o_orderkey", F.round(geometry.seg_dist(F.col("cx"), F.col("cy"), *seg), 4).alias("seg_dist"),
        F.round(geometry.polyline_dist(F.col("cx"), F.col("cy"), poly), 4).alias("poly_dist"),
        F.round(meet["x"], 4).alias("meet_x"), geometry.on_interior(F.col("cx"), F.col("cy"), seg, 20.0).alias("interior"),
        F.round(overlap, 4).alias("arc_overlap"),
        geometry.within_tol(F.col("ax"), F.col("bx"), 0.02, 5.0).alias("close"))


QUERIES["geometry_measures_orders"] = measures


def _sd(px, py, a, b, c, d):
    t = f"least(greatest((({px} - {a}) * ({c} - {a}) + ({py} - {b}) * ({d} - {b})) / (({c} - {a}) * ({c} - {a}) + ({d} - {b}) * ({d} - {b})), 0), 1)"
    t = f"(case when {a} = {c} and {b} = {d} then 0 else {t} end)"
    return f"sqrt(({a} + {t} * ({c} - {a}) - {px}) ** 2 + ({b} + {t} * ({d} - {b}) - {py}) ** 2)"


_DEN = "((ax - bx) * (cy - dy) - (ay - by) * (cx - dx))"
_T = f"(((ax - cx) * (cy - dy) - (ay - cy) * (cx - dx)) / {_DEN})"
_U = f"(((ax - cx) * (ay - by) - (ay - cy) * (ax - bx)) / {_DEN})"
_PI2 = "(2 * pi())"
ORACLES["geometry_measures_orders"] = f"""with o as (select o_orderkey, {', '.join(f'((o_orderkey * {p}) % 1009)::double {n}' for n, p in zip(('ax', 'ay', 'bx', '"by"', 'cx', 'cy', 'dx', 'dy'), (7919, 104729, 1299709, 15485863, 611953, 224737, 350377, 746773)))} from orders),
q as (select o_orderkey, ax, ay, bx, "by" as yb, cx, cy, dx, dy, radians(ax) % {_PI2} s1, radians(ay % 360) w1,
  (radians(bx) - radians("by" % 360) + 4 * {_PI2}) % {_PI2} s2, radians("by" % 360) w2 from o)
select o_orderkey, round({_sd('cx', 'cy', 'ax', 'ay', 'bx', 'yb')}, 4) seg_dist,
  round(least({_sd('cx', 'cy', 'ax', 'ay', 'bx', 'yb')}, {_sd('cx', 'cy', 'bx', 'yb', 'dx', 'dy')}), 4) poly_dist,
  case when abs({_DEN.replace('by', 'yb')}) >= 1e-12 and {_T.replace('by', 'yb')} between -1e-9 and 1 + 1e-9 and {_U.replace('by', 'yb')} between -1e-9 and 1 + 1e-9
    then round(ax + least(greatest({_T.replace('by', 'yb')}, 0), 1) * (bx - ax), 4) end meet_x,
  case when ax = bx and ay = yb then false else
  ((cx - ax) * (bx - ax) + (cy - ay) * (yb - ay)) / sqrt((bx - ax) ** 2 + (yb - ay) ** 2) > 20 and
  ((cx - ax) * (bx - ax) + (cy - ay) * (yb - ay)) / sqrt((bx - ax) ** 2 + (yb - ay) ** 2) < sqrt((bx - ax) ** 2 + (yb - ay) ** 2) - 20 and
  abs((cx - ax) * (yb - ay) - (cy - ay) * (bx - ax)) / sqrt((bx - ax) ** 2 + (yb - ay) ** 2) <= 20 end interior,
  round(greatest(least(s1 + w1, s2 + w2) - greatest(s1, s2), 0) + greatest(least(s1 + w1, s2 + w2 - {_PI2}) - greatest(s1, s2 - {_PI2}), 0)
    + greatest(least(s1 + w1 - {_PI2}, s2 + w2) - greatest(s1 - {_PI2}, s2), 0), 4) arc_overlap,
  abs(ax - bx) <= greatest(0.02::double * abs(bx), 5.0) as close from q"""


# Three parts a sheet, 60 keys apart, so that their texts are of one form; the count of the first meets the names of the other
# two, and some sheets give a name twice.
_CATALOG_SHEET = "concat(cast(id % 60 as string), '-', cast(cast(floor(id / 180) as bigint) as string))"
_CATALOG_NTH = "cast(floor(id / 60) as bigint) % 3"
_CATALOG_NAME = f"case when {_CATALOG_NTH} = 0 or id % 11 = 2 then 'n' when {_CATALOG_NTH} = 1 then 'n_count' when id % 2 = 0 then 'n_count_2' else 'n_count_3' end"


def catalog(spark, sf):
    d = text.extract_dimensions(callout_texts(spark, sf), "text")
    printed = d.selectExpr(f"{_CATALOG_SHEET} as sheet_id", "cast(id as string) as span_id", "dim_value as value", "dim_unit as unit", "text", "dim_kind as kind", "cast(dim_count as int) as count")
    names = callout_texts(spark, sf).selectExpr(f"{_CATALOG_SHEET} as sheet_id", "cast(id as string) as span_id", f"{_CATALOG_NAME} as name")
    claims = printed.selectExpr("sheet_id", "span_id", "'distance' as form", "'confirmed' as resolution")
    rows, errors = texts.build_catalog(printed, names, claims)
    found = rows.select("sheet_id", "span_id", "name", "quantity", F.lit(None).cast("string").alias("code"))
    failed = errors.select("sheet_id", "span_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("quantity"), "code")
    return found.unionByName(failed)


QUERIES["quantity_catalog_parts"] = catalog
ORACLES["quantity_catalog_parts"] = rf"""with {DIM_SQL},
pp as (select {_CATALOG_SHEET} sheet_id, id::varchar span_id, val, text, cnt, {_CATALOG_NAME} as name from v),
e as (select sheet_id, span_id, 'not_numeric' code from pp where val is null union all
  select sheet_id, min(span_id), 'duplicate_name' from pp group by sheet_id, name having count(*) > 1),
g as (select * from pp where sheet_id not in (select sheet_id from e)),
c as (select *, name || '_count' as made from g where cnt > 1 or regexp_matches(text, '(?i)\b1\s*[x×]')),
k as (select sheet_id, span_id, min(t.i) i from c,
  (select i, case when i = 1 then '' else '_' || i end suffix from range(1, 9) r(i)) t
  where not exists (select 1 from pp o where o.sheet_id = c.sheet_id and o.name = c.made || t.suffix) group by 1, 2)
select sheet_id, span_id, name, 'size' quantity, null::varchar code from g union all
select c.sheet_id, c.span_id, c.made || case when k.i = 1 then '' else '_' || k.i end, 'count', null from c join k on k.sheet_id = c.sheet_id and k.span_id = c.span_id union all
select sheet_id, span_id, null, null, code from e"""
