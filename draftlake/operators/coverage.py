"""Printed-number coverage, label pairing, answer scoring and simple quality measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake import constants as K
from draftlake.functions.geometry import hypot
from draftlake.functions.text import normalize_text, squash, text_class
from draftlake.operators.grid import cell, near_values, nearest_within, neighbours
from draftlake.operators.scan import rank_value
from draftlake.session import cut

SAME_REL, SAME_ABS = 0.001, 1e-6
NEEDS_BETWEEN = ["distance"]
NEEDS_MATCHED = ["diameter", "radius"]


def same_number(value: Column, printed: Column) -> Column:
    return F.abs(value - printed) <= F.greatest(F.lit(SAME_ABS), SAME_REL * F.abs(printed))


def _bucket(v: Column, shift: int = 0) -> Column:
    """Bucket of a printed magnitude: 0.5 % steps on the log scale, sign kept apart; zero on its own."""
    b = F.floor(F.ln(F.abs(v)) / 0.005) + shift
    return F.when(F.abs(v) <= 1e-5, F.lit(0).cast("long")).otherwise(b * 2 + F.when(v < 0, 1).otherwise(0) + 1000001)


def match_numbers(readings: DataFrame, printed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readings joined with every printed number that is the same within 0.1 %; ``printed`` is reduced to its
    distinct values first, readings to theirs by the caller where wanted."""
    keys = list(keys)
    p = printed.select(*keys, F.col("printed")).distinct().withColumn("_b", _bucket(F.col("printed")))
    r = readings.withColumn("_b", F.explode(F.array_distinct(F.array(*[_bucket(F.col("value"), s) for s in (-1, 0, 1)]))))
    return r.join(p, [*keys, "_b"]).where(same_number(F.col("value"), F.col("printed"))).drop("_b")


def printed_coverage(spans: DataFrame, printed: DataFrame, callouts: DataFrame, keys: Sequence[str] = ("sheet_id",)) -> tuple[DataFrame, DataFrame]:
    """(spans with class, printed with found).

    A valued span is ``found`` (its number is printed; the first printed match in ``ord`` order), ``callout`` (its
    squashed text starts a listed callout) or ``noise``.
    """
    keys = list(keys)
    valued = spans.where("value is not null")
    # Each distinct number of a sheet is matched once, whatever the number of readings that carry it.
    numbers = valued.select(*keys, "value").distinct()
    hits = match_numbers(numbers, printed, keys).join(printed.groupBy(*keys, "printed").agg(F.min("ord").alias("ord")), [*keys, "printed"])
    hit = hits.groupBy(*keys, "value").agg(F.min_by("printed", "ord").alias("hit"))
    # Prefixes of the callouts, so that "starts with" is an equality.
    sq = squash(F.col("callout"))
    prefix = callouts.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.length(sq)), lambda n: F.substring(sq, F.lit(1), n))).alias("_sq")).distinct().withColumn("_named", F.lit(True))
    out = valued.withColumn("_sq", squash(F.col("text"))).join(hit, [*keys, "value"], "left").join(prefix, [*keys, "_sq"], "left")
    kind = F.when(F.col("hit").isNotNull(), "found").when(F.col("_named"), "callout").otherwise("noise")
    found = hit.select(*keys, F.col("hit").alias("printed")).distinct().withColumn("found", F.lit(True))
    return (out.withColumn("class", kind).drop("_sq", "_named"),
            printed.select(*keys, "printed").distinct().join(found, [*keys, "printed"], "left").withColumn("found", F.coalesce("found", F.lit(False))))


def coverage_report(classes: DataFrame, printed: DataFrame, keys: Sequence[str] = ("sheet_id",)) -> DataFrame:
    keys = list(keys)
    a = classes.groupBy(*keys).agg(*[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in ("found", "callout", "noise")])
    b = printed.groupBy(*keys).agg(F.count(F.lit(1)).alias("printed"), F.count_if("found").alias("covered"))
    return b.join(a, keys, "full").withColumn("missing", F.col("printed") - F.col("covered"))


def missing(printed: DataFrame, found: DataFrame, keys: Sequence[str] = ("sheet_id",)) -> DataFrame:
    """Printed values of a key that no found value equals."""
    hits = match_numbers(found.select(*keys, "value").distinct(), printed, keys)
    return printed.select(*keys, "printed").distinct().join(hits.select(*keys, "printed"), [*keys, "printed"], "left_anti")


def coverage_by_class(kept: DataFrame, unpaired: DataFrame, raw: DataFrame, keys: Sequence[str] = ("sheet_id",)) -> DataFrame:
    """Printed readings per text class: kept, unpaired, not accounted, and drops an equal kept value hides."""
    keys = list(keys)
    accounted = kept.select(*keys, "id").unionByName(unpaired.select(*keys, "id")).distinct()
    lost = raw.join(accounted, [*keys, "id"], "left_anti")
    tag = lambda df, name: df.select(*keys, text_class(F.col("text")).alias("class"), "value", F.lit(name).alias("status"))
    rows = tag(kept, "kept").unionByName(tag(unpaired, "unpaired")).unionByName(tag(lost, "not_accounted"))
    held = kept.select(*keys, "value").distinct().withColumn("_held", F.lit(True))
    rows = rows.join(held, [*keys, "value"], "left")
    return rows.groupBy(*keys, "class").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("kept", "unpaired", "not_accounted")],
        F.count_if((F.col("status") == "unpaired") & F.col("_held").isNotNull()).alias("hidden_by_equal_value"))


def labels_on_sheet(labels: DataFrame, raw: DataFrame, kept: DataFrame, keys: Sequence[str] = ("sheet_id",)) -> DataFrame:
    """``on_sheet``: the label's text is printed (whitespace collapsed) or its value was kept."""
    keys = list(keys)
    texts = raw.select(*keys, normalize_text(F.col("text")).alias("_t")).distinct().withColumn("_a", F.lit(True))
    values = kept.select(*keys, F.col("value").alias("value_mm")).distinct().withColumn("_b", F.lit(True))
    out = labels.withColumn("_t", normalize_text(F.coalesce("text", F.lit("")))).join(texts, [*keys, "_t"], "left").join(values, [*keys, "value_mm"], "left")
    return out.withColumn("on_sheet", F.col("_a").isNotNull() | F.col("_b").isNotNull()).drop("_t", "_a", "_b")


def reading_report(records: DataFrame, printed: DataFrame, callouts: DataFrame, keys: Sequence[str] = ("sheet_id",)) -> tuple[DataFrame, DataFrame]:
    """(turnout per key, roles per key)."""
    classes, found = printed_coverage(records, printed, callouts, keys)
    return coverage_report(classes, found, keys), records.groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("records"))


def pair_labels(labels: DataFrame, readings: DataFrame, keys: Sequence[str] = ("sheet_id",)) -> DataFrame:
    """label id -> reading id where value, unit and kind single one out, else value and unit; unique or absent.

    Values meet when they differ by less than 1e-6: a label visits its own micro-bucket and both neighbours, and readings
    are counted after the exact comparison. Equal readings are one row with a count, equal labels ask once.
    """
    keys = list(keys)
    micro, unit = F.floor(F.col("value") * 1e6), F.coalesce(F.col("unit").cast("string"), F.lit("\0")).alias("_unit")
    lab = labels.select(*keys, F.col("id").alias("label_id"), "value", unit, F.coalesce(F.col("kind").cast("string"), F.lit("")).alias("_kind"))
    asked = lab.drop("label_id").distinct().withColumn("_m", F.explode(F.array(*(micro + i for i in (-1, 0, 1)))))
    groups = readings.where("value is not null").groupBy(*keys, unit, F.col("value").alias("_value"), F.col("kind").alias("_other")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("rid")).withColumn("_m", F.floor(F.col("_value") * 1e6))
    same = (F.col("_kind") != "") & (F.col("_other") == F.col("_kind"))
    met = asked.join(groups, [*keys, "_unit", "_m"]).where(F.abs(F.col("value") - F.col("_value")) < 1e-6)
    found = met.groupBy(*keys, "_unit", "value", "_kind").agg(
        F.sum(F.when(same, F.col("n"))).alias("typed"), F.min(F.when(same, F.col("rid"))).alias("typed_id"), F.sum("n").alias("n"), F.min("rid").alias("any_id"))
    out = lab.join(found, [*keys, "_unit", "value", "_kind"])
    return out.select(*keys, "label_id", F.when(F.col("typed") == 1, F.col("typed_id")).when(F.col("n") == 1, F.col("any_id")).alias("reading_id")).where("reading_id is not null")


def nearest_id(points: DataFrame, measured: DataFrame, radius: float, keys: Sequence[str] = ("sheet_id",)) -> DataFrame:
    """The nearest measured geometry within ``radius`` per point; equal distances: first in ``ord``."""
    keys = list(keys)
    own = measured.select(*keys, F.col("x").alias("mx"), F.col("y").alias("my"), "ord", "geometry_id")
    best = nearest_within(points, own, keys, radius, ("x", "y"), ("mx", "my"), ["ord", "geometry_id"])
    best = best.select(*keys, "x", "y", "nearest.geometry_id", "nearest.distance")
    return points.join(best, [*keys, "x", "y"], "left")


def unique_by_size(asked: DataFrame, sized: DataFrame, keys: Sequence[str] = ("sheet_id",)) -> DataFrame:
    """The one id of a key whose diameter fits within max(3 %, 0.15 mm), NULL when none or several do."""
    keys = list(keys)
    sizes = sized.groupBy(*keys, F.col("diameter").alias("drawn")).agg(F.count(F.lit(1)).alias("n"), F.min("geometry_id").alias("g"))
    wanted = asked.select(*keys, "diameter").distinct()
    reach = F.greatest(K.CLAIM_REL_TOL * F.col("diameter"), F.lit(K.CLAIM_ABS_MM))
    hits = near_values(wanted, sizes, keys, "diameter", "drawn", reach, 1.0, F.abs(F.col("drawn") - F.col("diameter")) <= reach)
    one = hits.groupBy(*keys, "diameter").agg(F.sum("n").alias("n"), F.min("g").alias("geometry_id")).where("n = 1").drop("n")
    return asked.join(one, [*keys, "diameter"], "left")


def qa_labels(labels: DataFrame, sheet: DataFrame, spans: DataFrame, keys: Sequence[str] = ("part_id",), tolerance: float = 0.01) -> DataFrame:
    """Two-way agreement of labels with their sheet, one row per problem.

    ``labels`` (keys, role, text, value_mm, datum), ``sheet`` (keys, role, text), ``spans`` (keys, role, drawn_mm,
    datum): missing_on_sheet, unlabelled_number, text_differs, value_differs, datum_differs.
    """
    keys = [*keys, "role"]
    tally = lambda df, n: df.groupBy(*keys, "text").agg(F.count(F.lit(1)).alias(n))
    both = tally(labels, "_l").join(tally(sheet, "_s"), [*keys, "text"], "full").fillna(0, ["_l", "_s"])
    roles = both.groupBy(*keys).agg(F.sum("_l").alias("l"), F.sum("_s").alias("s"), F.max(F.col("_l") != F.col("_s")).alias("d"))
    code = F.when(F.col("s") == 0, "missing_on_sheet").when(F.col("l") == 0, "unlabelled_number").when(F.col("d"), "text_differs")
    out = roles.select(*keys, code.alias("code")).where("code is not null")
    drawn = labels.select(*keys, "value_mm", "datum").join(spans.select(*keys, "drawn_mm", F.col("datum").alias("drawn_datum")), keys)
    val = drawn.where(F.abs(F.col("value_mm") - F.col("drawn_mm")) > tolerance).select(*keys, F.lit("value_differs").alias("code"))
    dat = drawn.where(~F.col("datum").eqNullSafe(F.col("drawn_datum"))).select(*keys, F.lit("datum_differs").alias("code"))
    return out.unionByName(val).unionByName(dat).distinct()


def label_match(readings: DataFrame, labels: DataFrame, keys: Sequence[str] = ("sheet_id",)) -> DataFrame:
    """``matched``: some label value lies within max(0.001, 4 % of it). ``readings`` carries path and reason."""
    keys = list(keys)
    lv = labels.select(*keys, F.col("value_mm").alias("_lv")).where("_lv > 0").distinct().withColumn("_ll", F.ln("_lv"))
    rv = readings.where("value > 0").select(*keys, "value").distinct().withColumn("_lr", F.ln("value"))
    fits = F.abs(F.col("value") - F.col("_lv")) <= F.greatest(F.lit(0.001), 0.04 * F.col("_lv"))
    reach = F.greatest(F.lit(0.0411), F.ln(1 + F.lit(0.001) / F.col("value")) + 0.001)
    hit = near_values(rv, lv, keys, "_lr", "_ll", reach, 0.05, fits).select(*keys, "value").distinct().withColumn("matched", F.lit(True))
    return readings.join(hit, [*keys, "value"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def label_match_summary(matched: DataFrame, keys: Sequence[str] = ("sheet_id", "path")) -> DataFrame:
    return matched.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("readings"), F.count_if("matched").alias("label_matching"))


def compare_parts(produced: DataFrame, truth: DataFrame) -> DataFrame:
    """Coarse part checks; ``vector`` ARRAY<DOUBLE> extents, ``cylinders`` ARRAY<DOUBLE> radii of one part."""
    p = produced.select("part_id", *[F.col(c).alias(f"p_{c}") for c in ("solids", "valid", "vector", "volume", "cylinders")])
    j = p.join(truth.select("part_id", *[F.col(c).alias(f"t_{c}") for c in ("solids", "valid", "vector", "volume", "cylinders")]), "part_id")
    vec = F.forall(F.zip_with("p_vector", "t_vector", lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1.0), 0.02 * b)), lambda ok: F.coalesce(ok, F.lit(False)))
    vol = F.abs(F.col("p_volume") - F.col("t_volume")) / F.greatest(F.col("t_volume"), F.lit(1e-9)) <= 0.25
    miss = F.filter("t_cylinders", lambda r: ~F.exists("p_cylinders", lambda q: F.abs(q - r) <= 0.5))
    extra = F.filter("p_cylinders", lambda r: ~F.exists("t_cylinders", lambda q: F.abs(q - r) <= 0.5))
    out = j.select("part_id", ((F.col("p_solids") == 1) & (F.col("t_solids") == 1)).alias("solids_ok"), F.col("p_valid").alias("valid_ok"), vec.alias("vector_ok"),
                   vol.alias("volume_ok"), miss.alias("missing_radii"), extra.alias("extra_radii"))
    out = out.withColumn("cylinders_ok", F.size("missing_radii") == 0).withColumn("shape_ok", F.col("solids_ok") & F.col("valid_ok") & F.col("vector_ok"))
    return out.withColumn("detail_ok", F.col("volume_ok") & F.col("cylinders_ok")).withColumn("passed", F.col("shape_ok") & F.col("detail_ok"))


def _gaps_found(cylinders: DataFrame, want: DataFrame, limit: Column) -> DataFrame:
    """(part_id, wanted) of ``want`` that some pair of axes keeps, off by ``limit`` (half a unit at least) at most.

    The gaps of a part are kept as the least and the greatest one of each half unit, which decides every window of a unit
    or more. Some 64 axes of a part are measured against all first, then eight times as many for the distances not seen
    yet, until all are. Distances beyond the part's own box need no look.
    """
    spots = cylinders.select("part_id", "x", "y").distinct()
    box = spots.groupBy("part_id").agg(F.count(F.lit(1)).alias("_n"), hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_far"))
    spots = cut(spots.join(box.select("part_id", "_n"), "part_id").withColumn("_h", F.xxhash64("x", "y")))
    opened = cut(want.join(box, "part_id").where(F.col("wanted") - limit <= F.col("_far") * (1 + 1e-9)).select("part_id", "wanted", "_n"))
    found, axes = None, 64
    while True:
        parts = opened.select("part_id").distinct()
        some = spots.join(parts, "part_id", "left_semi").where(F.pmod("_h", F.ceil(F.col("_n") / axes)) == 0).select("part_id", F.col("x").alias("ax"), F.col("y").alias("ay"))
        gap = some.join(spots, "part_id").select("part_id", hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")).alias("_gap"))
        ends = gap.groupBy("part_id", cell(F.col("_gap"), 0.5).alias("_b")).agg(F.min("_gap").alias("lo"), F.max("_gap").alias("hi"))
        seen = ends.select("part_id", F.explode(F.array("lo", "hi")).alias("_gap"))
        hits = near_values(opened, seen, ["part_id"], "wanted", "_gap", limit * (1 + 1e-9), 0.5, F.abs(F.col("_gap") - F.col("wanted")) <= limit)
        hits = cut(hits.select("part_id", "wanted").distinct())
        found = hits if found is None else found.unionByName(hits)
        opened = cut(opened.where(F.col("_n") > axes).join(hits, ["part_id", "wanted"], "left_anti"))
        if opened.isEmpty():
            return found
        axes *= 8


def check_readings(claims: DataFrame, cylinders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checks, parts): confirmed sizes need a cylinder, centre distances a pair of axes, within max(1 %, 0.5 mm).

    ``claims`` (part_id, span_id, form, printed_mm, both_centres), ``cylinders`` (part_id, radius, x, y). A part
    without any check has ok NULL.
    """
    wanted = F.when(F.col("form") == "diameter", F.col("printed_mm") / 2).otherwise(F.col("printed_mm"))
    sizes = claims.where("form in ('diameter', 'radius')").withColumn("wanted", wanted)
    limit = F.greatest(0.01 * F.col("wanted"), F.lit(0.5))
    radii = cylinders.select("part_id", "radius").distinct()
    asked = sizes.select("part_id", "wanted").distinct()
    ok = near_values(asked, radii, ["part_id"], "wanted", "radius", limit, 1.0, F.abs(F.col("radius") - F.col("wanted")) <= limit)
    ok = ok.select("part_id", "wanted").distinct().withColumn("_ok", F.lit(True))
    size_checks = sizes.join(ok, ["part_id", "wanted"], "left").select("part_id", "span_id", "form", F.coalesce("_ok", F.lit(False)).alias("ok"))
    pairs_exist = cylinders.groupBy("part_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("part_id")
    gaps = claims.where("form = 'distance' and both_centres").withColumn("wanted", F.col("printed_mm")).join(pairs_exist, "part_id", "left_semi")
    gap_ok = _gaps_found(cylinders, gaps.select("part_id", "wanted").distinct(), limit).withColumn("_ok", F.lit(True))
    gap_checks = gaps.join(gap_ok, ["part_id", "wanted"], "left").select("part_id", "span_id", "form", F.coalesce("_ok", F.lit(False)).alias("ok"))
    checks = size_checks.unionByName(gap_checks)
    return checks, claims.select("part_id").distinct().join(checks.groupBy("part_id").agg(F.count(F.lit(1)).alias("checked"), F.bool_and("ok").alias("ok")), "part_id", "left").fillna(0, ["checked"])


def score_answers(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """correct, partial, contradiction, unresolved, invalid or no_label per answer.

    ``answers`` (span_id, status, unresolved, kind, ids ARRAY<STRING>), ``expected`` (span_id, form, ids).
    """
    e = expected.select("span_id", F.col("form").alias("want_kind"), F.array_sort("ids").alias("want_ids"))
    j = answers.join(e, "span_id", "left")
    kind_ok, ids_ok = F.col("kind") == F.col("want_kind"), F.array_sort("ids") == F.col("want_ids")
    verdict = (
        F.when(F.col("want_kind").isNull(), "no_label").when(F.col("status") == "invalid", "invalid").when(F.col("unresolved"), "unresolved")
        .when(kind_ok & ids_ok, "correct").when(kind_ok & (F.size("want_ids") == 0), "partial").when(kind_ok | ids_ok, "partial").otherwise("contradiction"))
    return j.withColumn("verdict", verdict).drop("want_kind", "want_ids")


def review_verdicts(reviews: DataFrame) -> DataFrame:
    """caught, missed, false_alarm or kept, from (injected BOOLEAN, changed BOOLEAN)."""
    v = F.when(F.col("injected"), F.when(F.col("changed"), "caught").otherwise("missed")).otherwise(F.when(F.col("changed"), "false_alarm").otherwise("kept"))
    return reviews.withColumn("verdict", v)


def judge_answers(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Contract and self-consistency errors of answers, warnings apart, checks as columns.

    ``answers`` (span_id, answered_span_id, kind, between, matched, unresolved, question, reason); ``context``
    (span_id, allowed_ids, candidate_pairs ARRAY<ARRAY<STRING>>, own_ids).
    """
    j = answers.join(context, "span_id")
    used = F.array_union("between", "matched")
    pair = F.array_sort("between")
    pairs = F.transform("candidate_pairs", F.array_sort)
    two, many = F.col("kind").isin(*NEEDS_BETWEEN), F.col("kind").isin(*NEEDS_MATCHED)
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[A-Za-z_]+-?\d+", "").rlike(r"\d")
    un = F.col("unresolved")
    codes = {
        "wrong_source": F.col("answered_span_id") != F.col("span_id"),
        "unknown_ids": F.size(F.array_except(used, "allowed_ids")) > 0,
        "repeated_ids": (F.size(F.array_distinct("between")) != F.size("between")) | (F.size(F.array_distinct("matched")) != F.size("matched")),
        "no_question": un & (F.trim(F.coalesce("question", F.lit(""))) == ""),
        "unresolved_with_geometry": un & (F.size(used) > 0),
        "unresolved_with_kind": un & (F.col("kind") != "unclear") & (F.size("between") > 0),
        "unclear_not_unresolved": ~un & (F.col("kind") == "unclear"),
        "needs_two_ids": ~un & two & (F.size("between") != 2),
        "two_ids_not_matches": ~un & two & (F.size("matched") > 0),
        "needs_matches": ~un & many & (F.size("matched") == 0),
        "matches_not_two_ids": ~un & many & (F.size("between") > 0),
        "pair_not_a_candidate": ~un & two & (F.size("candidate_pairs") > 0) & ~F.array_contains(pairs, pair),
    }
    errors = F.array_compact(F.array(*[F.when(c, n) for n, c in codes.items()]))
    claimed = F.when(F.size("between") > 0, pair).otherwise(F.array_sort("matched"))
    out = j.withColumn("errors", errors).withColumn("warnings", F.array_compact(F.array(F.when(digits(F.col("reason")) | digits(F.col("question")), "number_outside_ids"))))
    status = F.when(F.size("errors") > 0, "invalid").when(un, "needs_input").otherwise("needs_review")
    return out.withColumn("status", status).withColumn("binding_confirmed", (F.size("own_ids") > 0) & (claimed == F.array_sort("own_ids")))


def _byte(seed: str, col: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed), col), 256), 1, 2), 16, 10).cast("int")


def inject_defects(proposals: DataFrame) -> DataFrame:
    """Half the rows, chosen by their id's hash, get one deterministic wrong binding (NULL ``defect`` otherwise)."""
    # The two seeds.
    hit = _byte("review-defect:", F.col("span_id")) % 2 == 0
    rule = _byte("review-rule:", F.col("span_id"))
    many = F.col("kind").isin(*NEEDS_MATCHED) & (F.size("matched") >= 2)
    two = F.col("kind").isin(*NEEDS_BETWEEN) & (F.size("between") == 2)
    spare = lambda used: F.get(F.array_sort(F.array_except("offered_ids", used)), F.lit(0))
    m, b = F.col("matched"), F.col("between")
    sm, sb = spare(m), spare(b)
    rest, front = F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0)))
    new_m = (F.when((rule % 3 == 0) & sm.isNotNull(), F.array_sort(F.concat(rest, F.array(sm)))).when(rule % 3 == 1, F.slice(m, 1, 1)).otherwise(F.array_sort(front)))
    new_b = F.when(sb.isNotNull(), F.when(rule % 2 == 0, F.array(sb, F.get(b, F.lit(1)))).otherwise(F.array(F.get(b, F.lit(0)), sb)))
    out = proposals.withColumn("injected", hit & (many | (two & sb.isNotNull())))
    return out.withColumn("defect_matched", F.when(F.col("injected") & many, new_m)).withColumn("defect_between", F.when(F.col("injected") & two, new_b))


# Absolute and relative tolerance of a bound diameter and of a printed value.
BOUND_TOLERANCE, PRINTED_TOLERANCE = (0.05, 0.01), (0.005, 0.002)


def _near(x: Column, tolerance: tuple[float, float]) -> Column:
    return F.abs(x - F.col("value")) <= F.greatest(F.lit(tolerance[0]), tolerance[1] * F.col("value"))


def _close(values: DataFrame, printed: DataFrame, keys: Sequence[str], tolerance: tuple[float, float]) -> DataFrame:
    """(keys, value, printed): the distinct numbers of a key that are near each other."""
    # On this scale a step is at least the tolerance at any size, so neighbours two steps away hold all that is near.
    step = lambda c: F.floor(F.ln(F.abs(c) + tolerance[0] / tolerance[1]) / tolerance[1])
    vals = values.select(*keys, "value").distinct().withColumn("_s", F.explode(F.array(*(step(F.col("value")) + i for i in range(-2, 3)))))
    marks = printed.select(*keys, "printed").distinct().withColumn("_s", step(F.col("printed")))
    return vals.join(marks, [*keys, "_s"]).where(_near(F.col("printed"), tolerance)).select(*keys, "value", "printed")


def evidence_level(decisions: DataFrame, claims: DataFrame, printed: DataFrame, keys: Sequence[str] = ("sheet_id",)) -> DataFrame:
    """bound (a claim ties the value to the decided geometry), present (the value is printed) or absent."""
    keys = list(keys)
    seen = _close(decisions, printed, keys, PRINTED_TOLERANCE).select(*keys, "value").distinct().withColumn("_p", F.lit(True))
    tied = decisions.select(*keys, "geometry_id", "value").distinct().join(claims.select(*keys, "geometry_id", "printed_mm").distinct(), [*keys, "geometry_id"])
    tied = tied.where(_near(F.col("printed_mm"), BOUND_TOLERANCE)).select(*keys, "geometry_id", "value").distinct().withColumn("_b", F.lit(True))
    out = decisions.join(seen, [*keys, "value"], "left").join(tied, [*keys, "geometry_id", "value"], "left")
    return out.withColumn("level", F.when(F.col("_b"), "bound").when(F.col("_p"), "present").otherwise("absent")).drop("_p", "_b")


# Fixed value: how far, on each axis, a point may stand from a centre or an edge's end.
POINT_TOLERANCE = 2.0


def _places(circles: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, ax, ay): the centre of a circle, the ends of an edge, each place of a geometry once."""
    ends = edges.select(*keys, "id", F.inline(F.array(F.struct(F.col("x0").alias("ax"), F.col("y0").alias("ay")), F.struct(F.col("x1").alias("ax"), F.col("y1").alias("ay")))))
    return circles.select(*keys, "id", F.col("cx").alias("ax"), F.col("cy").alias("ay")).unionByName(ends).distinct()


def _met(points: DataFrame, places: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Distinct points (x, y) with every row of ``places`` (ax, ay, ...) within ``tolerance`` on both axes, each pair once."""
    size = 2 * tolerance
    visit = lambda c: F.explode(neighbours(F.col(c), size, tolerance + 1e-6))  # a hair more, so that rounding loses no touching pair
    spots = points.select(*keys, "x", "y").distinct().withColumn("_cx", visit("x")).withColumn("_cy", visit("y"))
    placed = places.withColumn("_cx", cell(F.col("ax"), size)).withColumn("_cy", cell(F.col("ay"), size))
    near = (F.abs(F.col("ax") - F.col("x")) <= tolerance) & (F.abs(F.col("ay") - F.col("y")) <= tolerance)
    return spots.join(placed, [*keys, "_cx", "_cy"]).where(near).drop("_cx", "_cy")


def geometry_at(points: DataFrame, circles: DataFrame, edges: DataFrame, keys: Sequence[str] = ("sheet_id",), tolerance: float = POINT_TOLERANCE) -> DataFrame:
    """(keys, x, y, geometry_id): circles (id, cx, cy) whose centre, and edges (id, x0, y0, x1, y1) with an end, at a distinct point (x, y).

    Near means within ``tolerance`` on both axes. Anchors keep to their cell and points visit at most four, so hot sheets are
    split by cell; repeated points and anchors meet once.
    """
    keys = list(keys)
    return _met(points, _places(circles, edges, keys), keys, tolerance).select(*keys, "x", "y", F.col("id").alias("geometry_id")).distinct()


def _counted(places: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """(keys, ax, ay, tag, n): how many geometries of ``_places`` stand at a place, without their ids.

    No point meets two places of a geometry that has one, or two far apart, so those have no tag and their numbers add up.
    Where a point may meet both places of a geometry, all with the same two share a tag and their number counts once; one
    with more places has a tag of its own.
    """
    ends = places.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("ax", "ay")).alias("lo"), F.max(F.struct("ax", "ay")).alias("hi"))
    wide = 2 * tolerance + 1e-6
    apart = (F.abs(F.col("lo.ax") - F.col("hi.ax")) > wide) | (F.abs(F.col("lo.ay") - F.col("hi.ay")) > wide)
    tag = F.when((F.col("_n") > 1) & ~((F.col("_n") == 2) & apart), F.struct("lo", "hi", F.when(F.col("_n") > 2, F.col("id").cast("string")).alias("own")))
    return places.join(ends.select(*keys, "id", tag.alias("tag")), [*keys, "id"]).groupBy(*keys, "ax", "ay", "tag").agg(F.count(F.lit(1)).alias("n"))


def point_evidence(
    decisions: DataFrame, circles: DataFrame, edges: DataFrame, claims: DataFrame, printed: DataFrame, keys: Sequence[str] = ("sheet_id",),
) -> DataFrame:
    """Decisions (x, y, value) with ``n_geometry`` at their point and the best ``level`` that the value has on any of it.

    Without geometry, or without a point, a value can only be present or absent; a null value is absent. Points meet places,
    with the number of geometries there and the distinct values claimed of them, and not each geometry of a crowded place.
    """
    keys = list(keys)
    places = cut(_places(circles, edges, keys).where("id is not null"))
    met = _met(decisions, _counted(places, keys, POINT_TOLERANCE), keys, POINT_TOLERANCE).groupBy(*keys, "x", "y", "tag").agg(
        F.when(F.col("tag").isNull(), F.sum("n")).otherwise(F.max("n")).alias("n"))
    counts = met.groupBy(*keys, "x", "y").agg(F.sum("n").alias("n_geometry"))
    claimed = places.join(claims.select(*keys, F.col("geometry_id").alias("id"), F.col("printed_mm").alias("printed")).distinct(), [*keys, "id"]).select(*keys, "ax", "ay", "printed").distinct()
    held = _met(decisions, claimed, keys, POINT_TOLERANCE).select(*keys, "x", "y", "printed").distinct()
    ties = _close(decisions, claims.select(*keys, F.col("printed_mm").alias("printed")), keys, BOUND_TOLERANCE)
    tied = held.join(ties, [*keys, "printed"]).select(*keys, "x", "y", "value").distinct().withColumn("_b", F.lit(True))
    seen = _close(decisions, printed, keys, PRINTED_TOLERANCE).select(*keys, "value").distinct().withColumn("_p", F.lit(True))
    out = decisions.join(counts, [*keys, "x", "y"], "left").join(tied, [*keys, "x", "y", "value"], "left").join(seen, [*keys, "value"], "left")
    level = F.when(F.col("_b"), "bound").when(F.col("_p"), "present").otherwise("absent")
    return out.select(*decisions.columns, F.coalesce("n_geometry", F.lit(0)).alias("n_geometry"), level.alias("level"))


def detector_score(df: DataFrame, predicted: str, truth: str, keys: Sequence[str] = ()) -> DataFrame:
    p, t = F.col(predicted), F.col(truth)
    out = df.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return out.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def separability(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Per feature: gap of the class medians over the population deviation of all rows."""
    rows = df.select(label, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))).where("v is not null")
    counts = rows.groupBy("feature", label, "v").agg(F.count(F.lit(1)).alias("n"))
    med = rank_value(counts, ["feature", label], "v", "n", "median", "mean")
    gap = med.groupBy("feature").agg((F.max(F.when(F.col(label), F.col("median"))) - F.max(F.when(~F.col(label), F.col("median")))).alias("median_gap"))
    dev = rows.groupBy("feature").agg(F.stddev_pop("v").alias("deviation"))
    return gap.join(dev, "feature").withColumn("separability", F.try_divide(F.abs("median_gap"), F.col("deviation")))


def agreed_value(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The only value of a key, or its most repeated one (at least twice; first seen on ties), else NULL."""
    keys = list(keys)
    counts = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    out = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct_values"), F.max_by(F.struct("value", "n"), F.struct("n", -F.col("ord"))).alias("top"))
    value = F.when((F.col("distinct_values") == 1) | (F.col("top.n") >= 2), F.col("top.value"))
    return out.select(*keys, "distinct_values", value.alias("agreed"), (F.col("distinct_values") - F.when(value.isNotNull(), 1).otherwise(0)).alias("alternatives"))


def circular_basis(claims: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Claims whose corroborating size equals their own or another evaluated size of the page (within 1e-9)."""
    keys = list(keys)
    nano = lambda c: F.round(c * 1e8, 0).cast("long")
    sizes = claims.where("size is not null").select(*keys, F.col("size").alias("_s")).distinct().withColumn("_b", nano(F.col("_s")))
    asked = claims.where("basis is not null").withColumn("_b", F.explode(F.array(*[nano(F.col("basis")) + d for d in (-1, 0, 1)])))
    hit = asked.join(sizes, [*keys, "_b"]).where(F.abs(F.col("basis") - F.col("_s")) <= 1e-9).select(*keys, "claim_id").distinct()
    own = claims.where(F.abs(F.col("basis") - F.col("size")) <= 1e-9).select(*keys, "claim_id").distinct().withColumn("_own", F.lit(True))
    return hit.join(own, [*keys, "claim_id"], "left").withColumn("code", F.when(F.col("_own"), "basis_is_own_size").otherwise("basis_is_evaluated_size")).drop("_own")
