"""Tables of drawn geometry: phrases, intervals, fitted primitives, borders, contours, families, views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import geometry as g
from draftlake.functions.staging import stage
from draftlake.functions.text import extract_dimensions
from draftlake.operators.graph import first_members, lead_groups
from draftlake.operators.grid import box_pairs, cell, near_values, neighbours
from draftlake.operators.scan import has_hot_group, lag_value, running_max_before, running_sum, top_k
from draftlake.session import cut

SHEET = ["sheet_id"]
PI = 3.141592653589793


def _sessions(df: DataFrame, keys: list[str], order: list[Column], fresh: Column, out: str, hot: bool) -> DataFrame:
    return running_sum(df.withColumn("_new", fresh.cast("long")), keys, order, F.col("_new"), out, hot).drop("_new")


def _gaps(a: str, b: str, axis: str) -> tuple[Column, Column, Column]:
    """(gap along, overlap across, size across) of two character boxes, for a row or a column."""
    c = lambda who, n: F.col(f"{who}.{n}")
    (s, e), (lo, hi) = (("left", "right"), ("bottom", "top")) if axis == "row" else (("bottom", "top"), ("left", "right"))
    gap = F.greatest(F.lit(0.0), F.greatest(c(a, s), c(b, s)) - F.least(c(a, e), c(b, e)))
    over = F.least(c(a, hi), c(b, hi)) - F.greatest(c(a, lo), c(b, lo))
    ea, eb = c(a, hi) - c(a, lo), c(b, hi) - c(b, lo)
    big = F.greatest(ea, eb)
    near = (gap <= 0.9 * F.when(big == 0, 1.0).otherwise(big)) & (over > 0.5 * F.least(ea, eb))
    return near, gap, big


def group_phrases(chars: DataFrame) -> DataFrame:
    """Consecutive characters joined while neighbours along a row or a column: phrase text, box, members.

    ``chars`` (sheet_id, ord, char, left, bottom, right, top), without whitespace.
    """
    hot = has_hot_group(chars, SHEET)
    me = F.struct("left", "bottom", "right", "top")
    c = lag_value(chars.withColumn("b", me), SHEET, [F.col("ord")], me, "a", hot)
    row, row_gap, row_big = _gaps("a", "b", "row")
    col, col_gap, col_big = _gaps("a", "b", "column")
    joined = F.coalesce(row | col, F.lit(False))
    spaced = F.when(row, row_gap > 0.3 * row_big).otherwise(col_gap > 0.3 * col_big)
    space = joined & F.coalesce(spaced, F.lit(False)) & ~F.col("char").isin(".", ",", ":", ";", "°")
    c = c.withColumn("piece", F.concat(F.when(space, F.lit(" ")).otherwise(F.lit("")), F.col("char"))).withColumn("_fresh", ~joined)
    c = _sessions(c, SHEET, [F.col("ord")], F.col("_fresh"), "phrase_no", hot)
    # One phrase is one printed run of neighbouring characters.
    return c.groupBy("sheet_id", "phrase_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "piece"))), lambda p: p["piece"]), "").alias("text"),
        F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"),
        F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("chars"))


def merge_intervals(df: DataFrame, keys: Sequence[str], gap: Column | float) -> DataFrame:
    """Intervals (low, high) merged while the next starts within ``gap`` of everything before it."""
    keys = list(keys)
    gap = gap if isinstance(gap, Column) else F.lit(float(gap))
    # Equal starts collapse first: only their farthest end matters.
    base = df.groupBy(*keys, "low").agg(F.max("high").alias("high"), F.count(F.lit(1)).alias("n"))
    hot = has_hot_group(df, keys)
    seen = running_max_before(base, keys, [F.col("low")], F.col("high"), "_top", hot)
    fresh = F.coalesce(F.col("low") - F.col("_top") > gap, F.lit(True))
    out = _sessions(seen, keys, [F.col("low")], fresh, "interval_no", hot)
    return out.groupBy(*keys, "interval_no").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("members"))


def word_lines(words: DataFrame) -> DataFrame:
    """``words`` with ``line_mid``: from top to bottom by centre, a word belongs to a line while its centre is near the first word's.

    Near is 0.6 of the first word's height; words of one centre go from left to right. ``line_mid`` is the first word's
    centre.
    """
    w = words.withColumn("_mid", F.col("top") + F.col("height") / 2)
    return first_members(w, SHEET, "_mid", F.col("_mid") + 0.6 * F.col("height"), ["left", "ord"], "line_mid")


def words_to_phrases(words: DataFrame) -> DataFrame:
    """Recognised words into printed phrases: lines by their first word's centre, then gaps of at most 1.5 heights.

    ``words`` (sheet_id, ord, text, left, top, width, height, confidence).
    """
    hot = has_hot_group(words, SHEET)
    w = cut(word_lines(words))
    line = ["sheet_id", "line_mid"]
    order = [F.col("left"), F.col("ord")]
    w = lag_value(w, line, order, F.struct("left", "width", "height"), "p", hot)
    wide = F.coalesce(F.col("left") - (F.col("p.left") + F.col("p.width")) > 1.5 * F.greatest(F.col("height"), F.col("p.height")), F.lit(True))
    w = _sessions(w, line, order, wide, "phrase_no", hot)
    out = w.groupBy(*line, "phrase_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "ord", "text"))), lambda p: p["text"]), " ").alias("text"),
        F.min("left").alias("x"), F.min("top").alias("y"), (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("w"),
        (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("h"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("words"))
    out = extract_dimensions(out, "text").withColumnRenamed("dim_value", "_plain").drop("dim_count", "dim_kind", "dim_unit")
    out = extract_dimensions(out.withColumn("_tight", F.regexp_replace("text", " ", "")), "_tight").drop("dim_count", "dim_kind", "dim_unit")
    split = F.col("_plain").isNull() & F.col("dim_value").isNotNull()
    return out.withColumn("text", F.when(split, F.col("_tight")).otherwise(F.col("text"))).drop("_plain", "_tight", "dim_value").where("text <> ''")


def one_per_line(spans: DataFrame, step: float = 8.0) -> DataFrame:
    """The fullest number per dimension line; unattached spans all stay."""
    a, b = F.col("anchors")[0], F.col("anchors")[1]
    two = spans.where(F.size("anchors") == 2)
    key = [F.rint(F.least(a[0], b[0]) / step).alias("_k0"), F.rint(F.least(a[1], b[1]) / step).alias("_k1"),
           F.rint(F.greatest(a[0], b[0]) / step).alias("_k2"), F.rint(F.greatest(a[1], b[1]) / step).alias("_k3")]
    kept = top_k(two.select("*", *key), ["sheet_id", "_k0", "_k1", "_k2", "_k3"], [-(F.col("w") * F.col("h")), F.col("ord")], 1)
    return kept.drop("_k0", "_k1", "_k2", "_k3").unionByName(spans.where(F.size("anchors") != 2))


def _fit_mean(s: Column) -> dict[str, Column]:
    n = F.size(s["points"]).cast("double")
    mean = lambda i: F.aggregate(s["points"], F.lit(0.0), lambda t, p: t + p[i]) / n
    return {"points": s["points"], "closed": s["closed"], "n": n, "mx": mean(0), "my": mean(1)}


def _fit_sums(s: Column) -> dict[str, Column]:
    u, v = (lambda p: p[0] - s["mx"]), (lambda p: p[1] - s["my"])
    sq = lambda p: u(p) * u(p) + v(p) * v(p)
    total = lambda f: F.aggregate(s["points"], F.lit(0.0), lambda t, p: t + f(p))
    return {"points": s["points"], "closed": s["closed"], "n": s["n"], "mx": s["mx"], "my": s["my"],
            "uu": total(lambda p: u(p) * u(p)), "vv": total(lambda p: v(p) * v(p)), "uv": total(lambda p: u(p) * v(p)),
            "ut": total(lambda p: u(p) * sq(p)), "vt": total(lambda p: v(p) * sq(p))}


def _fit_centre(s: Column) -> dict[str, Column]:
    det = 2 * (s["uu"] * s["vv"] - s["uv"] * s["uv"])
    return {"points": s["points"], "closed": s["closed"], "mx": s["mx"], "my": s["my"], "spread": (s["uu"] + s["vv"]) / s["n"],
            "u": F.try_divide(s["ut"] * s["vv"] - s["vt"] * s["uv"], det), "v": F.try_divide(s["vt"] * s["uu"] - s["ut"] * s["uv"], det)}


def _fit_ring(s: Column) -> dict[str, Column]:
    sq = s["u"] * s["u"] + s["v"] * s["v"] + s["spread"]
    return {"points": s["points"], "closed": s["closed"], "cx": s["mx"] + s["u"], "cy": s["my"] + s["v"], "r": F.when(sq > 0, F.sqrt(sq))}


def _fit_residual(s: Column) -> dict[str, Column]:
    worst = F.array_max(F.transform(s["points"], lambda p: F.abs(g.hypot(p[0] - s["cx"], p[1] - s["cy"]) - s["r"])))
    angles = F.transform(s["points"], lambda p: F.atan2(p[1] - s["cy"], p[0] - s["cx"]))
    return {"points": s["points"], "closed": s["closed"], "cx": s["cx"], "cy": s["cy"], "r": s["r"], "worst": worst, "ang": angles}


def _fit_sweep(s: Column) -> dict[str, Column]:
    wrap = lambda x: x - 2 * PI * F.floor((x + PI) / (2 * PI))
    tail, head = F.slice(s["ang"], 2, F.greatest(F.size(s["ang"]) - 1, F.lit(0))), F.slice(s["ang"], 1, F.greatest(F.size(s["ang"]) - 1, F.lit(0)))
    turns = F.aggregate(F.zip_with(tail, head, lambda b, a: wrap(b - a)), F.lit(0.0), lambda t, x: t + x)
    line = (F.size(s["points"]) == 2) & ~s["closed"]
    fits = F.coalesce((F.size(s["points"]) >= 8) & (s["r"] >= 3.0) & (s["worst"] <= F.greatest(F.lit(0.6), 0.005 * s["r"])), F.lit(False))
    return {"points": s["points"], "closed": s["closed"], "cx": s["cx"], "cy": s["cy"], "r": s["r"], "worst": s["worst"],
            "start": F.degrees(F.get(s["ang"], F.lit(0))), "sweep": F.degrees(turns), "line": line, "fits": fits}


def _fit_kind(s: Column) -> dict[str, Column]:
    kind = F.when(s["line"], "line").when(s["fits"] & (s["closed"] | (F.abs(s["sweep"]) >= 355)), "circle").when(s["fits"] & (F.abs(s["sweep"]) >= 5), "arc")
    a, z = s["points"][0], F.element_at(s["points"], -1)
    at = lambda c: F.when(s["line"], F.bround(c, 2))
    ring = lambda c: F.when(~s["line"], F.bround(c, 2))
    return {"kind": kind, "x0": at(a[0]), "y0": at(a[1]), "x1": at(z[0]), "y1": at(z[1]), "cx": ring(s["cx"]), "cy": ring(s["cy"]), "r": ring(s["r"]),
            "start_degrees": ring(s["start"]), "end_degrees": ring(s["start"] + s["sweep"]), "max_residual_px": ring(s["worst"])}


def fit_primitives(paths: DataFrame) -> DataFrame:
    """Each path as a line, circle or arc, or dropped as a polyline. Works inside the row: no shuffle.

    ``paths`` (sheet_id, id, ord, closed, points ARRAY<ARRAY<DOUBLE>>). Circles are least-squares fits about the
    mean point; the worst residual must stay within max(0.6 px, 0.5 % of the radius).
    """
    state = F.struct("points", "closed")
    for step in (_fit_mean, _fit_sums, _fit_centre, _fit_ring, _fit_residual, _fit_sweep, _fit_kind):
        state = stage(state, step)
    return paths.select("sheet_id", F.col("id").alias("path_id"), "ord", state.alias("fit")).where("fit.kind is not null").select(
        "sheet_id", "path_id", "ord", "fit.*")


def sheet_frame(paths: DataFrame, frames: DataFrame, share: float = 0.8) -> DataFrame:
    """The sheet's border: its largest closed path covering ``share`` of both page sides; tilt of its longest edge."""
    xs, ys = F.transform("points", lambda p: p[0]), F.transform("points", lambda p: p[1])
    legs = F.zip_with(F.slice("points", 1, F.size("points") - 1), F.slice("points", 2, F.size("points") - 1),
                      lambda a, b: F.struct(g.hypot(b[0] - a[0], b[1] - a[1]).alias("len"), F.degrees(F.atan2(b[1] - a[1], b[0] - a[0])).alias("deg")))
    d = paths.where(F.col("closed") & (F.size("points") >= 4)).join(frames.select("sheet_id", "width", "height"), "sheet_id").select(
        "sheet_id", "id", "ord", "width", "height", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), F.array_max(legs)["deg"].alias("deg"))
    wide = (F.col("x1") - F.col("x0") >= share * F.col("width")) & (F.col("y1") - F.col("y0") >= share * F.col("height"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    best = d.where(wide).groupBy("sheet_id").agg(F.max_by(F.struct("id", "x0", "y0", "x1", "y1", "deg", (area / (F.col("width") * F.col("height"))).alias("coverage")), F.struct(area, -F.col("ord"))).alias("b"))
    tilt = F.col("b.deg") - 90 * F.rint(F.col("b.deg") / 90)
    out = best.select("sheet_id", "b.id", "b.x0", "b.y0", "b.x1", "b.y1", "b.coverage", tilt.alias("tilt_degrees"))
    return frames.select("sheet_id").join(out, "sheet_id", "left").withColumn("state", F.when(F.col("id").isNull(), "no_border").when(F.abs("tilt_degrees") <= 0.5, "aligned").otherwise("tilted"))


def edge_turns(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gap to the following edge and the turn between them; the last edge is followed by the first.

    ``edges`` (keys, pos 0.., x0, y0, x1, y1). The successor comes by an equi-join on (keys, pos), so a contour of
    any length is spread over tasks.
    """
    keys = list(keys)
    size = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    nxt = edges.select(*keys, F.col("pos").alias("_np"), F.col("id").alias("next_id"), *[F.col(c).alias(f"n{c}") for c in ("x0", "y0", "x1", "y1")])
    j = edges.join(size, keys).withColumn("_np", (F.col("pos") + 1) % F.col("n")).join(nxt, [*keys, "_np"])
    ax, ay, bx, by = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("nx1") - F.col("nx0"), F.col("ny1") - F.col("ny0")
    cos = F.try_divide(ax * bx + ay * by, g.hypot(ax, ay) * g.hypot(bx, by))
    turn = F.degrees(F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))))
    return j.withColumn("gap_px", g.hypot(F.col("nx0") - F.col("x1"), F.col("ny0") - F.col("y1"))).withColumn("turn_degrees", turn).drop("_np")


def _chain(samples: int) -> Column:
    """Points of an edge; arcs are sampled from their canonical angles (page y grows downwards)."""
    lo, sweep = F.radians(-F.col("a")), F.radians(-(F.col("b") - F.col("a")))
    arc = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.struct(
        (F.col("cx") + F.col("r") * F.cos(lo + sweep * i / (samples - 1))).alias("x"), (F.col("cy") + F.col("r") * F.sin(lo + sweep * i / (samples - 1))).alias("y")))
    line = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    return F.when((F.col("kind") == "arc") & F.col("cx").isNotNull(), arc).otherwise(line)


def _shoelace(df: DataFrame, keys: list[str]) -> DataFrame:
    """Signed area per key over edges with ``_pts`` and ``pos``: inner terms per row, joints by an equi-join."""
    inner = F.aggregate(F.zip_with(F.slice("_pts", 1, F.size("_pts") - 1), F.slice("_pts", 2, F.size("_pts") - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    e = df.select(*keys, "pos", inner.alias("_in"), F.element_at("_pts", -1).alias("_l"), F.get("_pts", F.lit(0)).alias("_f"))
    nxt = e.select(*keys, F.col("pos").alias("_np"), F.col("_f").alias("_g"))
    j = e.join(n, keys).withColumn("_np", (F.col("pos") + 1) % F.col("_n")).join(nxt, [*keys, "_np"])
    joint = F.col("_l.x") * F.col("_g.y") - F.col("_g.x") * F.col("_l.y")
    return j.groupBy(*keys).agg((F.sum(F.col("_in") + joint) / 2).alias("area"))


def loop_shape(edges: DataFrame, keys: Sequence[str] = ("sheet_id", "loop_id"), samples: int = 12) -> DataFrame:
    """Area, box and rounded-rectangle test (four axis-aligned lines, four quarter arcs of one radius) per loop."""
    keys = list(keys)
    e = edges.withColumn("_pts", _chain(samples))
    area = _shoelace(e, keys)
    arc, line = F.col("kind") == "arc", F.col("kind") == "line"
    slanted = line & (F.abs(F.col("x0") - F.col("x1")) > 1.0) & (F.abs(F.col("y0") - F.col("y1")) > 1.0)
    not_quarter = arc & (F.abs(F.abs(F.col("b") - F.col("a")) - 90) > 5)
    s = e.groupBy(*keys).agg(
        F.count_if(line).alias("lines"), F.count_if(arc).alias("arcs"), F.count_if(slanted).alias("slanted"), F.count_if(not_quarter).alias("odd_arcs"),
        F.avg(F.when(arc, F.col("r"))).alias("radius"), F.min(F.when(arc, F.col("r"))).alias("r_min"), F.max(F.when(arc, F.col("r"))).alias("r_max"),
        F.min(F.least("x0", "x1")).alias("bx0"), F.min(F.least("y0", "y1")).alias("by0"), F.max(F.greatest("x0", "x1")).alias("bx1"), F.max(F.greatest("y0", "y1")).alias("by1"))
    even = F.greatest(F.abs(F.col("r_max") - F.col("radius")), F.abs(F.col("r_min") - F.col("radius"))) <= 0.02 * F.col("radius")
    rounded = (F.col("lines") == 4) & (F.col("arcs") == 4) & (F.col("slanted") == 0) & (F.col("odd_arcs") == 0) & F.coalesce(even, F.lit(False))
    return s.join(area, keys).withColumn("area", F.abs("area")).withColumn("rounded_rectangle", rounded).drop("slanted", "odd_arcs", "r_min", "r_max")


TOL, SUPPORT, STROKE, MIN_SHARED = 0.5, 0.35, 1.0, 1.0


def audit_contours(edges: DataFrame, keys: Sequence[str] = ("sheet_id", "profile_id"), tol: float = TOL) -> DataFrame:
    """Issues of ordered contours, one row each: (keys, kind, id, other_id, x, y).

    ``edges`` (keys, pos, id, kind, x0, y0, x1, y1, cx, cy, r, a, b). Pairs of edges meet only where their boxes do
    (grid join), so long contours stay near-linear.
    """
    keys = list(keys)
    c = F.col
    issue = lambda df, kind, other=None, x="x0", y="y0": df.select(
        *keys, F.lit(kind).alias("kind"), c("id").alias("id"), (F.lit(None).cast("string") if other is None else c(other).cast("string")).alias("other_id"), F.bround(c(x), 2).alias("x"), F.bround(c(y), 2).alias("y"))
    turns = edge_turns(edges, keys)
    out = issue(turns.where(c("gap_px") > tol), "open", "next_id", "x1", "y1")
    arc = (c("kind") == "arc") & c("cx").isNotNull()
    length = F.when(c("kind") == "arc", F.abs(F.radians(c("b") - c("a")) * c("r"))).otherwise(g.hypot(c("x1") - c("x0"), c("y1") - c("y0")))
    out = out.unionByName(issue(edges.where(length <= tol), "zero_length"))
    sweep = F.abs(c("b") - c("a"))
    out = out.unionByName(issue(edges.where(arc & (sweep <= 1e-9)), "arc_zero_sweep")).unionByName(issue(edges.where(arc & (sweep >= 360.0)), "arc_full_turn"))
    end = lambda deg: (c("cx") + c("r") * F.cos(F.radians(-c(deg))), c("cy") + c("r") * F.sin(F.radians(-c(deg))))
    (sx, sy), (ex, ey) = end("a"), end("b")
    out = out.unionByName(issue(edges.where(arc & (g.hypot(sx - c("x0"), sy - c("y0")) > tol)), "arc_start_mismatch"))
    out = out.unionByName(issue(edges.where(arc & (g.hypot(ex - c("x1"), ey - c("y1")) > tol)), "arc_end_mismatch", None, "x1", "y1"))

    # Pairs whose boxes touch.
    n = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    box = lambda lo, hi, mid, sign: F.when(arc, c(mid) + sign * c("r")).otherwise(F.least(c(lo), c(hi)) if sign < 0 else F.greatest(c(lo), c(hi)))
    boxed = edges.join(n, keys).withColumns({"bx0": box("x0", "x1", "cx", -1), "by0": box("y0", "y1", "cy", -1), "bx1": box("x0", "x1", "cx", 1), "by1": box("y0", "y1", "cy", 1), "is_arc": arc})
    cols = ["pos", "id", "kind", "is_arc", "x0", "y0", "x1", "y1", "cx", "cy", "r", "a", "b", "bx0", "by0", "bx1", "by1"]
    left = boxed.select(*keys, "n", *[c(k).alias(f"p_{k}") for k in cols])
    right = boxed.select(*keys, *[c(k).alias(f"q_{k}") for k in cols])
    names = ("bx0", "by0", "bx1", "by1")
    pairs = box_pairs(left, right, keys, 64.0, [f"p_{k}" for k in names], [f"q_{k}" for k in names], max(tol, STROKE)).where("p_pos < q_pos")
    neighbours_ = (c("q_pos") == c("p_pos") + 1) | ((c("p_pos") == 0) & (c("q_pos") == c("n") - 1))
    pairs = pairs.withColumn("adjacent", neighbours_)
    P, Q = [c(f"p_{k}") for k in ("x0", "y0", "x1", "y1")], [c(f"q_{k}") for k in ("x0", "y0", "x1", "y1")]
    span = lambda p: g.arc_span(c(f"{p}_a"), c(f"{p}_b"))
    (pa, ps), (qa, qs) = span("p"), span("q")
    both_arcs = c("p_is_arc") & c("q_is_arc")
    both_lines = ~c("p_is_arc") & ~c("q_is_arc")
    same_ring = both_arcs & (g.hypot(c("p_cx") - c("q_cx"), c("p_cy") - c("q_cy")) <= SUPPORT) & (F.abs(c("p_r") - c("q_r")) <= SUPPORT)
    ring_over = same_ring & (g.arc_overlap(pa, ps, qa, qs) > F.greatest(F.lit(0.02), F.try_divide(F.lit(2.0), c("p_r") + c("q_r"))))
    pl, ql = g.hypot(P[2] - P[0], P[3] - P[1]), g.hypot(Q[2] - Q[0], Q[3] - Q[1])
    ux, uy = F.try_divide(P[2] - P[0], pl), F.try_divide(P[3] - P[1], pl)
    parallel = F.abs(ux * (Q[3] - Q[1]) - uy * (Q[2] - Q[0])) <= 1e-3 * ql
    offset = F.abs(ux * (Q[1] - P[1]) - uy * (Q[0] - P[0]))
    t0, t1 = ux * (Q[0] - P[0]) + uy * (Q[1] - P[1]), ux * (Q[2] - P[0]) + uy * (Q[3] - P[1])
    shared = F.least(pl, F.greatest(t0, t1)) - F.greatest(F.lit(0.0), F.least(t0, t1))
    line_over = both_lines & (pl >= 1e-9) & (ql >= 1e-9) & parallel & (offset <= max(STROKE, tol)) & (shared > MIN_SHARED)
    pair_issue = lambda df, kind, x, y: df.select(*keys, F.lit(kind).alias("kind"), c("p_id").alias("id"), c("q_id").cast("string").alias("other_id"), F.bround(x, 2).alias("x"), F.bround(y, 2).alias("y"))
    out = out.unionByName(pair_issue(pairs.where(F.coalesce(ring_over, F.lit(False)) | F.coalesce(line_over, F.lit(False))), "overlap", P[0], P[1]))

    # Crossings: line-line by parameters, line-arc by the quadratic, arc-arc by the radical line.
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def on_arc(p: Column, who: str) -> Column:
        phi, sw = span(who)
        ang = F.atan2(p["y"] - c(f"{who}_cy"), p["x"] - c(f"{who}_cx"))
        gone = F.pmod(F.when(sw >= 0, ang - phi).otherwise(phi - ang), F.lit(2 * PI))
        eps = F.try_divide(F.lit(tol), F.greatest(c(f"{who}_r"), F.lit(1e-9)))
        return (gone > eps) & (gone < F.abs(sw) - eps)

    def line_arc(L, who: str) -> Column:
        dx, dy = L[2] - L[0], L[3] - L[1]
        fx, fy = L[0] - c(f"{who}_cx"), L[1] - c(f"{who}_cy")
        qa_, qb, qc = dx * dx + dy * dy, 2 * (dx * fx + dy * fy), fx * fx + fy * fy - c(f"{who}_r") * c(f"{who}_r")
        root = F.when(qb * qb - 4 * qa_ * qc >= 0, F.sqrt(F.greatest(qb * qb - 4 * qa_ * qc, F.lit(0.0))))
        ts = F.array(F.try_divide(-qb - root, 2 * qa_), F.try_divide(-qb + root, 2 * qa_))
        ok = F.filter(ts, lambda t: t.isNotNull() & t.between(-1e-9, 1 + 1e-9) & (qa_ >= 1e-12))
        hits = F.transform(ok, lambda t: pt(L[0] + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * dx, L[1] + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * dy))
        return F.filter(hits, lambda p: on_arc(p, who))

    dcx, dcy = c("q_cx") - c("p_cx"), c("q_cy") - c("p_cy")
    dist = g.hypot(dcx, dcy)
    along = F.try_divide(c("p_r") * c("p_r") - c("q_r") * c("q_r") + dist * dist, 2 * dist)
    h2 = c("p_r") * c("p_r") - along * along
    reach = (dist >= 1e-9) & (dist <= c("p_r") + c("q_r")) & (dist >= F.abs(c("p_r") - c("q_r"))) & (h2 >= 0)
    h = F.sqrt(F.greatest(h2, F.lit(0.0)))
    bx, by = c("p_cx") + F.try_divide(along * dcx, dist), c("p_cy") + F.try_divide(along * dcy, dist)
    nx, ny = F.try_divide(-dcy, dist), F.try_divide(dcx, dist)
    none = F.array().cast("array<struct<x:double,y:double>>")
    rings = F.when(reach, F.when(h2 <= 1e-18, F.array(pt(bx, by))).otherwise(F.array(pt(bx + h * nx, by + h * ny), pt(bx - h * nx, by - h * ny)))).otherwise(none)
    rings = F.filter(rings, lambda p: on_arc(p, "p") & on_arc(p, "q"))
    meet = g.segments_meet(P, Q)
    met = (
        F.when(both_arcs, rings).when(c("p_is_arc"), line_arc(Q, "p")).when(c("q_is_arc"), line_arc(P, "q"))
        .otherwise(F.when(meet.isNotNull(), F.array(meet)).otherwise(none)))
    hits = pairs.withColumn("_m", F.explode(met))
    near = lambda E: F.least(g.hypot(c("_m.x") - E[0], c("_m.y") - E[1]), g.hypot(c("_m.x") - E[2], c("_m.y") - E[3])) <= tol
    hits = hits.where(~(c("adjacent") & near(P) & near(Q)))
    out = out.unionByName(pair_issue(hits, "self_intersection", c("_m.x"), c("_m.y")))

    def touch(x, y, L, who: str) -> Column:
        ring = (F.abs(g.hypot(x - c(f"{who}_cx"), y - c(f"{who}_cy")) - c(f"{who}_r")) <= tol) & on_arc(pt(x, y), who)
        return F.coalesce(F.when(c(f"{who}_is_arc"), ring).otherwise(g.on_interior(x, y, L, tol)), F.lit(False))

    spots = F.array_compact(F.array(*[F.when(touch(x, y, L, who), F.struct(x.alias("x"), y.alias("y"), F.lit(who).alias("on"))) for (E, L, who) in ((P, Q, "q"), (Q, P, "p")) for (x, y) in ((E[0], E[1]), (E[2], E[3]))]))
    rest = pairs.where(~c("adjacent")).withColumn("_t", F.explode(spots))
    out = out.unionByName(rest.select(*keys, F.lit("endpoint_touch").alias("kind"), F.when(c("_t.on") == "q", c("p_id")).otherwise(c("q_id")).alias("id"),
                                      F.when(c("_t.on") == "q", c("q_id")).otherwise(c("p_id")).cast("string").alias("other_id"), F.bround(c("_t.x"), 2).alias("x"), F.bround(c("_t.y"), 2).alias("y")))
    area = _shoelace(edges.withColumn("_pts", _chain(32)), keys).join(n.where("n > 1"), keys).where(F.abs("area") <= max(tol * tol, 1.0))
    flat = area.join(edges.where("pos = 0"), keys)
    return out.unionByName(issue(flat, "zero_area"))


def _led_classes(items: DataFrame, same: list[str], pairs_of, out: str) -> DataFrame:
    """``items`` with ``out``, the first member of their group; equal ones (by ``same``) are one item while groups are found.

    An item equal to an earlier one meets the same first members, and leaders that came in between come later.
    """
    classes = cut(items.groupBy("sheet_id", *same).agg(F.min("ord").alias("ord")))
    led = lead_groups(classes, pairs_of(classes), SHEET).select("sheet_id", "ord", F.col("leader").alias(out))
    return items.join(classes.join(led, ["sheet_id", "ord"]).drop("ord"), ["sheet_id", *same])


def _either_way(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select("sheet_id", F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late"))


def circle_families(circles: DataFrame) -> DataFrame:
    """Concentric families: each circle joins the first earlier family whose first circle shares its centre.

    ``circles`` (sheet_id, geometry_id, ord, cx, cy, r); adds ``family`` (the leader's ord).
    """
    size = 32.0

    def pairs(c: DataFrame) -> DataFrame:
        reach = F.greatest(F.lit(2.0), 0.03 * F.col("r"))
        # The larger circle's reach decides, so it looks for smaller ones.
        spread = c.select("sheet_id", F.col("ord").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("r").alias("ar"), reach.alias("_reach")).withColumn(
            "_cx", F.explode(neighbours(F.col("ax"), size, F.col("_reach")))).withColumn("_cy", F.explode(neighbours(F.col("ay"), size, F.col("_reach"))))
        placed = c.select("sheet_id", F.col("ord").alias("b"), "cx", "cy", "r", cell(F.col("cx"), size).alias("_cx"), cell(F.col("cy"), size).alias("_cy"))
        near = (F.col("r") <= F.col("ar")) & (g.hypot(F.col("ax") - F.col("cx"), F.col("ay") - F.col("cy")) <= F.col("_reach"))
        return _either_way(spread.join(placed, ["sheet_id", "_cx", "_cy"]).where(near))

    return _led_classes(circles, ["cx", "cy", "r"], pairs, "family")


def equal_diameters(circles: DataFrame, tol: float = 0.03) -> DataFrame:
    """Circles of one drawn size: each joins the first earlier group whose first radius is within 3 %."""

    def pairs(c: DataFrame) -> DataFrame:
        d = c.withColumn("_l", F.ln("r"))
        a = d.select("sheet_id", F.col("ord").alias("a"), F.col("r").alias("r0"), F.col("_l").alias("l0"))
        b = d.select("sheet_id", F.col("ord").alias("b"), F.col("r").alias("r1"), F.col("_l").alias("l1"))
        close = (F.col("r1") <= F.col("r0")) & (F.abs(F.col("r1") - F.col("r0")) <= tol * F.greatest("r1", "r0"))
        return _either_way(near_values(a, b, SHEET, "l0", "l1", F.lit(0.0306), 0.04, close))

    return _led_classes(circles, ["r"], pairs, "size_group")


def circle_stacks(families: DataFrame, minimum: int = 3) -> DataFrame:
    """Families with at least three circles of three different diameters."""
    f = families.groupBy("sheet_id", "family").agg(
        F.count(F.lit(1)).alias("circles"), F.count_distinct(F.round(2 * F.col("r"), 1)).alias("steps"), (2 * F.max("r")).alias("biggest"),
        F.min_by(F.struct("cx", "cy"), "ord").alias("c"))
    return f.where((F.col("circles") >= minimum) & (F.col("steps") >= minimum)).select("sheet_id", "family", "circles", "steps", "biggest", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"))


def bolt_rings(circles: DataFrame, minimum: int = 3, spread: float = 0.05) -> DataFrame:
    """Per stack and size group: the most holes whose distances to the stack's centre fit one window of 5 %.

    Windows are counted by running sums over sorted distinct distances.
    """
    stacks = circle_stacks(circle_families(circles), minimum).select("sheet_id", "family", F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    sizes = equal_diameters(circles)
    big = sizes.groupBy("sheet_id", "size_group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    d = sizes.join(big, ["sheet_id", "size_group"]).join(stacks, "sheet_id").withColumn("d", g.hypot(F.col("cx") - F.col("sx"), F.col("cy") - F.col("sy"))).where("d > 1.0")
    key = ["sheet_id", "family", "size_group"]
    counts = d.groupBy(*key, "d").agg(F.count(F.lit(1)).alias("n"))
    marks = F.array(F.struct(F.col("d").alias("pos"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("w")), F.struct(F.col("d").alias("pos"), F.lit(1).alias("side"), F.col("n").alias("w")),
                    F.struct((F.col("d") * (1.0 + spread)).alias("pos"), F.lit(2).alias("side"), F.lit(0).cast("long").alias("w")))
    run = running_sum(counts.select(*key, "d", F.inline(marks)), key, [F.col("pos"), F.col("side")], F.col("w"), "cum")
    win = run.groupBy(*key, "d").agg((F.max(F.when(F.col("side") == 2, F.col("cum"))) - F.max(F.when(F.col("side") == 0, F.col("cum")))).alias("holes"))
    best = win.groupBy(*key).agg(F.max_by(F.struct("d", "holes"), F.struct("holes", -F.col("d"))).alias("b")).select(*key, F.col("b.d").alias("start"), F.col("b.holes").alias("holes")).where(F.col("holes") >= minimum)
    inside = counts.join(best, key).where((F.col("d") >= F.col("start")) & (F.col("d") <= F.col("start") * (1.0 + spread)))
    return inside.groupBy(*key, "holes").agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("ring_radius_px"), F.min("d").alias("_lo"), F.max("d").alias("_hi")).withColumn(
        "spread", (F.col("_hi") - F.col("_lo")) / F.col("ring_radius_px")).drop("_lo", "_hi")


def part_class(frames: DataFrame, stacks: DataFrame, loops: DataFrame) -> DataFrame:
    """rotational-flanged (a wide concentric stack), flat-part (a closed contour that is neither frame nor table), unknown."""
    s = stacks.groupBy("sheet_id").agg(F.max("biggest").alias("biggest"))
    own = loops.where("class = 'part'").select("sheet_id").distinct().withColumn("_flat", F.lit(True))
    j = frames.select("sheet_id", "width").join(s, "sheet_id", "left").join(own, "sheet_id", "left")
    cls = F.when(F.try_divide("biggest", "width") >= 0.15, "rotational-flanged").when(F.col("_flat"), "flat-part").otherwise("unknown")
    return j.select("sheet_id", cls.alias("part_class"))


def classify_loops(loops: DataFrame, texts: DataFrame, frames: DataFrame) -> DataFrame:
    """Loops as frame (>= 80 % of the page, or >= 60 % holding another), annotation (>= 3 phrases, half words) or part.

    ``loops`` (sheet_id, loop_id, x0, y0, x1, y1), ``texts`` (sheet_id, text, value, x, y, w, h).
    """
    box = ("x0", "y0", "x1", "y1")
    l = loops.join(frames.select("sheet_id", "width", "height"), "sheet_id").withColumn(
        "share", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height")))
    # Only a loop covering most of the page can be a frame that holds another; there are at most a few per sheet.
    wide = l.where("share >= 0.6").select("sheet_id", F.col("loop_id").alias("outer"), *[F.col(b).alias(f"o{b}") for b in box])
    holds = l.join(wide, "sheet_id").where("loop_id <> outer").where(
        (F.col("ox0") - 1 <= F.col("x0")) & (F.col("x1") <= F.col("ox1") + 1) & (F.col("oy0") - 1 <= F.col("y0")) & (F.col("y1") <= F.col("oy1") + 1))
    holds = holds.select("sheet_id", F.col("outer").alias("loop_id")).distinct().withColumn("_holds", F.lit(True))
    px, py = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    word = F.col("value").isNull() & F.col("text").rlike("\\p{L}")
    spots = texts.select("sheet_id", px.alias("px"), py.alias("py"), word.alias("word"), px.alias("px1"), py.alias("py1"))
    inside = box_pairs(l.select("sheet_id", "loop_id", *box), spots, SHEET, 256.0, box, ("px", "py", "px1", "py1")).where("x0 < px and px < x1 and y0 < py and py < y1")
    notes = inside.groupBy("sheet_id", "loop_id").agg(F.count(F.lit(1)).alias("phrases"), F.count_if("word").alias("words"))
    j = l.join(holds, ["sheet_id", "loop_id"], "left").join(notes, ["sheet_id", "loop_id"], "left")
    frame = (F.col("share") >= 0.8) | ((F.col("share") >= 0.6) & F.col("_holds").isNotNull())
    note = (F.col("phrases") >= 3) & (F.col("words") >= 0.5 * F.col("phrases"))
    return j.withColumn("class", F.when(frame, "frame").when(F.coalesce(note, F.lit(False)), "annotation").otherwise("part")).drop("_holds", "width", "height")


def assign_views(geoms: DataFrame, views: DataFrame, share: float = 0.95, size: float = 256.0) -> DataFrame:
    """``view_id``: the one view covering at least 95 % of a geometry's box, NULL when none or several do."""
    box, v = ("x0", "y0", "x1", "y1"), ("vx0", "vy0", "vx1", "vy1")
    w = views.select("sheet_id", "view_id", *[F.col(b).alias(n) for b, n in zip(box, v)])
    a, b = [F.col(n) for n in box], [F.col(n) for n in v]
    own = box_pairs(geoms.select("sheet_id", "geometry_id", *box), w, SHEET, size, box, v).where(g.box_share(a, b) >= share)
    one = own.groupBy("sheet_id", "geometry_id").agg(F.count(F.lit(1)).alias("_n"), F.min("view_id").alias("view_id")).where("_n = 1").drop("_n")
    return geoms.join(one, ["sheet_id", "geometry_id"], "left")


def name_views(views: DataFrame, frames: DataFrame) -> DataFrame:
    """Views named by layout: front is the lowest on the left, plan above it, side to its right, else unknown.

    ``views`` (sheet_id, view_id, ord, hatched BOOLEAN, x, y, w, h).
    """
    v = views.join(frames.select("sheet_id", "width"), "sheet_id")
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    fixed = F.when(F.col("hatched"), "section").when((F.col("x") > 0.55 * F.col("width")) & (F.col("w") < 0.45 * F.col("width")), "isometric")
    v = v.withColumn("fixed", fixed).withColumn("cx", cx).withColumn("cy", cy)
    free = v.where("fixed is null")
    leftish = F.col("cx") < 0.62 * F.col("width")
    front = free.groupBy("sheet_id").agg(F.max_by(F.struct("view_id", "cx", "cy", "w"), F.struct(leftish, "cy", -F.col("ord"))).alias("f"))
    kind = (
        F.when(F.col("fixed").isNotNull(), F.col("fixed")).when(F.col("view_id") == F.col("f.view_id"), "front")
        .when(F.col("cx") > F.col("f.cx") + 0.25 * F.col("f.w"), "side").when(F.col("cy") < F.col("f.cy") - 20, "plan").otherwise("unknown"))
    return v.join(front, "sheet_id", "left").withColumn("kind", kind).select(*views.columns, "kind")


def evidence_table(primitives: DataFrame, texts: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence in page-normalised boxes, dropped counts by reason): rows without region, text or value fall out."""
    p = primitives.select("sheet_id", "id", F.col("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("value"),
                          F.coalesce(F.least("x0", "x1"), F.col("cx") - F.col("r")).alias("bx0"), F.coalesce(F.least("y0", "y1"), F.col("cy") - F.col("r")).alias("by0"),
                          F.coalesce(F.greatest("x0", "x1"), F.col("cx") + F.col("r")).alias("bx1"), F.coalesce(F.greatest("y0", "y1"), F.col("cy") + F.col("r")).alias("by1"), F.lit(False).alias("is_text"))
    t = texts.select("sheet_id", "id", "kind", "text", "value", F.col("x").alias("bx0"), F.col("y").alias("by0"), (F.col("x") + F.col("w")).alias("bx1"), (F.col("y") + F.col("h")).alias("by1"), F.lit(True).alias("is_text"))
    j = p.unionByName(t).join(frames.select("sheet_id", "width", "height"), "sheet_id", "left")
    clip = lambda v, side: F.when(v.isNotNull(), F.bround(F.least(F.greatest(F.try_divide(v, side), F.lit(0.0)), F.lit(1.0)), 4))
    j = j.withColumns({"x0": clip(F.col("bx0"), F.col("width")), "y0": clip(F.col("by0"), F.col("height")), "x1": clip(F.col("bx1"), F.col("width")), "y1": clip(F.col("by1"), F.col("height"))})
    why = F.when(F.col("x0").isNull() | F.col("x1").isNull(), "no_region").when(F.col("is_text") & (F.trim(F.coalesce("text", F.lit(""))) == "") & F.col("value").isNull(), "no_text_or_value")
    j = j.withColumn("dropped", why)
    return j.where("dropped is null").select("sheet_id", "id", "kind", "text", "value", "x0", "y0", "x1", "y1"), j.where("dropped is not null").groupBy("sheet_id", "dropped").agg(F.count(F.lit(1)).alias("rows"))


def classify_claims(claims: DataFrame, loop_members: DataFrame, circles: DataFrame) -> DataFrame:
    """diameters, outline (both ends on one contour's geometry), spacing (both on circles) or section."""
    k = lambda df, n: df.select("sheet_id", F.col("geometry_id")).distinct().withColumn(n, F.lit(True))
    out = claims
    for side in ("first_id", "second_id"):
        out = out.join(k(loop_members, f"_l_{side}").withColumnRenamed("geometry_id", side), ["sheet_id", side], "left").join(k(circles, f"_c_{side}").withColumnRenamed("geometry_id", side), ["sheet_id", side], "left")
    loop = F.col("_l_first_id").isNotNull() & F.col("_l_second_id").isNotNull()
    circ = F.col("_c_first_id").isNotNull() & F.col("_c_second_id").isNotNull()
    cls = F.when(F.col("form") == "diameter", "diameters").when((F.col("form") == "distance") & F.col("second_id").isNotNull(), F.when(loop, "outline").when(circ, "spacing").otherwise("section"))
    return out.withColumn("class", cls).select(*claims.columns, "class")


def unbound(features: DataFrame, bindings: DataFrame) -> DataFrame:
    """Features no binding end names."""
    ends = bindings.select("sheet_id", F.col("first_id").alias("geometry_id")).unionByName(bindings.select("sheet_id", F.col("second_id").alias("geometry_id")))
    return features.join(ends.where("geometry_id is not null").distinct(), ["sheet_id", "geometry_id"], "left_anti")


def measurement_checks(df: DataFrame) -> DataFrame:
    """``ok``: measured within max(1 %, 0.5 mm) of printed; a refusal text otherwise."""
    tol = F.greatest(0.01 * F.col("printed_mm"), F.lit(0.5))
    dev = F.abs(F.col("measured_mm") - F.col("printed_mm"))
    say = F.format_string("%s: measured %.2f mm, printed %.2f mm (off %.2f), tolerance %.2f mm", "name", "measured_mm", "printed_mm", dev, tol)
    return df.withColumn("ok", dev <= tol).withColumn("refusal", F.when(dev > tol, say))


def geometry_diff(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: added, removed, changed or same per id; sheets: counts and how many kept ids moved), at 3 decimals."""
    vals = ("kind", "x", "y", "size")
    side = lambda df, p: df.select("sheet_id", "geometry_id", F.lit(True).alias(f"{p}_in"), *[(F.round(v, 3) if v != "kind" else F.col(v)).alias(f"{p}_{v}") for v in vals])
    j = side(old, "o").join(side(new, "n"), ["sheet_id", "geometry_id"], "full")
    same = F.lit(True)
    for v in vals:
        same = same & F.col(f"o_{v}").eqNullSafe(F.col(f"n_{v}"))
    moved = F.col("o_in").isNotNull() & F.col("n_in").isNotNull() & ~(F.col("o_x").eqNullSafe(F.col("n_x")) & F.col("o_y").eqNullSafe(F.col("n_y")))
    state = F.when(F.col("o_in").isNull(), "added").when(F.col("n_in").isNull(), "removed").when(same, "same").otherwise("changed")
    rows = j.select("sheet_id", "geometry_id", state.alias("state"), moved.alias("moved"))
    return rows, rows.groupBy("sheet_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("added", "removed", "changed", "same")], F.count_if("moved").alias("moved"))
