"""Text-table operators: candidates from observed texts, area filters, leak scans, claim flags, catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions.identity import identity
from draftlake.functions.regions import bbox_issue
from draftlake.operators.scan import positions

# Reading method -> kind of source.
SOURCE_KINDS = {"pdf-text": "vector_text", "tesseract-tsv": "raster_region"}
REGION_KEYS = ["sheet_id", "source_digest", "x0", "y0", "x1", "y1", "source_kind"]
MARGIN = 0.04
WIDE = 2e-8  # Two steps of a rounded coordinate.


def _placed(texts: DataFrame, frames: DataFrame) -> DataFrame:
    """Observed texts with their normalised region, the kind of their source, and what is wrong with the region, if anything."""
    t = texts.join(frames, "sheet_id")
    kinds = F.create_map(*[F.lit(v) for pair in SOURCE_KINDS.items() for v in pair])
    t = t.withColumn("_kind", kinds[F.col("method")]).withColumn("source_kind", F.coalesce("_kind", F.lit("observation")))
    t = t.withColumn("issue", bbox_issue(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")]))
    scaled = [F.col("x") / F.col("width"), F.col("y") / F.col("height"),
              (F.col("x") + F.col("w")) / F.col("width"), (F.col("y") + F.col("h")) / F.col("height")]
    t = t.withColumns({n: F.when(F.col("issue").isNull(), F.bround(c, 8)) for n, c in zip(("x0", "y0", "x1", "y1"), scaled)})
    whole = (F.col("x0") >= 0) & (F.col("x0") < F.col("x1")) & (F.col("x1") <= 1) & (F.col("y0") >= 0) & (F.col("y0") < F.col("y1")) & (F.col("y1") <= 1)
    # Rounding moves an end by half a step of 1e-8 at most, so a wider box stays whole: filters on the issue, into which
    # Spark copies all these columns, then round nothing for it.
    sx0, sy0, sx1, sy1 = scaled
    sure = (sx0 >= 0) & (sx1 - sx0 > WIDE) & (sx1 <= 1) & (sy0 >= 0) & (sy1 - sy0 > WIDE) & (sy1 <= 1)
    return t.withColumn("issue", F.coalesce("issue", F.when(F.when(sure, False).otherwise(~whole), "region_collapsed")))


def _candidate_id(df: DataFrame, detector_version: str) -> DataFrame:
    return df.withColumn("detector_version", F.lit(detector_version)).withColumn(
        "candidate_id", identity("source_digest", "x0", "y0", "x1", "y1", "source_kind", "detector_version"))


def callout_candidates(texts: DataFrame, frames: DataFrame, detector_version: str) -> tuple[DataFrame, DataFrame]:
    """Observed texts grouped by identical normalised region: (candidates, diagnostics).

    ``texts`` (sheet_id, id, text, method, x, y, w, h); ``frames`` (sheet_id, source_digest, width, height). A candidate
    holds the count of its distinct ids and the smallest one; ``candidate_observations`` has them all, as rows.
    """
    t = _placed(texts, frames)
    groups = t.where(F.col("issue").isNull()).groupBy(*REGION_KEYS).agg(
        F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"), F.min("text").alias("_lo"), F.max("text").alias("_hi"))
    candidates = _candidate_id(groups.withColumn("machine_text_hint", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))), detector_version)
    diag = lambda df, code, who: df.select("sheet_id", code.alias("code"), who.alias("observation_id"))
    diagnostics = (
        diag(t.where(F.col("_kind").isNull()), F.lit("unknown_text_method"), F.col("id"))
        .unionByName(diag(t.where(F.col("issue").isNotNull()), F.col("issue"), F.col("id")))
        .unionByName(diag(groups.where(F.col("_lo") != F.col("_hi")), F.lit("duplicate_hint_conflict"), F.col("first_id")))
        .unionByName(diag(frames.join(texts.select("sheet_id").distinct(), "sheet_id", "left_anti"),
                          F.lit("no_text_observations"), F.lit(None).cast(texts.schema["id"].dataType)))
        .distinct()
    )
    return candidates.drop("_lo", "_hi"), diagnostics


def candidate_observations(texts: DataFrame, frames: DataFrame, detector_version: str) -> DataFrame:
    """Provenance of the candidates: (candidate_id, region, id), one row for every distinct observation, however many a region has."""
    sound = _placed(texts, frames).where(F.col("issue").isNull()).select(*REGION_KEYS, "id").distinct()
    return _candidate_id(sound, detector_version)


def canonical_order(df: DataFrame, keys: Sequence[str] = ("sheet_id",)) -> DataFrame:
    """Reading order y0, x0, y1, x1, source kind, id: adds ``position`` over the whole table, sheet by sheet, and ``place`` in the sheet.

    Both count from 0 without gaps. Nulls come first; rows equal in all of these stand side by side.
    """
    order = [F.col(c) for c in (*keys, "y0", "x0", "y1", "x1", "source_kind", "candidate_id")]
    placed = positions(df, order, "position")
    first = placed.groupBy(*keys).agg(F.min("position").alias("_first"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return placed.alias("a").join(first.alias("b"), same).select("a.*", (F.col("position") - F.col("_first")).alias("place"))


def inside_area(texts: DataFrame, frames: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Texts whose centre is not in the outer band of their page."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    bx, by = F.col("width") * margin, F.col("height") * margin
    return texts.join(frames.select("sheet_id", "width", "height"), "sheet_id").where(
        cx.between(bx, F.col("width") - bx) & cy.between(by, F.col("height") - by))


def forbidden_terms(df: DataFrame, text_col: str, terms: Sequence[str]) -> DataFrame:
    """Adds ``leaks``: the given terms that occur in the text, compared in lower case, sorted."""
    hay = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    names = F.array(*[F.lit(t) for t in sorted({t for t in terms if t})])
    return df.withColumn("leaks", F.filter(names, lambda t: F.contains(hay, F.lower(t))))


def placeholder(text: Column) -> Column:
    """Is the text empty or does it start with a placeholder word? Fixed words of the review rules."""
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    starts = [t.startswith(w) for w in ("EKSİK", "TODO", "TBD", "PLACEHOLDER")]
    return (t == "") | starts[0] | starts[1] | starts[2] | starts[3]


def _filled(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) != ""


def claim_flags(df: DataFrame) -> DataFrame:
    """Seven semantic-claim flags and six evidence flags of nested candidates, with their disjunctions."""
    eq = lambda path, *values: F.coalesce(F.col(path).isin(*values), F.lit(False))
    known = lambda path: F.coalesce(F.col(path) != "unknown", F.lit(False))
    claims = {
        "callout_text": _filled(F.col("callout.text")), "form_symbol": eq("form.symbol", "R", "diameter"),
        "size": eq("size.state", "known"), "count_printed": F.col("count.printed").isNotNull(),
        "termination": eq("termination.kind", "thru", "finite"), "depth": eq("depth.state", "known"),
        "physical": known("physical.kind"),
    }
    evidence = {
        "representation": known("representation.kind"), "found_circles": F.col("count.found_circles").isNotNull(),
        "target_state": eq("target.state", "bound"), "target_observation_id": F.col("target.observation_id").isNotNull(),
        "source_region": F.col("source.region").isNotNull(),
        "uncertainty": (F.coalesce(F.size("uncertainty.fields"), F.lit(0)) > 0) | _filled(F.col("uncertainty.reason")),
    }
    pack = lambda flags: F.struct(*[c.alias(n) for n, c in flags.items()])
    out = df.withColumn("claim_flags", pack(claims)).withColumn("evidence_flags", pack(evidence))
    any_of = lambda name, flags: F.greatest(*[F.col(f"{name}.{n}") for n in flags])
    return out.withColumn("has_claim", any_of("claim_flags", claims)).withColumn("has_evidence", any_of("evidence_flags", evidence))


def build_catalog(printed: DataFrame, names: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog rows and errors. ``printed`` (sheet_id, span_id, value, unit, text, kind, count); ``names``
    (sheet_id, span_id, name); ``claims`` (sheet_id, span_id, form, resolution). An explicit multiplicity becomes
    its own count row."""
    key = ["sheet_id", "span_id"]
    dup = lambda df, cols, code: (
        df.groupBy("sheet_id", *cols).agg(F.count(F.lit(1)).alias("n"), F.min("span_id").alias("_s")).where("n > 1")
        .select("sheet_id", F.col("_s").alias("span_id"), F.lit(code).alias("code")))
    numeric = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    joined = printed.join(names, key, "left").join(claims.select(*key, "form", "resolution"), key, "left")
    row_code = (
        F.when(F.coalesce(F.col("span_id"), F.lit("")) == "", "empty_source").when(F.col("name").isNull(), "no_name")
        .when(~numeric, "not_numeric").when(~F.coalesce(F.col("unit").isin("mm", "in", "deg", "count"), F.lit(False)), "unknown_unit")
        .when(F.col("count") < 1, "invalid_count"))
    errors = (
        joined.withColumn("code", row_code).where("code is not null").select(*key, "code")
        .unionByName(dup(printed, ["span_id"], "duplicate_source")).unionByName(dup(names, ["name"], "duplicate_name")))
    bad_sheets = errors.select("sheet_id").distinct()
    good = joined.join(bad_sheets, "sheet_id", "left_anti")
    explicit = (F.col("count") > 1) | ((F.col("count") == 1) & F.col("text").rlike(r"(?i)\b1\s*[x×]"))
    entry = lambda name, value, unit, quantity, kind: F.struct(
        name.alias("name"), value.alias("value"), unit.alias("unit"), F.lit(quantity).alias("quantity"), kind.alias("kind"))
    own = entry(F.col("name"), F.col("value"), F.col("unit"), "size", F.col("kind"))
    extra = entry(F.concat("name", F.lit("_count")), F.col("count").cast("double"), F.lit("count"), "count", F.lit("count"))
    rows = good.select(*key, "form", "resolution", F.inline(F.array_compact(F.array(own, F.when(explicit, extra)))))
    # A generated name that meets a given one counts on from _2 to the first free name. Given names are unique and generated
    # ones end in their own base and number, so only given names can be in the way.
    taken = names.select("sheet_id", "name").distinct()
    base = taken.select("sheet_id", F.regexp_extract("name", r"^(.*_count)_([1-9]\d{0,17})$", 1).alias("name"), F.regexp_extract("name", r"^(.*_count)_([1-9]\d{0,17})$", 2).alias("_k"))
    nth = F.row_number().over(Window.partitionBy("sheet_id", "name").orderBy("_k"))
    run = base.where("name <> ''").withColumn("_k", F.col("_k").cast("long")).where("_k >= 2").withColumn("_nth", nth)
    free = run.groupBy("sheet_id", "name").agg(F.count_if(F.col("_k") == F.col("_nth") + 1).alias("_run"))
    rows = rows.join(taken.withColumn("_taken", F.lit(True)), ["sheet_id", "name"], "left").join(free, ["sheet_id", "name"], "left")
    clash = (F.col("quantity") == "count") & F.col("_taken").isNotNull()
    counted = F.concat_ws("_", "name", (F.coalesce("_run", F.lit(0)) + 2).cast("string"))
    return rows.withColumn("name", F.when(clash, counted).otherwise(F.col("name"))).drop("_taken", "_run"), errors
