"""Printed-text columns: counts, dimensions, classes, keys. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.constants import MM_PER_INCH

# Words that trail a dimension and say how a feature is made, not how big it is.
MANNER_WORDS = [
    "thru", "through", "all", "deep", "typ", "typical", "c'bore", "cbore", "c'sink", "csink", "spotface",
    "counterbore", "countersink", "eq", "eqsp", "pcd", "ref",
]
# Marks that name a diameter, and hole notes that imply one.
DIAMETER_MARKS = "ØÖ⌀Φ"
HOLE_NOTES = ["THRU", "TAP", "CBORE", "C'BORE", "CSK", "6H", "PILOT"]
# Closed role lists per family.
DIAMETER_ROLES = ["outer_diameter", "inner_diameter", "hole_diameter"]
RADIUS_ROLES = ["bend_radius", "corner_radius", "fillet"]
LENGTH_ROLES = ["edge", "thickness", "hole_spacing"]

# Patterns of printed counts, units and fractions (B1, B2).
_COUNT = r"^\s*(\d{1,2})\s*(?:[xX×]\s*(\d{1,2}))?\s*(?:[-–]\s*|[xX×]\s*)(?=[ØÖ⌀ΦRrCc\d])"
_INCH = r"(?i)(?<![A-Za-z])(?:inch(?:es)?|in)(?![A-Za-z])|\""
_UNIT_WORD = r"(?i)(?<![A-Za-z])(?:inch(?:es)?|in|mm)(?![A-Za-z])"
_MIXED = r"^(\d+)\s+(\d+)\s*/\s*(\d+)$"
_FRACTION = r"^(\d+)\s*/\s*(\d+)$"
_TRAILING = r"(?i)(?:\s+[.,;:]*(?:" + "|".join(MANNER_WORDS) + r")[.,;:]*)+$"


def normalize_text(text: Column) -> Column:
    """Whitespace runs become one space; everything else is kept."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^0-9a-z]", "")


def count_prefix(text: Column) -> Column:
    first = F.try_to_number(F.nullif(F.regexp_extract(text, _COUNT, 1), F.lit("")), F.lit("99"))
    second = F.try_to_number(F.nullif(F.regexp_extract(text, _COUNT, 2), F.lit("")), F.lit("99"))
    product = first.cast("int") * F.coalesce(second.cast("int"), F.lit(1))
    return F.greatest(F.coalesce(product, F.lit(1)), F.lit(1))


def count_body(text: Column) -> Column:
    """The dimension text without its count prefix."""
    prefix = F.regexp_extract(text, _COUNT, 0)
    return F.regexp_replace(F.substring(text, F.length(prefix) + 1, F.length(text)), r"^\s+|\s+$", "")


def _double(text: Column) -> Column:
    return text.try_cast("double")


def extract_dimensions(df: DataFrame, text_col: str) -> DataFrame:
    """Adds dim_count, dim_kind, dim_value, dim_unit. Text with letters left over is kind ``text``, value NULL."""
    body = F.regexp_replace(normalize_text(count_body(F.col(text_col))), _TRAILING, "")
    stage = df.withColumn("dim_count", count_prefix(F.col(text_col))).withColumn("_head", body)
    head = F.col("_head")
    unit = F.when(head.rlike(_INCH) | head.rlike(_MIXED) | head.rlike(_FRACTION), "in").otherwise("mm")
    marked = head.rlike(f"[{DIAMETER_MARKS}]") | head.rlike(r"^[oO]\d")
    kind = (
        F.when(head.contains("°"), "angle")
        .when(head.rlike(r"^[Rr]") & ~head.rlike(r"(?i)^ra"), "radius").when(marked, "diameter").otherwise("linear")
    )
    raw = F.regexp_replace(F.translate(head, ",", "."), f'[{DIAMETER_MARKS}°"]', "")
    raw = F.regexp_replace(raw, _UNIT_WORD, "")
    for letter in ("[Rr]", "[Cc]", "[Mm]"):
        raw = F.regexp_replace(raw, f"^{letter}(?=\\d)", "")
    stage = stage.withColumn("_raw", normalize_text(raw)).withColumn("dim_unit", unit).withColumn("_kind", kind)
    raw, tight = F.col("_raw"), F.regexp_replace("_raw", " ", "")

    def part(source: Column, pattern: str, group: int) -> Column:
        return _double(F.regexp_extract(source, pattern, group))

    mixed = part(raw, _MIXED, 1) + F.try_divide(part(raw, _MIXED, 2), part(raw, _MIXED, 3))
    fraction = F.try_divide(part(tight, _FRACTION, 1), part(tight, _FRACTION, 2))
    plain = F.regexp_extract(tight, r"(\.\d*|\d+(?:\.\d*)?)", 1)
    number = (
        F.when(raw.rlike(_MIXED), mixed).when(tight.rlike(_FRACTION), fraction)
        .otherwise(F.when(~plain.isin("", "."), _double(plain)))
    )
    value = F.when(raw.rlike(r"[A-Za-z]") | (raw == ""), F.lit(None).cast("double")).otherwise(number)
    return (
        stage.withColumn("dim_value", value)
        .withColumn("dim_kind", F.when(F.col("dim_value").isNull(), "text").otherwise(F.col("_kind")))
        .drop("_head", "_raw", "_kind")
    )


def apply_sheet_unit(spans: DataFrame, keys: tuple[str, ...] = ("sheet_id",)) -> DataFrame:
    """One unit per sheet: any valued inch reading makes the sheet's unmarked valued readings inches."""
    inch = (
        spans.where(F.col("value").isNotNull() & (F.col("unit") == "in")).select(*keys).distinct()
        .withColumn("_inch", F.lit(True))
    )
    turned = (F.col("unit") == "mm") & F.col("value").isNotNull() & F.col("_inch").isNotNull()
    return spans.join(inch, list(keys), "left").withColumn("unit", F.when(turned, "in").otherwise(F.col("unit"))).drop("_inch")


def to_mm(value: Column, unit: Column, declared: Column | None = None) -> tuple[Column, Column]:
    """(millimetres, provenance): the printed unit wins, then the declared one, else nothing resolves."""
    declared = F.lit(None).cast("string") if declared is None else declared
    source = F.when(unit.isin("mm", "in"), "printed").when(declared.isin("mm", "in"), "sheet")
    used = F.when(unit.isin("mm", "in"), unit).otherwise(declared)
    mm = F.when(source.isNull(), F.lit(None).cast("double")).otherwise(F.when(used == "in", value * MM_PER_INCH).otherwise(value))
    return mm, F.when(value.isNotNull(), F.coalesce(source, F.lit("missing_unit")))


def role_choices(text: Column, kind: Column) -> Column:
    """Closed list of roles a printed text may take, from its prefix and hole notes."""
    body = count_body(text)
    roles = lambda names: F.array(*[F.lit(n) for n in names])
    notes = body.rlike("(?i)" + "|".join(HOLE_NOTES))
    return (
        F.when(body.contains("°") | kind.eqNullSafe("angle"), roles(["angle"]))
        .when(body.rlike(r"^[Cc]\d"), roles(["chamfer"]))
        .when(body.rlike("[Ø⌀Φ]") | kind.eqNullSafe("diameter"), roles(DIAMETER_ROLES))
        .when((body.rlike(r"^[Rr]") & ~body.rlike(r"(?i)^ra")) | kind.eqNullSafe("radius"), roles(RADIUS_ROLES))
        .when(notes, roles(DIAMETER_ROLES)).otherwise(roles(LENGTH_ROLES))
    )


def text_class(text: Column) -> Column:
    """Class of a printed text: diameter, diameter_callout, callout, radius or linear."""
    # The marks of each class.
    note = text.rlike("THRU|DEPTH")
    return (
        F.when(text.contains("Ø"), F.when(note, "diameter_callout").otherwise("diameter"))
        .when(note, "callout").when(text.rlike(r"\d+\s*[xX]\s*Ø"), "count")
        .when(text.startswith("R"), "radius").otherwise("linear")
    )


def number_in(text: Column) -> Column:
    found = F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1)
    return _double(F.translate(F.nullif(found, F.lit("")), ",", "."))
