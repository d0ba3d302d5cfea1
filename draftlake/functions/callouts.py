"""Callout extraction: what a transcription says, as typed columns and ordered codes. Nothing is guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions.staging import stage
from draftlake.functions.text import normalize_text

# Error codes, then informing codes, in reporting order.
ERROR_CODES = [
    "empty_text", "unsupported_syntax", "ambiguous_number", "missing_value_after_symbol", "missing_depth_value",
    "conflicting_symbols", "conflicting_units", "count_without_feature", "unknown_tokens", "thru_with_depth",
    "invalid_value",
]
NOTE_CODES = ["unit_unresolved", "unit_differs_from_sheet"]

# Token classes, first match wins.
TOKENS = {
    "diameter": "[Øø⌀∅]|DIAM|DIA",
    "radius": "R(?![A-Za-z])",
    "number": r"\d+(?:[.,]\d+)?|\.\d+",
    "times": "[xX×]",
    "thru": "THROUGH|THRU",
    "all": "ALL(?![A-Za-z])",
    "depthword": "DEPTH|DEEP",
    "mm": "MM",
    "inch": 'INCHES|INCH|IN|"',
    "word": "[A-Za-z]+",
    "other": r"\S",
}
_SCAN = "(?i)" + "|".join(f"(?:{p})" for p in TOKENS.values())
_THREAD = r"(?<![A-Za-z0-9])M\s*\d"
_LIMIT = 1e6


def _kind(raw: Column) -> Column:
    chain = F.lit("other")
    for name, pattern in reversed(TOKENS.items()):
        chain = F.when(raw.rlike(f"(?i)^(?:{pattern})$"), name).otherwise(chain)
    return chain


def _value(raw: Column) -> Column:
    """The number, or NULL where `1,234` may be thousands or decimals."""
    return F.when(~raw.rlike(r"^\d+,\d{3}$"), F.translate(raw, ",", ".").try_cast("double"))


def _kept(s: Column, *names: str) -> dict[str, Column]:
    return {n: s[n] for n in names}


def _token(t: Column) -> Column:
    return F.struct(_kind(t).alias("k"), t.alias("raw"))


def _scan(s: Column) -> dict[str, Column]:
    tokens = F.transform(F.regexp_extract_all(s["text"], F.lit(_SCAN), 0), _token)
    return {"text": s["text"], "sheet": s["sheet"], "tok": tokens}


def _place(s: Column) -> dict[str, Column]:
    tok = s["tok"]
    placed = F.transform(tok, lambda t, i: F.struct(
        i.alias("i"), t["k"].alias("k"), F.when(t["k"] == "number", _value(t["raw"])).alias("v"),
        F.when(i > 0, F.get(tok, i - 1)["k"]).alias("before"),
        F.coalesce(F.get(tok, i + 1)["k"] == "times", F.lit(False)).alias("counts")))
    return {"text": s["text"], "sheet": s["sheet"], "tok": placed}


def _collect(s: Column) -> dict[str, Column]:
    tok = s["tok"]
    of = lambda *kinds: F.filter(tok, lambda t: t["k"].isin(*kinds))
    counts = F.filter(tok, lambda t: (t["k"] == "number") & t["counts"])
    whole = lambda t: (t["v"] >= 1) & (t["v"] == F.floor(t["v"]))
    stray = F.exists(tok, lambda t: (t["k"] == "times") & ~t["before"].eqNullSafe("number"))
    return {
        "sheet": s["sheet"], "empty": s["text"] == "", "symbols": of("diameter", "radius"), "units": of("mm", "inch"),
        "thru": F.exists(tok, lambda t: t["k"] == "thru"), "deep": F.transform(of("depthword"), lambda t: t["i"]),
        "free": F.filter(tok, lambda t: (t["k"] == "number") & t["v"].isNotNull() & ~t["counts"]),
        "good": F.filter(counts, whole), "badcount": F.exists(counts, lambda t: ~whole(t)),
        "vague": F.exists(tok, lambda t: (t["k"] == "number") & t["v"].isNull()), "syntax": s["text"].rlike(_THREAD) | stray,
        "unknown": F.exists(tok, lambda t: t["k"].isin("word", "other") | ((t["k"] == "all") & ~t["before"].eqNullSafe("thru"))),
    }


_CARRIED = ("sheet", "empty", "symbols", "units", "thru", "deep", "good", "badcount", "vague", "syntax", "unknown")


def _pick_size(s: Column) -> dict[str, Column]:
    anchor = F.get(s["symbols"], F.lit(0))["i"]
    nearest = F.array_min(F.transform(s["free"], lambda t: F.struct(
        F.abs(t["i"] - anchor).alias("gap"), (t["i"] < anchor).alias("is_before"), t["i"].alias("i"), t["v"].alias("v"))))
    return {**_kept(s, *_CARRIED, "free"), "pick": F.when(F.size(s["symbols"]) > 0, nearest)}


def _drop_size(s: Column) -> dict[str, Column]:
    rest = F.filter(s["free"], lambda t: F.coalesce(t["i"] != s["pick"]["i"], F.lit(True)))
    return {**_kept(s, *_CARRIED, "pick"), "free": rest}


def _pick_depth(s: Column) -> dict[str, Column]:
    after = F.filter(s["free"], lambda t: F.array_contains(s["deep"], t["i"] - 1))
    before = F.filter(s["free"], lambda t: F.array_contains(s["deep"], t["i"] + 1))
    return {**_kept(s, *_CARRIED, "pick", "free"), "near": F.when(F.size(after) > 0, after).otherwise(before)}


def _measure(s: Column) -> dict[str, Column]:
    word, n = F.size(s["deep"]) > 0, F.size(s["near"])
    own = F.get(s["near"], F.lit(0))
    left = F.when(word & (n == 1), F.filter(s["free"], lambda t: t["i"] != own["i"])).otherwise(s["free"])
    return {**_kept(s, *_CARRIED, "pick"), "left": left, "depth": F.when(word & (n == 1), own["v"]),
            "vague": s["vague"] | (word & (n > 1)), "nodepth": word & (n == 0)}


def _decide(s: Column) -> dict[str, Column]:
    n_sym = F.size(s["symbols"])
    lone = (F.size(s["left"]) == 1) & (n_sym == 0)
    return {
        **_kept(s, "sheet", "empty", "thru", "syntax", "unknown", "nodepth", "badcount", "depth"),
        "size": F.when(n_sym > 0, s["pick"]["v"]).when(lone, F.get(s["left"], F.lit(0))["v"]),
        "form": F.when(n_sym == 1, F.get(s["symbols"], F.lit(0))["k"]).when(lone, "linear"),
        "vague": s["vague"] | (F.size(s["good"]) > 1) | ((F.size(s["left"]) > 0) & ~lone),
        "count": F.get(s["good"], F.lit(0))["v"].cast("long"),
        "unit": F.when(F.get(s["units"], F.lit(0))["k"] == "mm", "mm").when(F.size(s["units"]) > 0, "in"),
        "symconf": n_sym > 1, "unitconf": F.size(s["units"]) > 1,
    }


def _range(s: Column) -> dict[str, Column]:
    bad = lambda c: c.isNotNull() & ~((c > 0) & (c <= _LIMIT))
    wrong = bad(s["size"]) | bad(s["depth"]) | s["badcount"]
    return {
        **_kept(s, "sheet", "empty", "thru", "syntax", "unknown", "nodepth", "form", "vague", "count", "unit", "symconf", "unitconf"),
        "bad": wrong, "size": F.when(~bad(s["size"]), s["size"]), "depth": F.when(~bad(s["depth"]), s["depth"]),
        "loud": s["vague"] | s["syntax"] | s["unknown"] | s["nodepth"] | s["symconf"] | s["unitconf"] | wrong,
    }


def _report(s: Column) -> dict[str, Column]:
    silent = s["size"].isNull() & ~s["loud"]
    read = s["form"].isNotNull() & s["size"].isNotNull()
    flags = {
        "empty_text": s["empty"],
        "unsupported_syntax": ~s["empty"] & (s["syntax"] | (silent & s["form"].isNull())),
        "ambiguous_number": s["vague"],
        "missing_value_after_symbol": silent & s["form"].isNotNull(),
        "missing_depth_value": s["nodepth"],
        "conflicting_symbols": s["symconf"],
        "conflicting_units": s["unitconf"],
        "count_without_feature": s["count"].isNotNull() & ~F.coalesce(s["form"].isin("diameter", "radius"), F.lit(False)),
        "unknown_tokens": s["unknown"],
        "thru_with_depth": s["thru"] & s["depth"].isNotNull(),
        "invalid_value": s["bad"],
        "unit_unresolved": read & s["unit"].isNull(),
        "unit_differs_from_sheet": read & (s["unit"] != s["sheet"]),
    }
    warnings = F.array_compact(F.array(*[F.when(flags[c], c) for c in ERROR_CODES + NOTE_CODES]))
    return {**_kept(s, "form", "size", "count", "depth", "unit", "thru"), "warnings": warnings}


def _state(s: Column) -> dict[str, Column]:
    hard = F.array(*[F.lit(c) for c in ERROR_CODES if c != "ambiguous_number"])
    status = (
        F.when(F.arrays_overlap(s["warnings"], hard), "unsupported")
        .when(F.array_contains(s["warnings"], "ambiguous_number"), "ambiguous").otherwise("parsed"))
    termination = F.when(s["thru"] & s["depth"].isNull(), "thru").when(s["depth"].isNotNull() & ~s["thru"], "blind")
    return {"status": status, **_kept(s, "form", "size", "count"), "termination": termination, **_kept(s, "depth", "unit", "warnings")}


def extract_callouts(df: DataFrame, text_col: str, sheet_unit_col: str | None = None) -> DataFrame:
    """Adds ``callout``: STRUCT<status, form, size, count, termination, depth, unit, warnings>."""
    sheet = F.lit(None).cast("string") if sheet_unit_col is None else F.col(sheet_unit_col)
    state = F.struct(F.coalesce(normalize_text(F.col(text_col)), F.lit("")).alias("text"), sheet.alias("sheet"))
    for step in (_scan, _place, _collect, _pick_size, _drop_size, _pick_depth, _measure, _decide, _range, _report, _state):
        state = stage(state, step)
    return df.withColumn("callout", state)
