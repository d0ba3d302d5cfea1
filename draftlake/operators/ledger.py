"""Run ledgers: attempts, calls, stages, budgets, rates on frozen denominators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.operators.evaluation import ratio
from draftlake.operators.scan import lag_value, rank_value, running_max_before

IDENTITY = ["experiment", "schema_version", "reader_version", "contract_version", "producer_identity"]
# Words of refusals and error tails, and the layer each of them names.
REFUSAL_LAYERS = [("kalibrasyon|ölçek", "calibration"), ("eşleş|okunamadı", "input")]
TAIL_LAYERS = [("not printed on the drawing|CadFailure", "cad"), ("okunamadı|(?i)pafta", "input"), ("süre|bellek", "resources")]


def eligibility(attempts: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Adds ``reasons``: identity fields of the manifest that differ from the contract."""
    differs = [F.when(~F.col(f"manifest.{f}").eqNullSafe(F.lit(expected[f])), f) for f in IDENTITY]
    return attempts.withColumn("reasons", F.array_compact(F.array(*differs)))


def select_attempts(attempts: DataFrame, expected: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(chosen per cell, ignored): the newest eligible pass with output, else the newest eligible attempt."""
    marked = eligibility(attempts, expected)
    done = marked.where("has_result")
    ok = done.where(F.size("reasons") == 0)
    is_pass = (F.col("state") == "pass") & F.col("parsed")
    chosen = ok.groupBy("cell").agg(F.max_by(F.struct("attempt_id", "state", "seq"), F.struct(is_pass, "seq")).alias("c")).select("cell", "c.*")
    why = F.when(~F.col("has_result"), "orphan").when(F.size("reasons") > 0, "not_eligible")
    return chosen, marked.withColumn("ignored", why).where("ignored is not null").select("cell", "attempt_id", "ignored", "reasons")


def failure_class(runs: DataFrame) -> DataFrame:
    """Layer at which a run failed: verdict checks, else the last refusal, else the last error tail.

    ``runs`` (run_id, verdict, failed_checks ARRAY<STRING>, steps ARRAY<STRUCT<refusals ARRAY<STRING>, exit_code,
    stderr_tail>>).
    """
    has = lambda *names: F.arrays_overlap("failed_checks", F.array(*[F.lit(n) for n in names]))
    judged = F.when(F.col("verdict") == "pass", "pass").when(has("readable", "solids", "valid"), "evaluator").when(has("units", "alignment"), "calibration").otherwise("binding")
    bad_exit = lambda s: F.coalesce(s["exit_code"] != 0, F.lit(False)) & (F.trim(F.coalesce(s["stderr_tail"], F.lit(""))) != "")
    telling = F.filter("steps", lambda s: (F.size(s["refusals"]) > 0) | bad_exit(s))
    last = F.try_element_at(telling, F.lit(-1))
    joined = F.array_join(last["refusals"], " | ")
    tail = F.element_at(F.split(F.trim(last["stderr_tail"]), "\n"), -1)

    def layer(text, rules, default):
        out = F.lit(default)
        for pattern, name in reversed(rules):
            out = F.when(text.rlike(pattern), name).otherwise(out)
        return out

    stepped = F.when(last.isNull(), "input").when(F.size(last["refusals"]) > 0, layer(joined, REFUSAL_LAYERS, "calibration")).otherwise(layer(tail, TAIL_LAYERS, "cad"))
    return runs.withColumn("failure_layer", F.when(F.col("verdict").isNotNull(), judged).otherwise(stepped))


def merge_calls(calls: DataFrame, records: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Call roll-up per key. A key of ``records`` whose log was unreadable stays NULL: unmeasured is not "no call"."""
    keys = list(keys)
    kinds = calls.where("kind is not null").groupBy(*keys).agg(F.count_distinct("kind").alias("kinds"))
    state = lambda s: F.count_if(F.col("state") == s)
    out = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"), state("completed").alias("completed"), state("failed").alias("failed"), state("started").alias("unfinished"),
        F.coalesce(F.bool_or("image_attached"), F.lit(False)).alias("image_attached"), F.coalesce(F.max("images_in_request"), F.lit(0)).alias("images_in_request"),
        F.coalesce(F.bool_or("server_ok"), F.lit(False)).alias("server_ok")).join(kinds, keys, "left")
    joined = records.groupBy(*keys).agg(F.bool_or("readable").alias("readable")).join(out, keys, "left")
    zero = lambda c: F.when(F.col("readable"), F.coalesce(F.col(c), F.lit(0)))
    return joined.select(*keys, *[zero(c).alias(c) for c in ("attempts", "completed", "failed", "unfinished", "kinds", "images_in_request")],
                         *[F.when(F.col("readable"), F.coalesce(F.col(c), F.lit(False))).alias(c) for c in ("image_attached", "server_ok")],
                         F.when(F.col("readable"), F.col("attempts").isNotNull()).alias("inference_called"))


def stage_trace(stages: DataFrame, keys: Sequence[str] = ("part_id", "arm")) -> tuple[DataFrame, DataFrame]:
    """(stages with status, traces). A trace has a handful of stages, so an earlier failure is found per key."""
    keys = list(keys)
    # A stage fails if it ran and was not ok, or if nobody knows whether it ran and nothing failed before it.
    sure = ~F.col("ok") & F.col("ran").eqNullSafe(True)
    maybe = ~F.col("ok") & F.col("ran").isNull()
    w = running_max_before(stages.withColumn("_bad", (sure | maybe).cast("int")), keys, [F.col("pos")], F.col("_bad"), "_before")
    blocked = F.coalesce(F.col("_before") == 1, F.lit(False))
    status = F.when(F.col("ok"), "completed").when(sure, "failed").when(blocked, "blocked_by_previous").when(F.col("ran").eqNullSafe(False), "not_started").otherwise("failed")
    rows = w.withColumn("status", status).drop("_bad", "_before")
    n = lambda s: F.count_if(F.col("status") == s)
    traces = rows.groupBy(*keys).agg(
        F.min_by("stage", F.when(~F.col("ok"), F.col("pos"))).alias("first_divergence"),
        F.max_by("stage", F.when(F.col("status") == "failed", F.col("pos"))).alias("terminal_failure"),
        F.max_by("stage", F.when(F.col("status").isin("completed", "failed"), F.col("pos"))).alias("last_stage_reached"),
        n("completed").alias("completed"), n("failed").alias("failed"), n("not_started").alias("not_started"), n("blocked_by_previous").alias("blocked"))
    return rows, traces


def run_summary(results: DataFrame, keys: Sequence[str] = ("condition",)) -> tuple[DataFrame, DataFrame]:
    """(per key: cases, upper-median and total seconds; per key, status and error class: counts)."""
    keys = list(keys)
    s = results.withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
    totals = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.sum("seconds").alias("total_seconds"))
    counts = s.groupBy(*keys, "seconds").agg(F.count(F.lit(1)).alias("n"))
    med = rank_value(counts, keys, "seconds", "n", "median_seconds")
    return totals.join(med, keys), s.groupBy(*keys, "status", "error_class").agg(F.count(F.lit(1)).alias("cases"))


def lab_summary(rows: DataFrame, flags: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Attempts, distinct parts and, per flag, how many are true and how many were never measured."""
    per = [c for f in flags for c in (F.count_if(F.col(f).eqNullSafe(True)).alias(f), F.count_if(F.col(f).isNull()).alias(f"{f}_unmeasured"))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("part_id").alias("unique_parts"), *per)


def classify_rows(rows: DataFrame) -> DataFrame:
    """Use of each row per arm: excluded (quarantined or reused), unknown (unmeasured), positive or negative."""
    use = F.when(F.col("quarantined"), "excluded").when(F.col("passed").isNull(), "unknown").when(F.col("passed"), "positive").otherwise("negative")
    return rows.withColumn("use", use)


def training_decision(classified: DataFrame, minimum_parts: int = 10) -> DataFrame:
    """Per arm: whether enough distinct labelable parts exist on both sides."""
    parts = lambda u: F.count_distinct(F.when(F.col("use") == u, F.col("part_id")))
    out = classified.groupBy("arm").agg(F.count(F.lit(1)).alias("rows"), parts("positive").alias("positive_parts"), parts("negative").alias("negative_parts"),
                                        F.count_if(F.col("use") == "unknown").alias("unknown"), F.count_if(F.col("use") == "excluded").alias("excluded"))
    enough = (F.col("positive_parts") + F.col("negative_parts") >= minimum_parts) & (F.col("positive_parts") > 0) & (F.col("negative_parts") > 0)
    return out.withColumn("decision", F.when(enough, "train").otherwise("collect_more"))


def frozen_rate(manifest: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rates per scope class, failure codes): the manifest fixes the denominator; missing cases count against it."""
    j = manifest.join(cases, "case_id", "left")
    good = F.count_if(F.col("verdict_pass").eqNullSafe(True))
    rates = j.groupBy("scope_class").agg(F.count(F.lit(1)).alias("cases"), F.count("verdict_pass").alias("evaluated"), good.alias("correct"))
    rates = rates.withColumn("correct_rate", ratio(F.col("correct"), F.col("cases"))).withColumn("conditional_rate", ratio(F.col("correct"), F.col("evaluated")))
    codes = j.select("scope_class", F.explode("failure_codes").alias("code")).groupBy("scope_class", "code").agg(F.count(F.lit(1)).alias("cases"))
    return rates, codes


def budget(calls: DataFrame) -> DataFrame:
    return calls.groupBy("phase").agg(F.count_if("dispatched").alias("dispatched"), F.count_if(~F.col("dispatched")).alias("held"))


def dispositions(matrix: DataFrame, attempts: DataFrame, keys: Sequence[str] = ("page_id", "arm")) -> DataFrame:
    """What became of each planned cell: passed, failed, unfinished or not_run, with its attempt count."""
    keys = list(keys)
    a = attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), F.bool_or(F.col("state") == "pass").alias("_p"), F.bool_or(F.col("state") == "failed").alias("_f"))
    d = F.when(F.col("attempts").isNull(), "not_run").when(F.col("_p"), "passed").when(F.col("_f"), "failed").otherwise("unfinished")
    return matrix.join(a, keys, "left").select(*keys, F.coalesce("attempts", F.lit(0)).alias("attempts"), d.alias("disposition"))


def job_report(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs against finished runs by idempotency key: cached, blocked (with reason) or pending."""
    done = runs.where("state = 'completed'").select("idempotency_key").distinct().withColumn("_done", F.lit(True))
    status = F.when(F.col("_done"), "cached").when(F.col("blocked_by").isNotNull(), "blocked").otherwise("pending")
    return jobs.join(done, "idempotency_key", "left").withColumn("status", status).groupBy("status", F.when(status == "blocked", F.col("blocked_by")).alias("reason")).agg(F.count(F.lit(1)).alias("jobs"))


def drift(published: DataFrame, measured: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows where a published table and the measured runs disagree: missing, unpublished or the differing columns."""
    keys = list(keys)
    p = published.select(*keys, F.lit(True).alias("_p"), *[F.col(v).alias(f"p_{v}") for v in values])
    m = measured.select(*keys, F.lit(True).alias("_m"), *[F.col(v).alias(f"m_{v}") for v in values])
    j = p.join(m, keys, "full")
    diff = F.array_compact(F.array(*[F.when(~F.col(f"p_{v}").eqNullSafe(F.col(f"m_{v}")), v) for v in values]))
    kind = F.when(F.col("_m").isNull(), "not_measured").when(F.col("_p").isNull(), "not_published").when(F.size(diff) > 0, "differs")
    return j.select(*keys, kind.alias("drift"), diff.alias("columns")).where("drift is not null")


def split_by_family(parts: DataFrame, held_out: Sequence[str]) -> DataFrame:
    """Split decided by family before any row is derived."""
    return parts.withColumn("split", F.when(F.col("family").isin(*held_out), "held_out").otherwise("train"))


def quarantine(parts: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean parts, quarantined parts with reason)."""
    return parts.join(reasons.select("part_id").distinct(), "part_id", "left_anti"), parts.join(reasons, "part_id")


def latest_revision(log: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Newest revision per key; ``conflict`` when that revision was written with different contents."""
    keys = list(keys)
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    rows = log.withColumn("_d", digest)
    # Equal rows of a revision collapse before the shuffle; two digests are enough to see a conflict.
    per = rows.groupBy(*keys, "revision").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"), F.min_by(F.struct(*content), "_d").alias("_c"))
    top = per.groupBy(*keys).agg(F.max_by(F.struct("revision", "_c", (F.col("_lo") != F.col("_hi")).alias("conflict")), "revision").alias("t"))
    return top.select(*keys, "t.revision", *[F.col(f"t._c.{c}").alias(c) for c in content], "t.conflict")


def field_changes(revisions: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per field that differs from the previous revision of its key."""
    state = F.struct(*[F.col(f).cast("string").alias(f) for f in fields])
    prev = lag_value(revisions, list(keys), [F.col("revision")], state, "_prev").where("_prev is not null")
    rows = F.array_compact(F.array(*[F.when(~F.col(f).cast("string").eqNullSafe(F.col(f"_prev.{f}")), F.struct(
        F.lit(f).alias("field"), F.col(f"_prev.{f}").alias("old"), F.col(f).cast("string").alias("new"))) for f in fields]))
    return prev.select(*keys, "revision", "actor", F.inline(rows))
