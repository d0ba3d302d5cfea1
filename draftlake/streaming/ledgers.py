"""Structured Streaming forms of the append-only logs. Event time is ``ts``; every state is bounded by a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from draftlake.operators import coverage


def stream_calls(events: DataFrame, timeout: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """started/finished events paired per call: completed, failed, or unfinished once ``timeout`` has passed.

    ``events`` (call_id, event started/completed/failed, ts).
    """
    begun = events.where("event = 'started'").select("call_id", F.col("ts").alias("started_at")).withWatermark("started_at", delay)
    ended = events.where("event <> 'started'").select(F.col("call_id").alias("end_id"), F.col("event").alias("outcome"), F.col("ts").alias("finished_at")).withWatermark("finished_at", delay)
    within = (F.col("call_id") == F.col("end_id")) & (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= F.col("started_at") + F.expr(f"interval {timeout}"))
    return begun.join(ended, within, "leftOuter").select("call_id", "started_at", "finished_at", F.coalesce("outcome", F.lit("unfinished")).alias("state"))


def stream_outcomes(events: DataFrame, size: str = "10 minutes", slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Counts per outcome over tumbling or sliding event-time windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event").agg(F.count(F.lit(1)).alias("calls"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event", "calls")


def stream_sessions(events: DataFrame, gap: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """Bursts of calls per key: a gap closes a session."""
    out = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "run_id").agg(F.count(F.lit(1)).alias("calls"))
    return out.select("run_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "calls")


REVISION_OUT = "session_id string, base_revision int, revision int, status string, ts timestamp"
REVISION_STATE = "revision int"


def _commit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Accept saves whose base is the current revision, refuse the rest; one number of state per session."""
    current = state.get[0] if state.exists else 0
    rows: list[dict[str, Any]] = []
    for save in sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: (r.ts, r.ord)):
        accepted = save.base_revision == current
        current += int(accepted)
        rows.append({"session_id": key[0], "base_revision": int(save.base_revision), "revision": current, "status": "accepted" if accepted else "stale_base_revision", "ts": save.ts})
    state.update((current,))
    yield pd.DataFrame(rows, columns=["session_id", "base_revision", "revision", "status", "ts"])


def stream_revisions(saves: DataFrame) -> DataFrame:
    """Current revision per session; a save on a stale base is refused. ``saves`` (session_id, base_revision, ord, ts)."""
    return saves.groupBy("session_id").applyInPandasWithState(_commit, REVISION_OUT, REVISION_STATE, "append", GroupStateTimeout.NoTimeout)


def stream_dedupe(jobs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First submission per idempotency key within the watermark."""
    return jobs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def stream_coverage(spans: DataFrame, printed: DataFrame, callouts: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None):
    """Incremental coverage: each micro-batch's readings are classified against the printed tables and written under
    their batch number, so a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        classes, _ = coverage.printed_coverage(batch, printed, callouts)
        classes.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(classes, number)

    return spans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
