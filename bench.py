"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from draftlake.plans import registry
from draftlake.session import build_session

HEADLINE = [
    "scale_verdict_lineitem", "scale_consensus_lineitem", "scale_trimmed_median_lineitem", "dimension_extraction_parts", "callout_code_profile_parts",
    "text_class_documents", "forbidden_terms_documents", "callout_candidates_lineitem", "evaluation_metrics_parts", "duplicate_classes_parts",
    "interval_merge_lineitem", "phrase_grouping_orders", "contour_audit_orders", "anchor_strokes_orders", "printed_coverage_lineitem",
    "feature_pairing_embeddings", "callout_compile_orders", "latest_revisions_events", "call_rollup_events", "group_identity_lineitem",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-bench-")})
    queries = registry.queries()
    spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
