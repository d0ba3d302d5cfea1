"""All registered queries: name -> callable(spark, sf_dir), and their DuckDB statements."""

from __future__ import annotations

from draftlake.plans import (
    evaluation_queries, geometry_queries, ledger_queries, meaning_queries, scale_queries, session_queries, stream_queries, text_queries,
)

MODULES = [
    scale_queries, text_queries, evaluation_queries, geometry_queries, ledger_queries, session_queries, stream_queries, meaning_queries,
]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
