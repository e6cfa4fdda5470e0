"""Registered queries and their reference SQL.

Every query runs over the whole tables of a data folder; the tables of the
engine (documents, scans, targets, jobs, ...) are derived from them in Spark.
"""

from __future__ import annotations

import importlib

from catalog.base import ORACLES, QUERIES

MODULES = (
    "search_queries", "store_queries", "expression_queries", "range_queries",
    "rule_queries", "coverage_queries", "shape_queries", "source_queries",
    "report_queries", "stream_queries",
)


def load() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
    return QUERIES, ORACLES
