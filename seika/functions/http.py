"""Request-log classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths kept as they are (exact match) and path prefixes folded
# to one label, checked in this order; anything else is "/other".
EXACT_PATHS = [
    "/health", "/ready", "/metrics", "/doc", "/doc-llm",
    "/monitoring/dashboard", "/monitoring/snapshots.csv",
]
PREFIX_PATHS = [
    "/v1/markets", "/v1/items", "/v1/origins", "/v1/prices/daily",
    "/v1/prices/trend", "/v1/prices/summary", "/v1/compare/markets",
    "/v1/rankings/items", "/ingestion/runs", "/ingestion/files",
]
OTHER_PATH = "/other"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def status_class(c) -> Column:
    """1xx ... 5xx, else 'other'."""
    s = _c(c)
    out = F.lit("other")
    for k in (5, 4, 3, 2, 1):
        out = F.when((s >= k * 100) & (s < (k + 1) * 100), F.lit(f"{k}xx")).otherwise(out)
    return out


def normalize_path(c) -> Column:
    """Exact system paths, then API prefixes in order, else '/other'."""
    p = _c(c)
    expr = None
    for path in EXACT_PATHS:
        cond = p == F.lit(path)
        expr = F.when(cond, F.lit(path)) if expr is None else expr.when(cond, F.lit(path))
    for path in PREFIX_PATHS:
        expr = expr.when(p.startswith(path), F.lit(path))
    return expr.otherwise(F.lit(OTHER_PATH))
