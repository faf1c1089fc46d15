"""Registry of named queries over the driver tables.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` and, where the operator can be
written in SQL, an independent DuckDB oracle with identical column names and types.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def iso(col: str, ts: bool = False):
    """Render a DATE (or TIMESTAMP) as ISO text so result hashes do not depend on how a client
    library materialises temporal types."""
    from pyspark.sql import functions as F
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss" if ts else "yyyy-MM-dd").alias(col)


def long_form_sql(base: str, cols: list[str], y: str = "y", extra: str = "") -> str:
    """UNION ALL of (col_name, col_ord, value, y) rows: the SQL twin of ``unpivot``."""
    parts = [f"SELECT '{c}' AS col_name, {i} AS col_ord, CAST({c} AS VARCHAR) AS value, "
             f"{y} AS y{extra} FROM {base}" for i, c in enumerate(cols)]
    return "\nUNION ALL\n".join(parts)
