"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus the DuckDB
oracle SQL of each.  Every query reads the driver's tables (or what Spark
derives from them) in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _load_all() -> None:
    # Importing the query modules fills the registry.
    from postlake.plans import q_normalize, q_search, q_upsert, q_store  # noqa: F401
    from postlake.plans import q_stream, q_collect  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
