"""The driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


_READS: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; Catalyst prunes columns and pushes filters into the
    scan.  The (lazy) DataFrame is reused within a session, so its file
    listing and footer read happen once."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    df = _READS.get(key)
    if df is None:
        df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
        _READS[key] = df
    return df
