"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOTAL = "total"
OTHER = "other"


def count_by_platform(spark: SparkSession, posts: DataFrame, platforms: list[str]) -> DataFrame:
    """Rows per listed platform (0 when absent), ``other`` for
    unlisted platforms and ``total`` -- one pass with ``rollup``, then a join
    to the (small, spec-given) list to zero-fill."""
    bucket = F.when(F.col("platform").isin(list(platforms)), F.col("platform")).otherwise(F.lit(OTHER))
    counts = posts.select(bucket.alias("platform")).rollup("platform") \
        .agg(F.count(F.lit(1)).alias("n")) \
        .select(F.coalesce(F.col("platform"), F.lit(TOTAL)).alias("platform"), "n")
    wanted = spark.createDataFrame([(p,) for p in list(platforms) + [OTHER, TOTAL]], "platform string")
    return wanted.join(F.broadcast(counts), "platform", "left") \
        .select("platform", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def running_totals(versions: DataFrame, batch_col: str) -> DataFrame:
    """A4: keys first seen per batch and the running store size per
    platform.  The running sum is a window over (platform, batch) counts --
    already aggregated, so its partitions are tiny."""
    firsts = versions.groupBy("platform", "object_id").agg(F.min(batch_col).alias(batch_col))
    ins = firsts.groupBy("platform", batch_col).agg(F.count(F.lit(1)).alias("inserted"))
    days = versions.select("platform", batch_col).distinct()
    c = days.join(ins, ["platform", batch_col], "left") \
        .withColumn("inserted", F.coalesce(F.col("inserted"), F.lit(0)).cast("long"))
    w = Window.partitionBy("platform").orderBy(batch_col) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.withColumn("total", F.sum("inserted").over(w).cast("long"))


def collected_per_platform(batch: DataFrame) -> DataFrame:
    """A3: rows collected per platform in one run, before de-duplication."""
    return batch.groupBy("platform").agg(F.count(F.lit(1)).alias("collected"))


def latest_status(metrics: DataFrame) -> DataFrame:
    """Latest status, update time and counts per platform from the
    per-batch metrics table."""
    return metrics.groupBy("platform").agg(
        F.max("ts").alias("last_update"),
        F.max_by("status", "ts").alias("status"),
        F.sum("inserted").alias("posts"),
        F.sum("incoming").alias("incoming"))


def throughput(metrics: DataFrame) -> DataFrame:
    """Rows per second and success rate per platform over the metrics
    table."""
    return metrics.groupBy("platform").agg(
        (F.sum("incoming") / F.greatest(F.sum("duration_s"), F.lit(1e-9))).alias("rows_per_s"),
        (F.count_if(F.col("status") == "ok") / F.count(F.lit(1))).alias("success_rate"),
        F.count_if(F.col("status") != "ok").alias("failures"))
