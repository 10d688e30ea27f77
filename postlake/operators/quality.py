"""Data quality (Q1-Q4): validation as data, not exceptions.

Every post gets an ``errors`` array (hard problems -> quarantine) and a
``warnings`` array (kept, flagged).  The split is a pair of filters over the
same projection, so a bad record never stops the batch (Q2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.schemas import KEY


def _blank(c):
    return F.col(c).isNull() | (F.col(c) == F.lit(""))


def _issue(cond, name):
    return F.when(cond, F.lit(name))


def with_issues(posts: DataFrame) -> DataFrame:
    """Q1: required fields per platform; an unparsed timestamp is a warning
    because the row keeps ``collected_at`` (D11)."""
    p = F.col("platform")
    errors = F.array_compact(F.array(
        _issue(_blank("platform"), "missing_platform"),
        _issue(_blank("object_id"), "missing_object_id"),
        _issue(_blank("author_handle"), "missing_author_handle"),
        _issue(F.col("text").isNull(), "missing_text"),
        _issue(F.col("created_at").isNull(), "missing_created_at"),
        _issue((p == "reddit") & F.col("subreddit").isNull(), "missing_subreddit"),
        _issue((p == "reddit") & F.col("title").isNull(), "missing_title"),
        _issue((p.isin("bluesky", "mastodon")) & _blank("handle"), "missing_handle"),
        _issue((p == "mastodon") & _blank("instance"), "missing_instance"),
    ))
    warnings = F.array_compact(F.array(
        _issue(F.col("created_at_fallback"), "created_at_fallback"),
    ))
    return posts.withColumn("errors", errors).withColumn("warnings", warnings)


def split_valid(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q2: (valid posts, quarantine rows).  Both are lazy filters of one
    projection; cache the input if both are consumed by separate actions."""
    checked = with_issues(posts)
    valid = checked.where(F.size("errors") == 0).drop("errors", "warnings")
    quarantine = checked.where(F.size("errors") > 0)
    return valid, quarantine


def issues_report(posts: DataFrame) -> DataFrame:
    """Rows with any issue: key, comma-joined issues, and whether quarantined."""
    checked = with_issues(posts)
    return checked.where(F.size("errors") + F.size("warnings") > 0).select(
        "platform", "object_id",
        F.array_join(F.concat("errors", "warnings"), ",").alias("issues"),
        (F.size("errors") > 0).alias("quarantined"),
    )


def duplicate_keys(posts: DataFrame, key=KEY) -> DataFrame:
    """Q4: keys held by more than one row (empty when the key is unique).
    A partial aggregation: hot keys collapse map-side before the shuffle."""
    return posts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
