"""Shared building blocks of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlake.operators import normalize as N
from postlake.session import configure
from postlake.sources import fixtures as FX


_PLANS: dict[tuple, DataFrame] = {}


def raw_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "reddit_submission": FX.raw_reddit_submission(spark, sf_dir),
        "reddit_comment": FX.raw_reddit_comment(spark, sf_dir),
        "bluesky": FX.raw_bluesky_post(spark, sf_dir),
        "mastodon": FX.raw_mastodon_status(spark, sf_dir),
    }


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fixture payloads normalized and unioned in storage form.

    The (lazy) plan is built once per session and directory and reused, as
    a view would be: nothing is cached or materialized, every query still
    scans the tables."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), "unified")
    df = _PLANS.get(key)
    if df is None:
        df = N.storage_form(N.all_fixture_posts(raw_frames(spark, sf_dir)))
        _PLANS[key] = df
    return df
