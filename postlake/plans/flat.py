"""Flat, engine-neutral output shapes for comparing with the SQL oracle:
instants as epoch microseconds, maps as one column per key, arrays as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import schemas as S

FLAT_POST_COLUMNS = [
    "platform", "object_id", "author_handle", "text", "created_us", "tags", "url",
    "parent_id", "is_comment", "subreddit", "title", "is_nsfw", "handle", "display_name",
    "avatar_url", "is_reply", "is_repost", "reply_to", "repost_of", "instance", "is_reblog",
    "is_sensitive", "reblog_of", "seq", "created_at_fallback",
] + [f"m_{k}" for k in S.ALL_METRIC_KEYS]


def epoch_us(c):
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def flat_posts(posts: DataFrame) -> DataFrame:
    cols = []
    for c in FLAT_POST_COLUMNS:
        if c == "created_us":
            cols.append(epoch_us("created_at").alias(c))
        elif c == "tags":
            cols.append(F.array_join("tags", ",").alias(c))
        elif c.startswith("m_"):
            cols.append(F.try_element_at("metrics", F.lit(c[2:])).alias(c))
        else:
            cols.append(F.col(c))
    return posts.select(*cols)
