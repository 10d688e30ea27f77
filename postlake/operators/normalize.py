"""Normalizers (N1-N11): raw platform payloads to the unified post schema.

Each normalizer is one ``select`` of built-in expressions over the landed
payload schema: narrow, no shuffle, fully inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import schemas as S
from postlake.functions import scalars as X

DEFAULT_COLLECTED_AT = "2024-02-01 00:00:00"

# Fixed value: the collection whose commits are posts.
POST_COLLECTION = "app.bsky.feed.post"

_FALSE_DEFAULTS = ["is_comment", "is_nsfw", "is_reply", "is_repost", "is_reblog",
                   "is_sensitive", "created_at_fallback"]


def _ts_lit(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, _dt.datetime):
        v = v.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(v or DEFAULT_COLLECTED_AT).cast("timestamp")


def _metrics(pairs: list[tuple[str, Column]]) -> Column:
    args = []
    for k, v in pairs:
        args += [F.lit(k), v.cast("long") if v is not None else F.lit(None).cast("long")]
    return F.create_map(*args)


def to_post_schema(df: DataFrame, keep=()) -> DataFrame:
    """Conform to the unified schema (N8): missing platform columns null,
    flags false, column order and types fixed.  Built as one SQL projection
    (one driver call instead of one per expression).  ``keep`` names further
    columns that pass through."""
    have = set(df.columns)
    exprs = []
    for f in S.POST.fields:
        typ = f.dataType.simpleString()
        c = f"CAST(`{f.name}` AS {typ})" if f.name in have else f"CAST(NULL AS {typ})"
        if f.name in _FALSE_DEFAULTS:
            c = f"COALESCE({c}, false)"
        exprs.append(f"{c} AS `{f.name}`")
    return df.selectExpr(*exprs, *[f"`{c}`" for c in keep])


def _timestamp(raw: Column, collected: Column) -> tuple[Column, Column]:
    parsed = X.parse_iso_ts(raw)
    return F.coalesce(parsed, collected), parsed.isNull()


def reddit_submission(raw: DataFrame, collected_at=None) -> DataFrame:
    """Reddit submission payload to posts."""
    col = _ts_lit(collected_at)
    df = raw.select(
        F.lit("reddit").alias("platform"),
        F.col("id").alias("object_id"),
        X.author_or_deleted(F.col("author.name")).alias("author_handle"),
        X.first_non_empty("selftext", "title").alias("text"),
        X.epoch_to_ts("created_utc").alias("created_at"),
        _metrics([("likes", F.lit(0)), ("shares", F.lit(0)), ("comments", F.col("num_comments")),
                  ("upvotes", F.col("ups")), ("downvotes", F.col("downs")), ("views", None),
                  ("score", F.col("score")), ("gilded", F.col("gilded"))]).alias("metrics"),
        F.concat(F.lit(X.REDDIT_BASE), F.col("permalink")).alias("url"),
        F.lit(False).alias("is_comment"),
        X.json_of(F.struct(
            F.col("id").alias("submission_id"), "subreddit_id",
            F.col("author.id").alias("author_id"), "created_utc", "edited", "distinguished",
            "mod_reports", "user_reports")).alias("raw_data"),
        F.col("subreddit.display_name").alias("subreddit"),
        F.col("title"),
        F.coalesce(F.col("over_18"), F.lit(False)).alias("is_nsfw"),
        F.col("seq"), col.alias("collected_at"),
        F.col("created_utc").isNull().alias("created_at_fallback"),
    ).withColumn("created_at", F.coalesce("created_at", "collected_at"))
    return to_post_schema(df)


def reddit_comment(raw: DataFrame, collected_at=None) -> DataFrame:
    """Reddit comment payload to posts (title '', is_comment true)."""
    col = _ts_lit(collected_at)
    df = raw.select(
        F.lit("reddit").alias("platform"),
        F.col("id").alias("object_id"),
        X.author_or_deleted(F.col("author.name")).alias("author_handle"),
        F.col("body").alias("text"),
        X.epoch_to_ts("created_utc").alias("created_at"),
        _metrics([("likes", F.lit(0)), ("shares", F.lit(0)), ("comments", F.lit(0)),
                  ("upvotes", F.col("ups")), ("downvotes", F.col("downs")), ("views", None),
                  ("score", F.col("score")), ("gilded", F.col("gilded"))]).alias("metrics"),
        F.concat(F.lit(X.REDDIT_BASE), F.col("permalink")).alias("url"),
        F.col("parent_id"),
        F.lit(True).alias("is_comment"),
        X.json_of(F.struct(
            F.col("id").alias("comment_id"), F.col("submission.id").alias("submission_id"),
            "subreddit_id", F.col("author.id").alias("author_id"), "created_utc", "edited",
            "distinguished", "mod_reports", "user_reports")).alias("raw_data"),
        F.col("subreddit.display_name").alias("subreddit"),
        F.lit("").alias("title"),
        F.lit(False).alias("is_nsfw"),
        F.col("seq"), col.alias("collected_at"),
        F.col("created_utc").isNull().alias("created_at_fallback"),
    ).withColumn("created_at", F.coalesce("created_at", "collected_at"))
    return to_post_schema(df)


def bluesky_post(raw: DataFrame, collected_at=None) -> DataFrame:
    """Bluesky post view to posts.  Reply/repost flags are constant false
    and tags empty, as the reference stores them; engagement counts are read
    when the payload carries them, else 0."""
    col = _ts_lit(collected_at)
    oid = X.last_path_segment(F.coalesce(F.col("uri"), F.lit("")))
    handle = F.coalesce(F.col("author.handle"), F.lit(""))
    created_raw = F.coalesce(F.col("record.created_at"), F.col("record.createdAt"))
    ts, fell_back = _timestamp(created_raw, col)
    payload = [c for c in raw.columns if c != "seq"]
    df = raw.select(
        F.lit("bluesky").alias("platform"),
        oid.alias("object_id"),
        handle.alias("author_handle"),
        F.coalesce(F.col("record.text"), F.lit("")).alias("text"),
        ts.alias("created_at"),
        F.array().cast("array<string>").alias("tags"),
        _metrics([("likes", F.coalesce(F.col("likeCount"), F.lit(0))), ("shares", F.lit(0)),
                  ("comments", F.lit(0)), ("upvotes", F.lit(0)), ("downvotes", F.lit(0)),
                  ("views", None), ("reposts", F.coalesce(F.col("repostCount"), F.lit(0))),
                  ("replies", F.coalesce(F.col("replyCount"), F.lit(0)))]).alias("metrics"),
        F.concat(F.lit(X.BSKY_PROFILE), handle, F.lit("/post/"), oid).alias("url"),
        X.json_of(F.struct(*payload)).alias("raw_data"),
        handle.alias("handle"),
        F.col("author.displayName").alias("display_name"),
        F.col("author.avatar").alias("avatar_url"),
        F.col("seq"), col.alias("collected_at"),
        fell_back.alias("created_at_fallback"),
    )
    return to_post_schema(df)


def bluesky_feed_items(raw_items: DataFrame, collected_at=None) -> DataFrame:
    """Feed items without a post are skipped, the rest normalized."""
    posts = raw_items.where(F.col("post").isNotNull()).select(
        *[F.col(f"post.{f.name}").alias(f.name) for f in S.BLUESKY_POST.fields if f.name != "seq"],
        F.col("seq"))
    return bluesky_post(posts, collected_at)


def firehose_to_post_view(messages: DataFrame) -> DataFrame:
    """F9 + N5: keep commit messages of the post collection and map the
    envelope to a post view; engagement 0, indexedAt from ``time_us``."""
    m = messages.where((F.col("kind") == "commit") &
                       (F.col("commit.collection") == POST_COLLECTION))
    return m.select(
        F.col("commit.uri").alias("uri"),
        F.col("commit.cid").alias("cid"),
        F.struct(F.col("commit.record.text").alias("text"),
                 F.lit(None).cast("string").alias("created_at"),
                 F.col("commit.record.createdAt").alias("createdAt")).alias("record"),
        F.struct(F.col("author.did").alias("did"), F.col("author.handle").alias("handle"),
                 F.lit(None).cast("string").alias("displayName"),
                 F.lit(None).cast("string").alias("avatar")).alias("author"),
        F.lit(0).cast("long").alias("likeCount"),
        F.lit(0).cast("long").alias("repostCount"),
        F.lit(0).cast("long").alias("replyCount"),
        F.date_format(F.timestamp_micros("time_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("indexedAt"),
        F.col("seq"),
    )


def mastodon_status(raw: DataFrame, collected_at=None, keep=()) -> DataFrame:
    """Mastodon status to posts.  Content stays HTML; reply/reblog flags
    follow the presence of the ids; tags are read but not stored.  ``keep``
    names columns that are no part of the payload and pass through."""
    col = _ts_lit(collected_at)
    acct = F.coalesce(F.col("account.acct"), F.lit(""))
    ts, fell_back = _timestamp(F.col("created_at"), col)
    reply = X.truthy_id("in_reply_to_id")
    reblog = F.col("reblog").isNotNull()
    payload = [c for c in raw.columns if c not in ("seq", "api_base_url", *keep)]
    df = raw.select(
        F.lit("mastodon").alias("platform"),
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("object_id"),
        acct.alias("author_handle"),
        F.coalesce(F.col("content"), F.lit("")).alias("text"),
        ts.alias("created_at"),
        _metrics([("favourites", F.coalesce(F.col("favourites_count"), F.lit(0))),
                  ("reblogs", F.coalesce(F.col("reblogs_count"), F.lit(0))),
                  ("replies", F.coalesce(F.col("replies_count"), F.lit(0)))]).alias("metrics"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        X.json_of(F.struct(*payload)).alias("raw_data"),
        X.strip_scheme(F.col("api_base_url")).alias("instance"),
        acct.alias("handle"),
        F.col("account.display_name").alias("display_name"),
        F.col("account.avatar").alias("avatar_url"),
        reply.alias("is_reply"),
        reblog.alias("is_reblog"),
        F.coalesce(F.col("sensitive"), F.lit(False)).alias("is_sensitive"),
        F.when(reply, F.col("in_reply_to_id").cast("string")).alias("reply_to"),
        F.when(reblog, F.coalesce(F.col("reblog.id").cast("string"), F.lit(""))).alias("reblog_of"),
        F.col("seq"), col.alias("collected_at"),
        fell_back.alias("created_at_fallback"), *[F.col(c) for c in keep],
    )
    return to_post_schema(df, keep)


def union_posts(*frames: DataFrame) -> DataFrame:
    """One table over platforms (``unionByName``, missing columns null)."""
    out = None
    for f in frames:
        if f.columns != S.POST_COLUMNS:
            f = to_post_schema(f)
        out = f if out is None else out.unionByName(f)
    return out


def storage_form(posts: DataFrame) -> DataFrame:
    """Tags kept for Bluesky only, flags non-null."""
    return posts.withColumn(
        "tags", F.when(F.col("platform") == "bluesky", F.coalesce(
            F.col("tags"), F.array().cast("array<string>"))))


def export_record(posts: DataFrame) -> DataFrame:
    """Stored row to export record: null tags to [], null metrics to {},
    created_at as ISO text, flags as booleans."""
    return posts.select(
        *[F.col(c) for c in S.POST_COLUMNS if c not in ("tags", "metrics", "created_at", "collected_at")],
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.col("metrics"), F.create_map().cast(S.METRICS)).alias("metrics"),
        X.iso_text("created_at").alias("created_at"),
        X.iso_text("collected_at").alias("collected_at"),
    )


def slim_view(posts: DataFrame) -> DataFrame:
    """Platform, id, author, content, timestamp and a metadata JSON of
    the platform-specific fields."""
    meta = F.when(F.col("platform") == "reddit", X.json_of(F.struct(
        "subreddit", "title", "is_nsfw", "is_comment", "parent_id"))) \
        .when(F.col("platform") == "bluesky", X.json_of(F.struct(
            "handle", "display_name", "is_reply", "is_repost"))) \
        .when(F.col("platform") == "mastodon", X.json_of(F.struct(
            "instance", "handle", "is_reply", "is_reblog", "is_sensitive"))) \
        .otherwise(F.lit("{}"))
    return posts.select(
        "platform", F.col("object_id").alias("id"), F.col("author_handle").alias("author"),
        F.col("text").alias("content"), F.col("created_at").alias("timestamp"),
        meta.alias("metadata"))


def with_derived_tags(posts: DataFrame) -> DataFrame:
    """Tags derived from the text (distinct, lower case)."""
    return posts.withColumn("tags", X.hashtags_of("text"))


def all_fixture_posts(raw: dict, collected_at=None) -> DataFrame:
    """Normalize every platform's raw frame and union them."""
    parts = []
    if "reddit_submission" in raw:
        parts.append(reddit_submission(raw["reddit_submission"], collected_at))
    if "reddit_comment" in raw:
        parts.append(reddit_comment(raw["reddit_comment"], collected_at))
    if "bluesky" in raw:
        parts.append(bluesky_post(raw["bluesky"], collected_at))
    if "mastodon" in raw:
        parts.append(mastodon_status(raw["mastodon"], collected_at))
    return union_posts(*parts)


def to_record_json(posts: DataFrame) -> DataFrame:
    """Each post as one JSON object (null fields kept), plus its key."""
    return posts.select("platform", "object_id",
                        F.to_json(F.struct(*[F.col(c) for c in S.POST_COLUMNS]),
                                  {"ignoreNullFields": "false"}).alias("record"))


def from_record_json(records: DataFrame, col: str = "record") -> DataFrame:
    """JSON objects back to posts, parsed with the explicit schema."""
    return records.select(F.from_json(F.col(col), S.POST).alias("_p")).select("_p.*")


def raw_field(path: str, kind: str = "string", raw="raw_data") -> Column:
    """One nested field of the raw payload (``$.account.acct``) as ``kind``;
    null where the payload has no such field or it does not convert.  The text is
    parsed as VARIANT, so no schema of the payload is needed."""
    return F.try_variant_get(F.try_parse_json(F.col(raw) if isinstance(raw, str) else raw), path, kind)
