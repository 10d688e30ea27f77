"""Raw payload schemas (as landed, one JSON object per line) and the unified
post schema.  Schemas are always explicit: no inference on read."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, B, D, TS = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


# Landing metadata carried by every raw row: arrival order inside the landing
# unit (a DataFrame has no order, so the order is data).
_LANDING = [_f("seq", L)]

REDDIT_AUTHOR = T.StructType([_f("name", S), _f("id", S)])
SUBREDDIT = T.StructType([_f("display_name", S)])

REDDIT_SUBMISSION = T.StructType([
    _f("id", S), _f("author", REDDIT_AUTHOR), _f("selftext", S), _f("title", S),
    _f("created_utc", D), _f("subreddit", SUBREDDIT), _f("subreddit_id", S),
    _f("over_18", B), _f("link_flair_text", S), _f("permalink", S), _f("ups", L), _f("downs", L),
    _f("score", L), _f("num_comments", L), _f("gilded", L),
    # Reddit sends these as bool-or-number / lists; kept as raw JSON text.
    _f("edited", S), _f("distinguished", S), _f("mod_reports", S), _f("user_reports", S),
    *_LANDING,
])

REDDIT_COMMENT = T.StructType([
    _f("id", S), _f("author", REDDIT_AUTHOR), _f("body", S), _f("created_utc", D),
    _f("subreddit", SUBREDDIT), _f("subreddit_id", S), _f("parent_id", S),
    _f("submission", T.StructType([_f("id", S)])), _f("permalink", S),
    _f("ups", L), _f("downs", L), _f("score", L), _f("gilded", L),
    _f("edited", S), _f("distinguished", S), _f("mod_reports", S), _f("user_reports", S),
    *_LANDING,
])

BSKY_RECORD = T.StructType([_f("text", S), _f("created_at", S), _f("createdAt", S)])
BSKY_AUTHOR = T.StructType([_f("did", S), _f("handle", S), _f("displayName", S), _f("avatar", S)])

BLUESKY_POST = T.StructType([
    _f("uri", S), _f("cid", S), _f("record", BSKY_RECORD), _f("author", BSKY_AUTHOR),
    _f("likeCount", L), _f("repostCount", L), _f("replyCount", L), _f("indexedAt", S),
    *_LANDING,
])

# A feed item wraps a post view; items without a post are skipped.
BLUESKY_FEED_ITEM = T.StructType([_f("post", BLUESKY_POST), *_LANDING])

FIREHOSE_MESSAGE = T.StructType([
    _f("kind", S),
    _f("commit", T.StructType([
        _f("collection", S), _f("uri", S), _f("cid", S),
        _f("record", T.StructType([_f("text", S), _f("createdAt", S)])),
    ])),
    _f("author", T.StructType([_f("did", S), _f("handle", S)])),
    _f("time_us", L),
    *_LANDING,
])

MASTODON_STATUS = T.StructType([
    _f("id", S), _f("content", S), _f("created_at", S),
    _f("account", T.StructType([_f("acct", S), _f("display_name", S), _f("avatar", S)])),
    _f("tags", T.ArrayType(T.StructType([_f("name", S)]))),
    _f("in_reply_to_id", S), _f("reblog", T.StructType([_f("id", S)])),
    _f("sensitive", B), _f("url", S),
    _f("favourites_count", L), _f("reblogs_count", L), _f("replies_count", L),
    # The instance the status was fetched from (the collector knows it).
    _f("api_base_url", S),
    *_LANDING,
])

METRICS = T.MapType(S, L, True)

# The one typed post schema every normalizer produces.
POST = T.StructType([
    _f("platform", S, False), _f("object_id", S, False), _f("author_handle", S, False),
    _f("text", S, False), _f("created_at", TS, False),
    _f("tags", T.ArrayType(S)), _f("metrics", METRICS, False),
    _f("url", S), _f("parent_id", S), _f("is_comment", B, False), _f("raw_data", S),
    # reddit
    _f("subreddit", S), _f("title", S), _f("is_nsfw", B, False),
    # bluesky
    _f("handle", S), _f("display_name", S), _f("avatar_url", S),
    _f("is_reply", B, False), _f("is_repost", B, False), _f("reply_to", S), _f("repost_of", S),
    # mastodon
    _f("instance", S), _f("is_reblog", B, False), _f("is_sensitive", B, False), _f("reblog_of", S),
    # ours: arrival order, collection instant, timestamp fallback flag
    _f("seq", L, False), _f("collected_at", TS, False), _f("created_at_fallback", B, False),
])

POST_COLUMNS = [f.name for f in POST.fields]

# Metric keys per platform, in the reference's field order.
BASE_METRIC_KEYS = ["likes", "shares", "comments", "upvotes", "downvotes", "views"]
REDDIT_METRIC_KEYS = BASE_METRIC_KEYS + ["score", "gilded"]
BLUESKY_METRIC_KEYS = BASE_METRIC_KEYS + ["reposts", "replies"]
MASTODON_METRIC_KEYS = ["favourites", "reblogs", "replies"]
ALL_METRIC_KEYS = ["likes", "shares", "comments", "upvotes", "downvotes", "views",
                   "score", "gilded", "reposts", "replies", "favourites", "reblogs"]

KEY = ["platform", "object_id"]
