"""Job specs and platform registry (X1, X2) and spec-driven collection
(S15 batch, S16 continuous), composed from the selection operators.

The reference's collectors call remote APIs; here each platform's landed
payloads are a DataFrame and the same selection rules become one plan:

* batch (S15): Reddit searches the keywords (quota ``max // n`` per term,
  last week, relevance) when keywords are given, otherwise reads each
  community's feed (``sort_by`` / ``time_filter``, ``max`` each); Bluesky
  searches the keywords (quota, at most ``bluesky_cap`` per term) or reads the timeline
  (first ``max``); Mastodon reads, per known instance, the hashtag timelines
  (``max // n`` per tag) or the public timeline (``max``).  As in the
  reference, ``keywords`` drive both Reddit and Bluesky.
* continuous (S16): the batch sizes of the spec's ``continuous_batch``; Reddit
  ignores keywords; Bluesky searches the keywords, then the hashtags (a full
  batch each; the first ``term_limit`` of each list, if the spec has a limit),
  and reads the public feed only when both are empty; Mastodon as in batch.

A platform is an adapter in ``ADAPTERS``; batch collection and streams look it
up there.  A registered platform without selection rules of its own is collected
as its first ``max_posts`` posts in arrival order.

Quotas never drop to 0 (D15).  The result keeps one row per (post,
selection) -- a post selected twice appears twice (U1) until the upsert.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake import schemas as S
from postlake.operators import normalize as N
from postlake.operators import search as Q

log = logging.getLogger(__name__)

# Default batch sizes of continuous collection.
CONTINUOUS_BATCH = {"reddit": 50, "bluesky": 30, "mastodon": 15}
PLATFORMS = ("reddit", "bluesky", "mastodon")


@dataclass(frozen=True)
class PlatformAdapter:
    """A platform = its raw payload schema and its normalizer."""
    name: str
    raw_schema: T.StructType
    normalizer: Callable[..., DataFrame]


ADAPTERS: dict[str, PlatformAdapter] = {
    "reddit_submission": PlatformAdapter("reddit_submission", S.REDDIT_SUBMISSION, N.reddit_submission),
    "reddit_comment": PlatformAdapter("reddit_comment", S.REDDIT_COMMENT, N.reddit_comment),
    "bluesky": PlatformAdapter("bluesky", S.BLUESKY_POST, N.bluesky_post),
    "mastodon": PlatformAdapter("mastodon", S.MASTODON_STATUS, N.mastodon_status),
}


def register_platform(adapter: PlatformAdapter) -> None:
    """Add a platform; batch and streaming jobs pick it up by name."""
    ADAPTERS[adapter.name] = adapter


@dataclass(frozen=True)
class CollectSpec:
    """What a collection run selects.  ``as_of`` replaces now()."""
    as_of: str
    platforms: tuple[str, ...] = PLATFORMS
    subreddits: tuple[str, ...] = ("all",)
    keywords: tuple[str, ...] = ()
    hashtags: tuple[str, ...] = ()
    instances: tuple[str, ...] = ("https://mastodon.social",)
    max_posts_per_subreddit: int = 1000
    max_posts: int = 1000
    max_posts_per_instance: int = 1000
    sort_by: str = "hot"
    time_filter: str = "day"
    continuous: bool = False
    continuous_batch: dict = field(default_factory=lambda: dict(CONTINUOUS_BATCH))
    term_limit: int | None = None
    bluesky_cap: int | None = Q.BLUESKY_TERM_CAP
    extra: dict = field(default_factory=dict)

    def check(self) -> "CollectSpec":
        """Limits positive, sort and time filter allowed, lists
        non-empty where a platform needs them.  Unknown platforms are no
        error: ``collect`` skips them with a note (F13)."""
        for name in ("max_posts_per_subreddit", "max_posts", "max_posts_per_instance"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.sort_by not in Q.REDDIT_SORTS:
            raise ValueError(f"sort_by must be one of {Q.REDDIT_SORTS}")
        if self.time_filter not in Q.TIME_FILTERS:
            raise ValueError(f"time_filter must be one of {sorted(Q.TIME_FILTERS)}")
        if "reddit" in self.platforms and not self.subreddits:
            raise ValueError("reddit needs at least one subreddit")
        if "mastodon" in self.platforms and not self.instances:
            raise ValueError("mastodon needs at least one instance")
        if any(not t for t in self.keywords + self.hashtags):
            raise ValueError("empty search term")
        return self


def known_platforms(platforms, enabled=None) -> tuple[str, ...]:
    """keep enabled platforms (default: built-in and registered ones),
    skip the rest with a note."""
    enabled = {*PLATFORMS, *ADAPTERS} if enabled is None else enabled
    skipped = [p for p in platforms if p not in enabled]
    if skipped:
        log.warning("unknown platforms skipped: %s", ", ".join(skipped))
    return tuple(p for p in platforms if p in enabled)


def _sel(df: DataFrame, source) -> DataFrame:
    return df.withColumn("source", source)


def collect(spark: SparkSession, raw: dict[str, DataFrame], spec: CollectSpec,
            collected_at=None) -> DataFrame:
    """The selected posts of every platform of ``spec``, in the
    unified schema plus ``source`` (what selected it) and ``rank``."""
    spec.check()
    platforms = known_platforms(spec.platforms)
    parts = []
    if "reddit" in platforms and "reddit_submission" in raw:
        parts.append(_reddit(spark, N.storage_form(N.reddit_submission(raw["reddit_submission"], collected_at)), spec))
    if "bluesky" in platforms and "bluesky" in raw:
        parts.append(_bluesky(spark, N.storage_form(N.bluesky_post(raw["bluesky"], collected_at)), spec))
    if "mastodon" in platforms and "mastodon" in raw:
        parts.append(_mastodon(spark, raw["mastodon"], spec, collected_at))
    for name in platforms:
        if name not in PLATFORMS and name in raw:
            parts.append(_registered(ADAPTERS[name], raw[name], spec, collected_at))
    out = None
    cols = S.POST_COLUMNS + ["source", "rank"]
    for p in parts:
        p = p.select(*cols)
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("nothing to collect for this spec")
    return out


def _registered(adapter: PlatformAdapter, raw: DataFrame, spec: CollectSpec, collected_at) -> DataFrame:
    n = spec.continuous_batch.get(adapter.name, spec.max_posts) if spec.continuous else spec.max_posts
    posts = N.storage_form(adapter.normalizer(raw, collected_at)).orderBy("seq", "object_id").limit(n)
    # A global rank over at most n rows (a top-n first).
    ranked = posts.withColumn("rank", F.row_number().over(Window.orderBy("seq", "object_id")))
    return _sel(ranked, F.lit(f"timeline:{adapter.name}"))


def _reddit(spark, posts: DataFrame, spec: CollectSpec) -> DataFrame:
    if spec.keywords and not spec.continuous:
        ks = Q.KeywordSearch(tuple(spec.keywords), spec.max_posts_per_subreddit, spec.as_of)
        m = Q.keyword_search(spark, posts.where(F.col("platform") == "reddit"), ks, whole=True)
        return _sel(m, F.concat(F.lit("keyword:"), F.col("term")))
    n = spec.continuous_batch["reddit"] if spec.continuous else spec.max_posts_per_subreddit
    f = Q.community_feed(posts, list(spec.subreddits), spec.sort_by, n, spec.as_of, spec.time_filter)
    return _sel(f, F.concat(F.lit("feed:"), F.col("subreddit")))


def _bluesky(spark, posts: DataFrame, spec: CollectSpec) -> DataFrame:
    kw = list(spec.keywords[:spec.term_limit] if spec.continuous else spec.keywords)
    tags = list(spec.hashtags[:spec.term_limit]) if spec.continuous else []
    n = spec.continuous_batch["bluesky"] if spec.continuous else spec.max_posts
    parts = []
    if kw:
        # Continuous mode asks each term for a full batch (no quota split).
        total = n * len(kw) if spec.continuous else n
        ks = Q.KeywordSearch(tuple(kw), total, spec.as_of, bluesky_cap=spec.bluesky_cap)
        m = Q.keyword_search(spark, posts, ks, whole=True)
        parts.append(_sel(m, F.concat(F.lit("keyword:"), F.col("term"))))
    if tags:
        h = Q.hashtag_search_posts(spark, posts, tags, n * len(tags), spec.bluesky_cap)
        parts.append(_sel(h, F.concat(F.lit("hashtag:"), F.col("term"))))
    if not kw and not tags:
        # A global rank over at most n rows (the timeline is a top-n first).
        t = Q.timeline(posts, "bluesky", n)
        t = t.withColumn("rank", F.row_number().over(Window.orderBy("seq", "object_id")))
        parts.append(_sel(t, F.lit("timeline")))
    out = None
    for p in parts:
        p = p.select(*(S.POST_COLUMNS + ["source", "rank"]))
        out = p if out is None else out.unionByName(p)
    return out


def _mastodon(spark, raw_status: DataFrame, spec: CollectSpec, collected_at) -> DataFrame:
    n = spec.continuous_batch["mastodon"] if spec.continuous else spec.max_posts_per_instance
    sel = Q.collect_from_instances(spark, raw_status, list(spec.instances), n, list(spec.hashtags))
    src = F.when(F.col("term").isNotNull(),
                 F.concat(F.lit("hashtag:"), F.regexp_replace(F.lower("term"), "^#+", ""),
                          F.lit("@"), F.col("instance_key"))) \
        .otherwise(F.concat(F.lit("timeline@"), F.col("instance_key")))
    raw = sel.select(*[f.name for f in S.MASTODON_STATUS.fields], src.alias("source"), "rank")
    return N.storage_form(N.mastodon_status(raw, collected_at, keep=("source", "rank")))
