"""Queries over normalizers, union, validation."""

from __future__ import annotations

from postlake.operators import normalize as N
from postlake.functions import scalars as X
from postlake.plans import oracle as O
from postlake.plans.common import unified
from postlake.plans.flat import flat_posts
from postlake.plans.registry import register
from postlake.session import configure
from postlake.sources import fixtures as FX


def _one(part: str):
    return f"{O.posts_cte((part,))}\nselect * from posts"


@register("norm_reddit_submission", _one("reddit_submission"))
def norm_reddit_submission(spark, sf_dir):
    configure(spark)
    return flat_posts(N.reddit_submission(FX.raw_reddit_submission(spark, sf_dir)))


@register("norm_reddit_comment", _one("reddit_comment"))
def norm_reddit_comment(spark, sf_dir):
    configure(spark)
    return flat_posts(N.reddit_comment(FX.raw_reddit_comment(spark, sf_dir)))


@register("norm_bluesky", _one("bluesky"))
def norm_bluesky(spark, sf_dir):
    configure(spark)
    return flat_posts(N.bluesky_post(FX.raw_bluesky_post(spark, sf_dir)))


@register("norm_mastodon", _one("mastodon"))
def norm_mastodon(spark, sf_dir):
    configure(spark)
    return flat_posts(N.mastodon_status(FX.raw_mastodon_status(spark, sf_dir)))


@register("unified_posts", f"{O.posts_cte()}\nselect * from posts")
def unified_posts(spark, sf_dir):
    return flat_posts(unified(spark, sf_dir))


from pyspark.sql import functions as F  # noqa: E402

from postlake.operators import quality as QA  # noqa: E402

_SLIM_SQL = f"""{O.posts_cte()}
select platform, object_id as id, author_handle as author, text as content, created_us,
       case platform
         when 'reddit' then to_json(struct_pack(subreddit := subreddit, title := title, is_nsfw := is_nsfw,
                                                is_comment := is_comment, parent_id := parent_id))
         when 'bluesky' then to_json(struct_pack(handle := handle, display_name := display_name,
                                                 is_reply := is_reply, is_repost := is_repost))
         when 'mastodon' then to_json(struct_pack(instance := instance, handle := handle, is_reply := is_reply,
                                                  is_reblog := is_reblog, is_sensitive := is_sensitive))
         else '{{}}' end as metadata
from posts"""


@register("slim_posts", _SLIM_SQL)
def slim_posts(spark, sf_dir):
    """Slim normalized view with a metadata JSON."""
    s = N.slim_view(unified(spark, sf_dir))
    return s.select("platform", "id", "author", "content",
                    F.unix_micros("timestamp").alias("created_us"), "metadata")


_INV_SQL = f"""{O.posts_cte()},
c as (select platform, object_id,
        concat_ws(',',
          case when platform is null or platform = '' then 'missing_platform' end,
          case when object_id is null or object_id = '' then 'missing_object_id' end,
          case when author_handle is null or author_handle = '' then 'missing_author_handle' end,
          case when text is null then 'missing_text' end,
          case when created_us is null then 'missing_created_at' end,
          case when platform = 'reddit' and subreddit is null then 'missing_subreddit' end,
          case when platform = 'reddit' and title is null then 'missing_title' end,
          case when platform in ('bluesky', 'mastodon') and (handle is null or handle = '') then 'missing_handle' end,
          case when platform = 'mastodon' and (instance is null or instance = '') then 'missing_instance' end) as errs,
        case when created_at_fallback then 'created_at_fallback' end as warns
      from posts)
select platform, object_id, concat_ws(',', nullif(errs, ''), warns) as issues, errs <> '' as quarantined
from c where errs <> '' or warns is not null"""


@register("invalid_posts", _INV_SQL)
def invalid_posts(spark, sf_dir):
    """Q1/Q2: posts with issues and whether they are quarantined."""
    return QA.issues_report(unified(spark, sf_dir))


_RAW_SQL = f"""with {", ".join(f"{v} as ({O.FIX[v]})" for v in O.RAW_OF.values())},
r as (
  select 'reddit' as platform, id as object_id, id as raw_id, cast(null as varchar) as raw_text, cast(null as varchar) as raw_author,
         cast(null as varchar) as raw_time, cast(created_utc as bigint) as raw_seconds, cast(null as varchar) as raw_parent,
         8 as n_fields, created_utc * 1000000 as us from raw_reddit_submission
  union all
  select 'reddit', id, id, null, null, null, cast(created_utc as bigint), submission_id, 9, created_utc * 1000000 from raw_reddit_comment
  union all
  select 'bluesky', regexp_extract(uri, '([^/]*)$', 1), uri, text, handle, created_at, null, null, 8,
         epoch_us(try_cast(created_at as timestamptz)) from raw_bluesky_post
  union all
  select 'mastodon', cast(id as varchar), cast(id as varchar), content, acct, created_at, null, cast(in_reply_to_id as varchar), 12,
         epoch_us(try_cast(created_at as timestamptz)) from raw_mastodon_status)
select platform, object_id, raw_id, raw_text, raw_author, raw_time, raw_seconds, raw_parent, n_fields,
       {O.COLLECTED_AT_US} as collected_us,
       strftime(make_timestamp(coalesce(us, {O.COLLECTED_AT_US})), '%Y-%m-%dT%H:%M:%S') as created_iso
from r"""

_RAW_SCHEMA = """submission_id string, comment_id string, created_utc double, uri string,
record struct<text: string, created_at: string>, author struct<handle: string>, id string, content string, created_at string,
account struct<acct: string>, in_reply_to_id string"""


@register("stored_raw_data", _RAW_SQL)
def stored_raw_data(spark, sf_dir):
    """The raw payload kept with every post, the collection
    instant, and the ISO text of exports."""
    p = unified(spark, sf_dir)
    r = p.withColumn("r", F.from_json("raw_data", _RAW_SCHEMA))
    return r.select(
        "platform", "object_id",
        F.coalesce("r.comment_id", "r.submission_id", "r.uri", "r.id").alias("raw_id"),
        F.coalesce("r.record.text", "r.content").alias("raw_text"),
        F.coalesce("r.author.handle", "r.account.acct").alias("raw_author"),
        F.coalesce("r.record.created_at", "r.created_at").alias("raw_time"),
        F.col("r.created_utc").cast("bigint").alias("raw_seconds"),
        F.coalesce(F.when(F.col("is_comment"), F.col("r.submission_id")), F.col("r.in_reply_to_id")).alias("raw_parent"),
        F.size(F.json_object_keys("raw_data")).alias("n_fields"),
        F.unix_micros("collected_at").alias("collected_us"), X.iso_text("created_at").alias("created_iso"))


_FIELD_SQL = _RAW_SQL.split("select platform, object_id, raw_id")[0] + """
select platform, object_id, coalesce(raw_author, '') as author, coalesce(raw_text, '') as text, raw_seconds as seconds,
  coalesce(raw_parent, '') as parent from r"""


@register("raw_field_lookup", _FIELD_SQL)
def raw_field_lookup(spark, sf_dir):
    """Nested fields of the stored raw payload of all four payload
    kinds, read as VARIANT without a schema of the payloads."""
    p = unified(spark, sf_dir)
    first = lambda *paths: F.coalesce(*[N.raw_field(x) for x in paths], F.lit(""))
    parent = F.when(F.col("is_comment"), N.raw_field("$.submission_id"))
    return p.select(
        "platform", "object_id", first("$.author.handle", "$.account.acct").alias("author"),
        first("$.record.text", "$.content").alias("text"), N.raw_field("$.created_utc", "bigint").alias("seconds"),
        F.coalesce(parent, N.raw_field("$.in_reply_to_id"), F.lit("")).alias("parent"))


@register("record_roundtrip", f"{O.posts_cte()}\nselect * from posts")
def record_roundtrip(spark, sf_dir):
    """Posts as JSON records and back."""
    return flat_posts(N.from_record_json(N.to_record_json(unified(spark, sf_dir))))
