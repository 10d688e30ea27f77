"""Spec-driven collection."""

from __future__ import annotations

from postlake import schemas as S
from postlake.operators import normalize as N
from postlake.operators import search as Q
from postlake.plans import oracle as O
from postlake.plans import params as P
from postlake.plans.common import raw_frames
from postlake.plans.q_search import _FEED_ORDERS, _terms_cte, _values
from postlake.plans.registry import register
from postlake.session import configure, scratch_path
from postlake.sources.store import Store
from postlake.spec import ADAPTERS, CollectSpec, PlatformAdapter, collect, register_platform
from postlake.streaming import stream as ST

BATCH_SPEC = CollectSpec(
    as_of=P.SEARCH_AS_OF, subreddits=tuple(P.SUBREDDITS), keywords=tuple(P.KEYWORDS),
    hashtags=("topic2", "#topic5"), instances=tuple(P.INSTANCES),
    max_posts_per_subreddit=60, max_posts=60, max_posts_per_instance=10)

CONT_SPEC = CollectSpec(
    as_of=P.AS_OF, subreddits=tuple(P.SUBREDDITS), instances=tuple(P.INSTANCES),
    sort_by="hot", continuous=True)

_asof = P.epoch_us(P.SEARCH_AS_OF)
_rq = Q.quota(BATCH_SPEC.max_posts_per_subreddit, len(P.KEYWORDS))
_bq = min(Q.quota(BATCH_SPEC.max_posts, len(P.KEYWORDS)), 30)
_mq = Q.quota(BATCH_SPEC.max_posts_per_instance, len(BATCH_SPEC.hashtags))
_insts = [Q.strip_scheme_text(i) for i in P.INSTANCES]

_BATCH_SQL = f"""{O.posts_cte(("reddit_submission", "bluesky"))},
raw_mastodon_status as ({O.FIX["raw_mastodon_status"]}),
{_terms_cte(P.KEYWORDS)},
tags(term_pos, term) as ({_values(list(enumerate(BATCH_SPEC.hashtags)))}),
cand as (select p.*, lower(concat_ws(chr(1), title, text)) as hay from posts p
         where (platform = 'reddit' and not is_comment and created_us <= {_asof}
                and created_us > {_asof - 7 * P.DAY_US}) or platform = 'bluesky'),
m as (select c.platform, c.object_id, c.created_us, t.term, t.term_pos,
             cast((length(c.hay) - length(replace(c.hay, lower(t.term), ''))) / length(lower(t.term)) as bigint) as hits
      from cand c join terms t on contains(c.hay, lower(t.term))),
r as (select *, row_number() over (partition by platform, term_pos
                                   order by hits desc, created_us desc, platform, object_id) as rank from m),
tk as (select term_pos, lower(regexp_replace(term, '^#+', '')) as tag from tags),
mm as (select distinct s.*, tk.term_pos, tk.tag as mtag,
              regexp_replace(s.api_base_url, 'https?://', '', 'g') as inst
       from raw_mastodon_status s join tk on lower(s.tag) = tk.tag),
mr as (select cast(id as varchar) as object_id, mtag, inst,
              row_number() over (partition by inst, term_pos
                                 order by try_cast(created_at as timestamptz) desc nulls last, cast(id as varchar)) as rank
       from mm where inst in ({", ".join("'" + i + "'" for i in _insts)}))
select platform, object_id, 'keyword:' || term as source, cast(rank as integer) as rank from r
where rank <= case when platform = 'bluesky' then {_bq} else {_rq} end
union all
select 'mastodon', object_id, 'hashtag:' || mtag || '@' || inst, cast(rank as integer) from mr where rank <= {_mq}"""


@register("collect_batch", _BATCH_SQL)
def collect_batch(spark, sf_dir):
    """Keywords drive Reddit and Bluesky search, hashtags Mastodon."""
    configure(spark)
    return collect(spark, raw_frames(spark, sf_dir), BATCH_SPEC).select(
        "platform", "object_id", "source", "rank")


_feed_asof = P.epoch_us(P.AS_OF)
_CONT_SQL = f"""{O.posts_cte(("reddit_submission", "bluesky"))},
raw_mastodon_status as ({O.FIX["raw_mastodon_status"]}),
subs(sub) as ({_values([(s,) for s in P.SUBREDDITS])}),
f as (select * from posts where platform = 'reddit' and not is_comment
      and subreddit in (select sub from subs) and created_us <= {_feed_asof}),
fr as (select platform, object_id, 'feed:' || subreddit as source,
              row_number() over (partition by subreddit order by {_FEED_ORDERS["hot"]}) as rank from f),
bt as (select platform, object_id, 'timeline' as source,
              row_number() over (order by seq, object_id) as rank from posts where platform = 'bluesky'),
ms as (select *, regexp_replace(api_base_url, 'https?://', '', 'g') as inst from raw_mastodon_status),
mt as (select 'mastodon' as platform, cast(id as varchar) as object_id, 'timeline@' || inst as source,
              row_number() over (partition by inst order by seq, cast(id as varchar)) as rank
       from ms where inst in ({", ".join("'" + i + "'" for i in _insts)}))
select platform, object_id, source, cast(rank as integer) as rank from fr where rank <= 50
union all select platform, object_id, source, cast(rank as integer) from bt where rank <= 30
union all select platform, object_id, source, cast(rank as integer) from mt where rank <= 15"""


@register("collect_continuous", _CONT_SQL)
def collect_continuous(spark, sf_dir):
    """Fixed batch sizes; no terms -> feeds and public timelines."""
    configure(spark)
    return collect(spark, raw_frames(spark, sf_dir), CONT_SPEC).select(
        "platform", "object_id", "source", "rank")


_UNKNOWN_SQL = f"""{O.posts_cte(("bluesky",))}
select 'bluesky' as platform, object_id, 'timeline:sky2' as source, cast(row_number() over (order by seq, object_id) as integer) as rank
from posts order by seq, object_id limit 40"""


@register("collect_registered_platform", _UNKNOWN_SQL)
def collect_registered_platform(spark, sf_dir):
    """A platform plugged in by name is collected, an unknown one of the
    same spec is skipped."""
    configure(spark)
    raw = {"sky2": raw_frames(spark, sf_dir)["bluesky"]}
    register_platform(PlatformAdapter("sky2", S.BLUESKY_POST, N.bluesky_post))
    try:
        spec = CollectSpec(as_of=P.AS_OF, platforms=("sky2", "nosuch"), max_posts=40)
        return collect(spark, raw, spec).select("platform", "object_id", "source", "rank")
    finally:
        del ADAPTERS["sky2"]


TERM_SPEC = CollectSpec(
    as_of=P.SEARCH_AS_OF, subreddits=tuple(P.SUBREDDITS), keywords=tuple(P.KEYWORDS),
    hashtags=("topic2", "#topic5"), instances=tuple(P.INSTANCES), continuous=True)
_cb = TERM_SPEC.continuous_batch
_mq = Q.quota(_cb["mastodon"], len(TERM_SPEC.hashtags))

_STREAM_SQL = f"""{O.posts_cte(("reddit_submission", "bluesky"))},
raw_mastodon_status as ({O.FIX["raw_mastodon_status"]}),
{_terms_cte(P.KEYWORDS)},
tk as (select term_pos, lower(regexp_replace(term, '^#+', '')) as tag
       from (values {", ".join(str(t) for t in enumerate(TERM_SPEC.hashtags))}) v(term_pos, term)),
subs(sub) as ({_values([(s,) for s in P.SUBREDDITS])}),
fr as (select platform, object_id, row_number() over (partition by subreddit order by {_FEED_ORDERS["hot"]}) as rank
       from posts where platform = 'reddit' and not is_comment
       and subreddit in (select sub from subs) and created_us <= {_asof}),
bh as (select *, lower(text) as hay from posts where platform = 'bluesky'),
bm as (select c.object_id, c.created_us, t.term_pos,
              (length(c.hay) - length(replace(c.hay, lower(t.term), ''))) // length(lower(t.term)) as hits
       from bh c join terms t on contains(c.hay, lower(t.term))),
bk as (select object_id, row_number() over (partition by term_pos order by hits desc, created_us desc, object_id) as rank from bm),
bt as (select b.object_id, row_number() over (partition by tk.term_pos order by b.created_us desc, b.object_id) as rank
       from bh b join tk on list_contains(regexp_extract_all(b.hay, '#(\\w+)', 1), tk.tag)),
mm as (select distinct s.*, tk.term_pos, regexp_replace(s.api_base_url, 'https?://', '', 'g') as inst
       from raw_mastodon_status s join tk on lower(s.tag) = tk.tag),
mr as (select cast(id as varchar) as object_id,
              row_number() over (partition by inst, term_pos order by try_cast(created_at as timestamptz) desc nulls last, cast(id as varchar)) as rank
       from mm where inst in ({", ".join("'" + i + "'" for i in _insts)}))
select platform, object_id from fr where rank <= {_cb["reddit"]}
union select 'bluesky', object_id from bk where rank <= {_cb["bluesky"]}
union select 'bluesky', object_id from bt where rank <= {_cb["bluesky"]}
union select 'mastodon', object_id from mr where rank <= {_mq}"""


@register("collect_stream", _STREAM_SQL)
def collect_stream(spark, sf_dir):
    """Continuous collection with terms, one cycle over everything that
    has landed: community feeds, keyword and hashtag searches, then the store."""
    configure(spark)
    paths = {}
    for name, raw in raw_frames(spark, sf_dir).items():
        paths[name] = scratch_path(spark, f"landing-{name}")
        raw.write.json(paths[name])
    store = Store(spark, scratch_path(spark, "store-collect"))
    ST.start_collect(ST.lines_stream(spark, paths), store, TERM_SPEC, scratch_path(spark, "ckpt"),
                     trigger={"availableNow": True}).awaitTermination()
    return store.read().select("platform", "object_id")
