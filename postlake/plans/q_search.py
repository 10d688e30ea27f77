"""Queries over selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.operators import normalize as N
from postlake.operators import search as Q
from postlake.plans import oracle as O
from postlake.plans import params as P
from postlake.plans.common import unified
from postlake.plans.registry import register
from postlake.session import configure
from postlake.sources import fixtures as FX


def _values(rows) -> str:
    def lit(v):
        return "null" if v is None else (str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'")
    return "values " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _terms_cte(terms) -> str:
    return f"terms(term_pos, term) as ({_values(list(enumerate(terms)))})"


# ---------------------------------------------------------------- keyword search
KW_MAX = 60
_kq = Q.quota(KW_MAX, len(P.KEYWORDS))
_asof = P.epoch_us(P.SEARCH_AS_OF)


def _keyword_sql(terms, q) -> str:
    return f"""{O.posts_cte()},
{_terms_cte(terms)},
cand as (select p.*, lower(concat_ws(chr(1), title, text)) as hay from posts p
         where (platform = 'reddit' and not is_comment and created_us <= {_asof}
                and created_us > {_asof - 7 * P.DAY_US}) or platform = 'bluesky'),
m as (select c.platform, c.object_id, c.created_us, t.term, t.term_pos,
             cast((length(c.hay) - length(replace(c.hay, lower(t.term), ''))) / length(lower(t.term)) as bigint) as hits
      from cand c join terms t on contains(c.hay, lower(t.term))),
r as (select *, row_number() over (partition by platform, term_pos
                                   order by hits desc, created_us desc, platform, object_id) as rank from m)
select platform, term, object_id, hits, cast(rank as integer) as rank from r
where rank <= case when platform = 'bluesky' then {min(q, 30)} else {q} end"""


_KW_SQL = _keyword_sql(P.KEYWORDS, _kq)


@register("keyword_search", _KW_SQL)
def keyword_search(spark, sf_dir):
    spec = Q.KeywordSearch(tuple(P.KEYWORDS), KW_MAX, P.SEARCH_AS_OF)
    r = Q.keyword_search(spark, unified(spark, sf_dir), spec)
    return r.select("platform", "term", "object_id", "hits", "rank")


KW_MANY_MAX = 300
_kmq = Q.quota(KW_MANY_MAX, len(P.MANY_KEYWORDS))


@register("keyword_search_many", _keyword_sql(P.MANY_KEYWORDS, _kmq))
def keyword_search_many(spark, sf_dir):
    spec = Q.KeywordSearch(tuple(P.MANY_KEYWORDS), KW_MANY_MAX, P.SEARCH_AS_OF)
    r = Q.keyword_search(spark, unified(spark, sf_dir), spec)
    return r.select("platform", "term", "object_id", "hits", "rank")


# A list long enough for the gram join.
KW_LONG_MAX = 5 * len(P.LONG_KEYWORDS)


@register("keyword_search_long", _keyword_sql(P.LONG_KEYWORDS, 5))
def keyword_search_long(spark, sf_dir):
    spec = Q.KeywordSearch(tuple(P.LONG_KEYWORDS), KW_LONG_MAX, P.SEARCH_AS_OF)
    r = Q.keyword_search(spark, unified(spark, sf_dir), spec)
    return r.select("platform", "term", "object_id", "hits", "rank")


_TERM_HITS_SQL = _KW_SQL.replace(
    "select platform, term, object_id, hits, cast(rank as integer) as rank from r",
    "select platform, term, count(*) as n from r").replace(
    f"where rank <= case when platform = 'bluesky' then {min(_kq, 30)} else {_kq} end",
    f"where rank <= case when platform = 'bluesky' then {min(_kq, 30)} else {_kq} end group by platform, term")


@register("term_hits", _TERM_HITS_SQL)
def term_hits(spark, sf_dir):
    """Hits per search term after the quota."""
    r = keyword_search(spark, sf_dir)
    return r.groupBy("platform", "term").agg(F.count(F.lit(1)).alias("n"))


# The quota of 100 is above Bluesky's cap of 30 a term (L3).
KW_CAPPED_MAX = 100 * len(P.KEYWORDS)


@register("keyword_search_capped", _keyword_sql(P.KEYWORDS, 100))
def keyword_search_capped(spark, sf_dir):
    spec = Q.KeywordSearch(tuple(P.KEYWORDS), KW_CAPPED_MAX, P.SEARCH_AS_OF)
    r = Q.keyword_search(spark, unified(spark, sf_dir), spec)
    return r.select("platform", "term", "object_id", "hits", "rank")


# ---------------------------------------------------------------- hashtag search
HT_MAX = 20
_hq = Q.quota(HT_MAX, len(P.HASHTAGS))

_HT_SQL = f"""{O.posts_cte(("bluesky",))},
raw_mastodon_status as ({O.FIX["raw_mastodon_status"]}),
{_terms_cte(P.HASHTAGS)},
tk as (select term_pos, lower(regexp_replace(term, '^#+', '')) as tag from terms),
bt as (select distinct platform, object_id, created_us,
              lower(unnest(regexp_extract_all(text, '#(\\w+)', 1))) as tag from posts),
bm as (select bt.*, tk.term_pos from bt join tk on bt.tag = tk.tag),
br as (select 'bluesky' as platform, tag, cast(null as varchar) as instance, object_id,
              row_number() over (partition by term_pos order by created_us desc, platform, object_id) as rank
       from bm),
mm as (select distinct s.*, tk.term_pos, tk.tag as mtag,
              regexp_replace(s.api_base_url, 'https?://', '', 'g') as inst
       from raw_mastodon_status s join tk on lower(s.tag) = tk.tag),
mr as (select 'mastodon' as platform, mtag as tag, inst as instance, cast(id as varchar) as object_id,
              row_number() over (partition by inst, term_pos
                                 order by try_cast(created_at as timestamptz) desc nulls last, cast(id as varchar)) as rank
       from mm)
select platform, tag, instance, object_id, cast(rank as integer) as rank from br where rank <= {min(_hq, 30)}
union all
select platform, tag, instance, object_id, cast(rank as integer) as rank from mr where rank <= {_hq}"""


@register("hashtag_search", _HT_SQL)
def hashtag_search(spark, sf_dir):
    configure(spark)
    b = Q.hashtag_search_posts(spark, unified(spark, sf_dir), P.HASHTAGS, HT_MAX)
    b = b.select("platform", F.regexp_replace(F.lower("term"), "^#+", "").alias("tag"),
                 F.lit(None).cast("string").alias("instance"), "object_id", "rank")
    m = Q.mastodon_hashtag_search(spark, FX.raw_mastodon_status(spark, sf_dir), P.HASHTAGS, HT_MAX)
    m = m.select(F.lit("mastodon").alias("platform"),
                 F.regexp_replace(F.lower("term"), "^#+", "").alias("tag"),
                 F.col("instance_key").alias("instance"), F.col("id").alias("object_id"), "rank")
    return b.unionByName(m)


_HX_SQL = f"""{O.posts_cte()}
select distinct platform, object_id, lower(unnest(regexp_extract_all(text, '#(\\w+)', 1))) as tag from posts"""


@register("hashtags_extracted", _HX_SQL)
def hashtags_extracted(spark, sf_dir):
    """Hashtags derived from the text, one row per (post, tag)."""
    from postlake.functions.scalars import hashtags_of
    p = unified(spark, sf_dir)
    return p.select("platform", "object_id", F.explode(hashtags_of("text")).alias("tag"))


# ---------------------------------------------------------------- term matrix
TM_MAX = 5
_TM_SQL = f"""{O.posts_cte(("reddit_submission",))},
subs(sub) as ({_values([(s,) for s in P.SUBREDDITS])}),
{_terms_cte(P.KEYWORDS)},
p as (select *, lower(concat_ws(chr(1), title, text)) as hay from posts where not is_comment),
m as (select p.subreddit, t.term, t.term_pos, p.object_id, p.created_us, p.platform
      from p join subs on p.subreddit = subs.sub join terms t on contains(p.hay, lower(t.term))),
r as (select *, row_number() over (partition by subreddit, term_pos order by created_us desc, platform, object_id) as rank from m)
select subreddit, term, object_id, cast(rank as integer) as rank from r where rank <= {TM_MAX}"""


@register("term_matrix", _TM_SQL)
def term_matrix(spark, sf_dir):
    r = Q.term_matrix(spark, unified(spark, sf_dir), P.SUBREDDITS, P.KEYWORDS, TM_MAX)
    return r.select("subreddit", "term", "object_id", "rank")


TM_FIRST = (2, 1)


@register("term_matrix_first", _TM_SQL.replace(_values([(s,) for s in P.SUBREDDITS]), _values([(s,) for s in P.SUBREDDITS[:TM_FIRST[0]]]))
          .replace(_terms_cte(P.KEYWORDS), _terms_cte(P.KEYWORDS[:TM_FIRST[1]])))
def term_matrix_first(spark, sf_dir):
    """L4: only the first communities and terms of the lists."""
    r = Q.term_matrix(spark, unified(spark, sf_dir), P.SUBREDDITS, P.KEYWORDS, TM_MAX, *TM_FIRST)
    return r.select("subreddit", "term", "object_id", "rank")


# ---------------------------------------------------------------- community feeds
FEED_MAX = 10
_feed_asof = P.epoch_us(P.AS_OF)
_SCORE = "coalesce(m_score, 0)"
_FEED_ORDERS = {
    "new": "created_us desc, platform, object_id",
    "top": f"{_SCORE} desc, created_us desc, platform, object_id",
    "hot": (f"sign({_SCORE}) * log10(greatest(abs({_SCORE}), 1)) + (created_us // 1000000) / 43200.0 desc,"
            " platform, object_id"),
    "rising": (f"{_SCORE} / greatest(({_feed_asof // 1000000} - created_us // 1000000) / 3600.0, 1.0) desc,"
               " platform, object_id"),
}


def _feed_sql(sort_by, window_us=None):
    lo = f" and created_us > {_feed_asof - window_us}" if window_us else ""
    return f"""{O.posts_cte(("reddit_submission",))},
subs(sub) as ({_values([(s,) for s in P.SUBREDDITS])}),
f as (select * from posts where not is_comment and subreddit in (select sub from subs)
      and created_us <= {_feed_asof}{lo}),
r as (select subreddit, object_id, row_number() over (partition by subreddit order by {_FEED_ORDERS[sort_by]}) as rank from f)
select subreddit, object_id, cast(rank as integer) as rank from r where rank <= {FEED_MAX}"""


def _feed(sort_by, time_filter="all"):
    def run(spark, sf_dir):
        r = Q.community_feed(unified(spark, sf_dir), P.SUBREDDITS, sort_by, FEED_MAX,
                             as_of=P.AS_OF, time_filter=time_filter)
        return r.select("subreddit", "object_id", "rank")
    return run


register("feed_new", _feed_sql("new"))(_feed("new"))
register("feed_top_week", _feed_sql("top", 7 * P.DAY_US))(_feed("top", "week"))
register("feed_hot", _feed_sql("hot"))(_feed("hot"))
register("feed_rising", _feed_sql("rising"))(_feed("rising"))


# ---------------------------------------------------------------- timelines
TL_MAX = 50
_TL_SQL = f"""{O.posts_cte(("bluesky",))}
select platform, object_id, seq from posts order by seq, object_id limit {TL_MAX}"""


@register("timeline_public", _TL_SQL)
def timeline_public(spark, sf_dir):
    return Q.timeline(unified(spark, sf_dir), "bluesky", TL_MAX).select("platform", "object_id", "seq")


_FI_SQL = f"""{O.posts_cte(("bluesky",))}
select platform, object_id, seq from posts where seq % 5 <> 0"""


@register("feed_items", _FI_SQL)
def feed_items(spark, sf_dir):
    """feed items of which every fifth has no post."""
    configure(spark)
    raw = FX.raw_bluesky_post(spark, sf_dir)
    post = F.struct(*[c for c in raw.columns if c != "seq"])
    items = raw.select(F.when(F.col("seq") % 5 != 0, post).alias("post"), "seq")
    return N.bluesky_feed_items(items).select("platform", "object_id", "seq")


IT_MAX = 15
_insts = [Q.strip_scheme_text(i) for i in P.INSTANCES]
_IT_SQL = f"""with raw_mastodon_status as ({O.FIX["raw_mastodon_status"]}),
s as (select *, regexp_replace(api_base_url, 'https?://', '', 'g') as instance from raw_mastodon_status),
r as (select instance, cast(id as varchar) as object_id,
             row_number() over (partition by instance order by seq, cast(id as varchar)) as rank
      from s where instance in ({", ".join("'" + i + "'" for i in _insts)}))
select instance, object_id, cast(rank as integer) as rank from r where rank <= {IT_MAX}"""


@register("instance_timeline", _IT_SQL)
def instance_timeline(spark, sf_dir):
    r = Q.collect_from_instances(spark, FX.raw_mastodon_status(spark, sf_dir), P.INSTANCES, IT_MAX)
    return r.select(F.col("instance_key").alias("instance"), F.col("id").alias("object_id"), "rank")


_UI_SQL = f"""with raw_mastodon_status as ({O.FIX["raw_mastodon_status"]}),
w(instance) as ({_values([(i,) for i in _insts])})
select instance from w where instance not in
  (select regexp_replace(api_base_url, 'https?://', '', 'g') from raw_mastodon_status)"""


@register("unknown_instances", _UI_SQL)
def unknown_instances(spark, sf_dir):
    """F6 note: listed instances without statuses."""
    r = Q.unknown_instances(spark, FX.raw_mastodon_status(spark, sf_dir), P.INSTANCES)
    return r.select(F.col("instance_key").alias("instance"))


# ---------------------------------------------------------------- authors / accounts
AF_MAX = 5
_AF_SQL = f"""{O.posts_cte(("bluesky",))},
r as (select author_handle, object_id,
             row_number() over (partition by author_handle order by created_us desc, platform, object_id) as rank
      from posts where author_handle in ({", ".join("'" + h + "'" for h in P.BSKY_AUTHORS)}))
select author_handle, object_id, cast(rank as integer) as rank from r where rank <= {AF_MAX}"""


@register("author_feed", _AF_SQL)
def author_feed(spark, sf_dir):
    r = Q.author_feed(unified(spark, sf_dir), "bluesky", P.BSKY_AUTHORS, AF_MAX)
    return r.select("author_handle", "object_id", "rank")


_accts = [(h, *Q.parse_account(h)) for h in P.MASTO_ACCOUNTS]
_AP_SQL = f"""{O.posts_cte(("mastodon",))},
acc(account, acct, inst) as ({_values(_accts)}),
r as (select acc.account, p.object_id,
             row_number() over (partition by acc.account order by p.created_us desc, p.platform, p.object_id) as rank
      from posts p join acc on p.author_handle = acc.acct and p.instance = acc.inst)
select account, object_id, cast(rank as integer) as rank from r where rank <= {AF_MAX}"""


@register("account_posts", _AP_SQL)
def account_posts(spark, sf_dir):
    r = Q.account_posts(spark, unified(spark, sf_dir), P.MASTO_ACCOUNTS, AF_MAX)
    return r.select("account", "object_id", "rank")


# ---------------------------------------------------------------- comments
CM_MAX = 3
_CM_SQL = f"""with raw_reddit_comment as ({O.FIX["raw_reddit_comment"]}),
r as (select submission_id, id as object_id,
             row_number() over (partition by submission_id order by seq, id) as rank from raw_reddit_comment)
select submission_id, object_id, cast(rank as integer) as rank from r where rank <= {CM_MAX}"""


@register("comments_of_post", _CM_SQL)
def comments_of_post(spark, sf_dir):
    configure(spark)
    r = Q.comments_of(FX.raw_reddit_comment(spark, sf_dir), None, CM_MAX)
    return r.select("submission_id", F.col("id").alias("object_id"), "rank")


# ---------------------------------------------------------------- news
_NW_SQL = f"""with news_items as ({O.FIX["news_items"]}),
{_terms_cte(P.NEWS_KEYWORDS)}
select n.page_id, t.term, n.host, n.published from news_items n join terms t
  on contains(lower(n.title), lower(t.term))
where ({" or ".join(f"n.host = '{d}' or n.host like '%.{d}'" for d in P.NEWS_DOMAINS)})
  and n.published between '{P.NEWS_WINDOW[0]}' and '{P.NEWS_WINDOW[1]}'"""


@register("news_domain_window", _NW_SQL)
def news_domain_window(spark, sf_dir):
    configure(spark)
    r = Q.news_search(spark, FX.news_items(spark, sf_dir), P.NEWS_KEYWORDS, P.NEWS_DOMAINS, *P.NEWS_WINDOW)
    return r.select("page_id", "term", "host", "published")


# ---------------------------------------------------------------- flair and date range
_FL_SQL = f"""with raw_reddit_submission as ({O.FIX["raw_reddit_submission"]})
select id as object_id, flair, cast(created_utc as bigint) as created_utc from raw_reddit_submission
where lower(flair) in ({", ".join("'" + f.lower() + "'" for f in P.FLAIRS)})
  and created_utc * 1000000 >= {P.epoch_us(P.FLAIR_WINDOW[0])} and created_utc * 1000000 < {P.epoch_us(P.FLAIR_WINDOW[1])}"""


@register("submissions_by_flair", _FL_SQL)
def submissions_by_flair(spark, sf_dir):
    configure(spark)
    r = Q.submissions_by(FX.raw_reddit_submission(spark, sf_dir), P.FLAIRS, *P.FLAIR_WINDOW)
    return r.select(F.col("id").alias("object_id"), F.col("link_flair_text").alias("flair"),
                    F.col("created_utc").cast("bigint").alias("created_utc"))
