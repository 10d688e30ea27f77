"""Selection operators.

The remote services of the reference did the matching, ranking and capping;
here they are DataFrame plans over landed posts:

* term match (J4) is a theta join of posts with the term table of a job spec,
  which the driver program holds as a list.  A long list is made an equi join on runs
  of three bytes (``substring_matches``), so that the cost does not grow with posts x
  terms; a short one is checked as literals.  Both are JVM plans without a shuffle of
  the posts and without a nested-loop join.
* per-group caps (L1) are ``row_number() <= n`` windows; Spark plans them as
  WindowGroupLimit, which keeps at most n rows per group in every map task
  before the shuffle, so a hot group never ships all its rows to one task.
* every ordering ends with (platform, object_id), so results are
  deterministic.

Ranking formulas (ours; the reference delegates ranking to the services):
relevance = hits desc, created_at desc; new = created_at desc;
top = score desc within the time filter;
hot = sign(score) * log10(max(|score|, 1)) + epoch / 43200;
rising = score / max(age in hours, 1).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlake.functions import scalars as X

# Time filters and their spans; sort orders accepted per source.
TIME_FILTERS = {"hour": "1 hour", "day": "1 day", "week": "7 days", "month": "30 days",
                "year": "365 days", "all": None}
REDDIT_SORTS = ("hot", "new", "top", "rising")
BLUESKY_TERM_CAP = 30


def quota(max_posts: int, n_terms: int) -> int:
    """L2: posts per term; never 0."""
    if n_terms <= 0:
        return max_posts
    return max(1, max_posts // n_terms)


def _ts(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, _dt.datetime):
        v = v.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(v).cast("timestamp")


def in_time_filter(ts_col: Column, as_of, time_filter: str) -> Column:
    """F8: (as_of - span, as_of]; ``all`` keeps everything up to as_of."""
    if time_filter not in TIME_FILTERS:
        raise ValueError(f"time_filter must be one of {sorted(TIME_FILTERS)}")
    end = _ts(as_of)
    span = TIME_FILTERS[time_filter]
    cond = ts_col <= end
    if span:
        cond = cond & (ts_col > end - F.expr(f"INTERVAL {span}"))
    return cond


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], n: int | None,
                    rank_col: str = "rank") -> DataFrame:
    """First ``n`` rows per group by ``order_cols`` with a 1-based rank.
    ``n=None`` ranks without capping."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    out = df.withColumn(rank_col, F.row_number().over(w))
    if n is not None:
        out = out.where(F.col(rank_col) <= n)
    return out


def terms_frame(spark: SparkSession, terms: list[str], kind: str = "keyword") -> DataFrame:
    """Small term table (term as given, match key).  Hashtags lose their
    ``#`` and are lower-cased (E8); keywords are lower-cased."""
    if kind not in ("keyword", "hashtag"):
        raise ValueError("kind must be keyword or hashtag")
    rows = [(i, t) for i, t in enumerate(terms)]
    df = spark.createDataFrame(rows, "term_pos int, term string")
    key = X.hashtag_bare("term") if kind == "hashtag" else F.lower("term")
    return df.withColumn("term_key", key)


#: Up to so many terms are checked one by one in each post.  Measured, the gram join
#: costs about as much as 120 rare terms, however many there are, and more if many
#: places hold a key.
DIRECT_TERMS = 256

#: Terms that one broadcast carries; a longer list takes one pass over the posts for
#: each such block, never a larger broadcast.
BLOCK_TERMS = 20_000
GRAM = 3  # bytes
COUNTED_SHARE = 0.05  # of the posts, for the counts that choose a term's gram


def _grams(rows: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """A row for each place (``_at``, a byte, from 1) of a text and each of ``sizes``:
    a hash of the run of that many bytes there (``_gram``).  Bytes, because a place in
    them is found at once; in UTF-8 a text contains another if its bytes do.  The runs
    are generated inside one codegen stage, no array of them is ever built."""
    least = min(sizes)
    bytes_ = rows.withColumn("_bytes", F.col(text).cast("binary")).where(F.octet_length("_bytes") >= least)
    at = bytes_.withColumn("_at", F.explode(F.sequence(F.lit(1), F.octet_length("_bytes") - (least - 1))))
    size = F.lit(sizes[0])
    if len(sizes) > 1:
        at = at.withColumn("_size", F.explode(F.array(*map(F.lit, sizes))))
        size = F.col("_size")
        at = at.where(F.col("_at") + size - 1 <= F.octet_length("_bytes"))
    return at.withColumn("_gram", F.xxhash64(F.substring(F.col("_bytes"), F.col("_at"), size))).drop("_size")


def keyed_terms(terms: DataFrame, hay: DataFrame) -> DataFrame:
    """``terms`` (with ``term_key``) with ``_term`` (its bytes), ``_gram`` and ``_off``:
    of the runs of three bytes in a term the one that is rarest in the posts (``hay``:
    their lower-cased text, column ``_hay``), and where it first stands in the term; a
    shorter term is its own.  Counts are grouped over a share of the posts, drawn by the
    hash of the text: they choose between grams that are all right."""
    own = terms.withColumn("_term", F.col("term_key").cast("binary"))
    size = F.least(F.octet_length("_term"), F.lit(GRAM))
    places = own.select("term_pos", "_term", size.alias("_size"), F.explode(
        F.sequence(F.lit(0), F.octet_length("_term") - size)).alias("_off"))
    grams = places.groupBy("term_pos", F.xxhash64(F.substring(F.col("_term"), F.col("_off") + 1, F.col("_size"))).alias("_gram")) \
        .agg(F.min("_off").alias("_off"))
    drawn = hay.where(F.pmod(F.xxhash64("_hay"), F.lit(1000)) < int(1000 * COUNTED_SHARE))
    met = _grams(drawn, "_hay", [GRAM]).join(F.broadcast(grams.select("_gram").distinct()), "_gram")
    counts = met.groupBy("_gram").agg(F.count(F.lit(1)).alias("_held"))
    best = grams.join(counts, "_gram", "left").groupBy("term_pos").agg(
        F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("held"), "_off", "_gram")).alias("b"))
    return own.join(best, "term_pos").select("term_pos", "term", "term_key", "_term", "b._off", "b._gram")


def _direct_matches(rows: DataFrame, terms: list[tuple[int, str]]) -> DataFrame:
    """The terms one by one, as literals of one expression."""
    named = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("term"), F.lower(F.lit(t)).alias("key"))
                      for i, t in terms])
    m = rows.withColumn("_t", F.explode(F.filter(named, lambda t: (t["key"] != "") & F.contains(F.col("_hay"), t["key"]))))
    return m.withColumns({"term_pos": F.col("_t.pos"), "term": F.col("_t.term"), "term_key": F.col("_t.key")}).drop("_t")


def _gram_matches(spark: SparkSession, rows: DataFrame, terms: list[tuple[int, str]]) -> DataFrame:
    """An inverted gram join: each term is keyed by its rarest gram, the places of the
    posts meet the keys in an equi join, the term's bytes are compared there, and only
    the first place of a term in a post counts, so a pair comes once.  The cost is that
    of the posts' bytes, plus the places where a key stands; a post is copied only where
    a term is found."""
    # Lower-casing never makes a text shorter.
    sizes = list(range(min(GRAM, *(len(t.encode()) for _, t in terms)), GRAM + 1))
    t = spark.createDataFrame(terms, "term_pos int, term string").withColumn("term_key", F.lower("term"))
    met = _grams(rows, "_hay", sizes).join(F.broadcast(keyed_terms(t, rows.select("_hay"))), "_gram")
    start = F.col("_at") - F.col("_off")
    here = (start >= 1) & (F.substring(F.col("_bytes"), start, F.octet_length("_term")) == F.col("_term"))
    first_at = F.octet_length(F.call_function("substring_index", F.col("_hay"), F.col("term_key"), F.lit(1))) + 1
    return met.where(F.when(here, start == first_at).otherwise(F.lit(False))).drop("_bytes", "_at", "_gram", "_off", "_term")


def substring_matches(spark: SparkSession, posts: DataFrame, terms: list[str],
                      hay: Column) -> DataFrame:
    """Posts x terms where the lower-case ``hay`` contains the term;
    adds ``term``, ``term_pos`` and ``hits`` (non-overlapping occurrences).
    A post matching two terms appears twice (U1).  Empty terms match nothing.

    A short list is checked term by term, a long one takes the gram join, in blocks
    of a bounded size that are broadcast (its terms of one or two bytes, which stand
    nearly everywhere, are checked one by one too, if they are few); either way the
    posts are not shuffled and there is no nested-loop join."""
    if not terms:
        raise ValueError("no terms")
    rows = posts.withColumn("_hay", F.lower(hay))
    named = [(i, t) for i, t in enumerate(terms) if t]
    short = [x for x in named if len(x[1].encode()) < GRAM]
    direct = named if len(named) <= DIRECT_TERMS else short if len(short) <= DIRECT_TERMS else []
    out = _direct_matches(rows, direct or [(0, "")])
    rest = [x for x in named if x not in set(direct)]
    for start in range(0, len(rest), BLOCK_TERMS):
        out = out.unionByName(_gram_matches(spark, rows, rest[start:start + BLOCK_TERMS]))
    return out.select(*posts.columns, "term_pos", "term", X.count_hits(F.col("_hay"), F.col("term_key")).alias("hits"))


def _hay_title_text() -> Column:
    # Title and text joined by a control character no term contains.
    return F.concat_ws("\u0001", F.col("title"), F.col("text"))


def relevance_order() -> list[Column]:
    return [F.col("hits").desc(), F.col("created_at").desc(), F.col("platform"), F.col("object_id")]


def new_order() -> list[Column]:
    return [F.col("created_at").desc(), F.col("platform"), F.col("object_id")]


def score_col() -> Column:
    return F.coalesce(F.try_element_at("metrics", F.lit("score")), F.lit(0))


def sort_order(sort_by: str, as_of=None) -> list[Column]:
    """Ordering expressions of a community feed."""
    s = score_col()
    if sort_by == "new":
        return new_order()
    if sort_by == "top":
        return [s.desc(), F.col("created_at").desc(), F.col("platform"), F.col("object_id")]
    if sort_by == "hot":
        hot = F.signum(s) * F.log10(F.greatest(F.abs(s), F.lit(1)).cast("double")) + \
            F.unix_seconds("created_at") / F.lit(43200.0)
        return [hot.desc(), F.col("platform"), F.col("object_id")]
    if sort_by == "rising":
        age_h = (F.unix_seconds(_ts(as_of)) - F.unix_seconds("created_at")) / F.lit(3600.0)
        rising = s / F.greatest(age_h, F.lit(1.0))
        return [rising.desc(), F.col("platform"), F.col("object_id")]
    raise ValueError(f"sort_by must be one of {REDDIT_SORTS}")


@dataclass(frozen=True)
class KeywordSearch:
    """S2/S5 parameters.  ``as_of`` replaces now()."""
    terms: tuple[str, ...]
    max_posts: int
    as_of: str
    reddit_time_filter: str = "week"
    bluesky_cap: int | None = BLUESKY_TERM_CAP

    def check(self) -> "KeywordSearch":
        if not self.terms:
            raise ValueError("terms must not be empty")
        if self.max_posts <= 0:
            raise ValueError("max_posts must be positive")
        if self.reddit_time_filter not in TIME_FILTERS:
            raise ValueError("bad time filter")
        return self


def keyword_search(spark: SparkSession, posts: DataFrame, spec: KeywordSearch, whole: bool = False) -> DataFrame:
    """S2 (Reddit: submissions, last ``reddit_time_filter``, relevance) and S5
    (Bluesky: quota, at most ``bluesky_cap`` per term), one plan: the term join runs once
    over both platforms and the cap is a per-(platform, term) window.
    ``whole`` keeps all columns of the posts."""
    spec.check()
    q = quota(spec.max_posts, len(spec.terms))
    reddit = (F.col("platform") == "reddit") & ~F.col("is_comment") & \
        in_time_filter(F.col("created_at"), spec.as_of, spec.reddit_time_filter)
    bsky = F.col("platform") == "bluesky"
    cand = posts.where(reddit | bsky)
    if not whole:
        cand = cand.select("platform", "object_id", "created_at", "title", "text")
    m = substring_matches(spark, cand, list(spec.terms), _hay_title_text())
    ranked = top_n_per_group(m, ["platform", "term_pos"], relevance_order(), max(q, 1))
    least = q if spec.bluesky_cap is None else min(q, spec.bluesky_cap)
    cap = F.when(F.col("platform") == "bluesky", F.lit(least)).otherwise(F.lit(q))
    return ranked.where(F.col("rank") <= cap)


def hashtag_search_posts(spark: SparkSession, posts: DataFrame, hashtags: list[str],
                         max_posts: int, cap: int | None = BLUESKY_TERM_CAP) -> DataFrame:
    """Bluesky hashtag search.  Terms get their ``#`` normalized (E8);
    a post matches when one of its text hashtags equals the term, case
    insensitive.  Equi join on the exploded tags, then newest first,
    the quota, at most ``cap``, per term (no cap: None)."""
    if not hashtags:
        raise ValueError("no hashtags")
    q = quota(max_posts, len(hashtags))
    q = q if cap is None else min(q, cap)
    tags = posts.where(F.col("platform") == "bluesky").select(
        "*", F.explode(X.hashtags_of("text")).alias("_tag"))
    t = terms_frame(spark, hashtags, "hashtag")
    t = t.withColumn("term", X.hashtag_with_prefix("term"))
    m = tags.join(F.broadcast(t), tags["_tag"] == t["term_key"]).drop("_tag", "term_key")
    return top_n_per_group(m, ["term_pos"], new_order(), q)


def mastodon_hashtag_search(spark: SparkSession, raw_status: DataFrame, hashtags: list[str],
                            max_posts: int, instances: list[str] | None = None) -> DataFrame:
    """S10/S13 on landed statuses: statuses whose payload tags contain the tag
    (case insensitive), newest first, ``quota`` per (instance, tag).  Returns
    the raw rows plus ``term``, ``term_pos``, ``instance_key`` and ``rank``."""
    if not hashtags:
        raise ValueError("no hashtags")
    q = quota(max_posts, len(hashtags))
    st = _with_instance(raw_status, instances)
    own_tags = F.array_distinct(F.transform(X.tag_names("tags"), lambda x: F.lower(x)))
    ex = st.select("*", F.explode(own_tags).alias("_tag"))
    t = terms_frame(spark, hashtags, "hashtag")
    m = ex.join(F.broadcast(t), ex["_tag"] == t["term_key"]).drop("_tag", "term_key")
    # A status that landed more than once counts once: its first copy.
    first = F.struct(F.coalesce(F.col("seq"), F.lit(-1)), F.xxhash64("content", "created_at"))
    m = m.groupBy("instance_key", "term_pos", "id").agg(F.min_by(F.struct(*m.columns), first).alias("_r")).select("_r.*")
    ts = F.coalesce(X.parse_iso_ts("created_at"), F.lit(None).cast("timestamp"))
    return top_n_per_group(m, ["instance_key", "term_pos"],
                           [ts.desc_nulls_last(), F.col("id")], q)


def _with_instance(raw_status: DataFrame, instances: list[str] | None) -> DataFrame:
    st = raw_status.withColumn("instance_key", X.strip_scheme(F.col("api_base_url")))
    if instances:
        keep = [strip_scheme_text(i) for i in instances]
        st = st.where(F.col("instance_key").isin(keep))
    return st


def strip_scheme_text(u: str) -> str:
    """E7 on a driver-side value (spec lists)."""
    import re
    return re.sub(r"https?://", "", u)


def unknown_instances(spark: SparkSession, raw_status: DataFrame, instances: list[str]) -> DataFrame:
    """F6 note: listed instances with no landed statuses (left anti)."""
    wanted = spark.createDataFrame([(strip_scheme_text(i),) for i in instances], "instance_key string")
    have = raw_status.select(X.strip_scheme(F.col("api_base_url")).alias("instance_key")).distinct()
    return wanted.join(have, "instance_key", "left_anti")


def instance_timeline(raw_status: DataFrame, instances: list[str] | None, max_posts: int) -> DataFrame:
    """The first ``max_posts`` statuses per instance in arrival order."""
    st = _with_instance(raw_status, instances)
    return top_n_per_group(st, ["instance_key"], [F.col("seq"), F.col("id")], max_posts)


def collect_from_instances(spark: SparkSession, raw_status: DataFrame, instances: list[str],
                           max_posts: int, hashtags: list[str] | None = None) -> DataFrame:
    """Hashtags given -> hashtag timelines with a quota per tag,
    otherwise the public timeline.  Both plans return the same columns."""
    if hashtags:
        out = mastodon_hashtag_search(spark, raw_status, hashtags, max_posts, instances)
    else:
        out = instance_timeline(raw_status, instances, max_posts) \
            .withColumn("term", F.lit(None).cast("string")) \
            .withColumn("term_pos", F.lit(None).cast("int"))
    return out


def community_feed(posts: DataFrame, subreddits: list[str], sort_by: str, max_posts: int,
                   as_of=None, time_filter: str = "all") -> DataFrame:
    """Reddit submissions of the listed communities, ranked
    per community by ``sort_by``, at most ``max_posts`` each.  ``time_filter``
    applies to ``top`` only; ``['all']`` means every community."""
    if sort_by not in REDDIT_SORTS:
        raise ValueError(f"sort_by must be one of {REDDIT_SORTS}")
    sub = posts.where((F.col("platform") == "reddit") & ~F.col("is_comment"))
    if subreddits and [s.lower() for s in subreddits] != ["all"]:
        sub = sub.where(F.col("subreddit").isin(list(subreddits)))
    if as_of is not None:
        sub = sub.where(in_time_filter(F.col("created_at"), as_of,
                                       time_filter if sort_by == "top" else "all"))
    return top_n_per_group(sub, ["subreddit"], sort_order(sort_by, as_of), max_posts)


def term_matrix(spark: SparkSession, posts: DataFrame, subreddits: list[str], keywords: list[str],
                max_posts: int, max_subreddits: int | None = None,
                max_keywords: int | None = None) -> DataFrame:
    """Communities x keywords, newest first, ``max_posts`` per pair;
    the first ``max_subreddits`` and ``max_keywords`` only, if given.  The pair table (the reference's nested loop
    over the two lists) meets the posts in an equi join on the community
    plus the substring condition."""
    # The pair table is built from the two spec lists on the driver.
    pair_rows = [(s, i, t) for s in subreddits[:max_subreddits]
                 for i, t in enumerate(keywords[:max_keywords]) if t]
    pairs = spark.createDataFrame(pair_rows, "pair_subreddit string, term_pos int, term string") \
        .withColumn("term_key", F.lower("term"))
    p = posts.where((F.col("platform") == "reddit") & ~F.col("is_comment")) \
        .withColumn("_hay", F.lower(_hay_title_text()))
    m = p.join(F.broadcast(pairs), (p["subreddit"] == pairs["pair_subreddit"]) &
               F.col("_hay").contains(F.col("term_key")))
    m = m.drop("_hay", "term_key", "pair_subreddit")
    return top_n_per_group(m, ["subreddit", "term_pos"], new_order(), max_posts)


def timeline(posts: DataFrame, platform: str, max_posts: int) -> DataFrame:
    """The first ``max_posts`` items in arrival order (a global top-k:
    TakeOrderedAndProject keeps k rows per task)."""
    return posts.where(F.col("platform") == platform).orderBy("seq", "object_id").limit(max_posts)


def author_feed(posts: DataFrame, platform: str, handles: list[str], max_posts: int) -> DataFrame:
    """Newest ``max_posts`` posts per listed author."""
    p = posts.where((F.col("platform") == platform) & F.col("author_handle").isin(list(handles)))
    return top_n_per_group(p, ["author_handle"], new_order(), max_posts)


def parse_account(handle: str) -> tuple[str, str]:
    """E15 on a driver-side value: ``@user@instance`` or ``user@instance``
    (D5: both forms)."""
    import re
    m = re.match(r"^@?([^@]+)@(.+)$", handle)
    if not m:
        raise ValueError(f"not a user@instance handle: {handle!r}")
    return m.group(1), strip_scheme_text(m.group(2))


def account_posts(spark: SparkSession, posts: DataFrame, handles: list[str], max_posts: int) -> DataFrame:
    """Statuses of ``user@instance`` accounts, newest first, per account."""
    acc = spark.createDataFrame([(h, *parse_account(h)) for h in handles],
                                "account string, acct string, acct_instance string")
    p = posts.where(F.col("platform") == "mastodon")
    m = p.join(F.broadcast(acc), (p["author_handle"] == acc["acct"]) &
               (p["instance"] == acc["acct_instance"])).drop("acct", "acct_instance")
    return top_n_per_group(m, ["account"], new_order(), max_posts)


def comments_of(raw_comments: DataFrame, submission_ids: list[str] | None, max_comments: int = 100) -> DataFrame:
    """Comments per submission in arrival order, first N each.
    ``submission_ids=None`` is the bulk form over every submission."""
    c = raw_comments
    if submission_ids is not None:
        c = c.where(F.col("submission.id").isin(list(submission_ids)))
    c = c.withColumn("submission_id", F.col("submission.id"))
    return top_n_per_group(c, ["submission_id"], [F.col("seq"), F.col("id")], max_comments)


def submissions_by(raw: DataFrame, flairs: list[str] | None = None, start: str | None = None,
                   end: str | None = None) -> DataFrame:
    """landed submissions with one of the flairs (compared without case),
    created in [start, end); a bound or list not given does not filter."""
    if flairs is not None:
        raw = raw.where(F.lower("link_flair_text").isin([f.lower() for f in flairs]))
    created = F.timestamp_seconds("created_utc")
    if start is not None:
        raw = raw.where(created >= F.lit(start).cast("timestamp"))
    if end is not None:
        raw = raw.where(created < F.lit(end).cast("timestamp"))
    return raw


def news_search(spark: SparkSession, items: DataFrame, keywords: list[str], domains: list[str] | None,
                start: str, end: str) -> DataFrame:
    """Landed news items whose title contains a keyword, from the
    listed domains (host equal or a subdomain), published in [start, end]."""
    it = items
    if domains:
        cond = None
        for d in domains:
            c = (F.col("host") == d) | F.col("host").endswith("." + d)
            cond = c if cond is None else cond | c
        it = it.where(cond)
    it = it.where(F.col("published").between(start, end))
    return substring_matches(spark, it, keywords, F.col("title")).drop("hits")
