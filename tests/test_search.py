"""Selection operators: both term-match strategies agree; plans as intended."""

from pyspark.sql import functions as F

from postlake.functions import scalars as X
from postlake.operators import search as Q
from postlake.plans.common import unified
from tests.conftest import SF_SMALL


def _words(spark, n):
    p = unified(spark, SF_SMALL)
    w = p.select(F.explode(F.split(F.lower("text"), r"[^\\p{L}]+")).alias("w")) \
        .where(F.length("w") >= 3).groupBy("w").count().orderBy(F.desc("count"), "w").limit(n)
    return [r.w for r in w.collect()]


def test_long_term_list_equals_brute_force(spark, monkeypatch):
    posts = unified(spark, SF_SMALL).select("platform", "object_id", "title", "text")
    terms = _words(spark, 80) + ["The", "the and", "zzz", "ß", "é", "", "e", " ", "a b", "of t", ". ", "li", "\n"]
    hay = F.concat_ws("\\u0001", F.col("title"), F.col("text"))
    rows = posts.select("platform", "object_id", F.lower(hay).alias("hay")).collect()
    want = sorted((r.platform, r.object_id, t, i, r.hay.count(t.lower()))
                  for r in rows for i, t in enumerate(terms) if t and t.lower() in r.hay)
    for few in (len(terms), 5):                                # as literals, and as a gram join
        monkeypatch.setattr(Q, "DIRECT_TERMS", few)
        got = Q.substring_matches(spark, posts, terms, hay).select("platform", "object_id", "term", "term_pos", "hits")
        assert want and sorted(tuple(r) for r in got.collect()) == want


def test_keyword_search_plan(spark):
    spec = Q.KeywordSearch(("the", "license"), 20, "2024-01-08 00:00:00")
    plan = Q.keyword_search(spark, unified(spark, SF_SMALL), spec) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan and "WindowGroupLimit" in plan


def test_quota_never_zero():
    assert Q.quota(3, 10) == 1 and Q.quota(60, 3) == 20


def test_collect_spec_checks():
    import pytest
    from postlake.spec import CollectSpec, known_platforms
    ok = CollectSpec(as_of="2024-01-08 00:00:00")
    assert ok.check() is ok
    for bad in [dict(max_posts=0), dict(sort_by="best"), dict(time_filter="decade"),
                dict(subreddits=()), dict(instances=()), dict(keywords=("",))]:
        with pytest.raises(ValueError):
            CollectSpec(as_of="2024-01-08 00:00:00", **bad).check()
    # An unknown platform is skipped with a note (F13), in the spec as well.
    assert known_platforms(("reddit", "myspace")) == ("reddit",)
    CollectSpec(as_of="2024-01-08 00:00:00", platforms=("reddit", "myspace")).check()


def test_register_platform_adapter():
    from postlake import schemas as S
    from postlake.operators import normalize as N
    from postlake.spec import ADAPTERS, PlatformAdapter, register_platform
    register_platform(PlatformAdapter("bluesky_feed", S.BLUESKY_FEED_ITEM, N.bluesky_feed_items))
    assert ADAPTERS["bluesky_feed"].raw_schema is S.BLUESKY_FEED_ITEM


def test_skew_safe_plans(spark):
    from postlake.operators import upsert as U
    p = unified(spark, SF_SMALL)
    fp = U.canonical_by_fingerprint(U.fingerprints(p))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(us" in fp and "SortAggregate" not in fp   # combined map-side, in place, before the shuffle
    assert "WindowGroupLimit" in fp
    feed = Q.community_feed(p, ["all"], "hot", 5, "2024-01-08 00:00:00")
    plan = feed._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan


def test_core_plans_stay_in_the_jvm(spark):
    from postlake.operators import upsert as U
    p = unified(spark, SF_SMALL)
    spec = Q.KeywordSearch(("the", "license"), 20, "2024-01-08 00:00:00")
    frames = [p, Q.keyword_search(spark, p, spec),
              U.replay(p.select("platform", "object_id", "text", "seq", "is_comment"), "is_comment")]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "MapInPandas" not in plan and "PythonUDF" not in plan


def test_hits_are_counted_in_bytes(spark):
    """The characters of a text are not counted anew for each term."""
    rows = spark.createDataFrame([(1, "ababa é日é日é", "aba"), (2, "é日é日é", "é日é"), (3, "", "x"), (4, None, "x"), (5, "日日日", "日")],
                                 "id int, hay string, term string")
    got = rows.select("id", X.count_hits("hay", "term").alias("n"))
    assert {r.id: r.n for r in got.collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 3}
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "octet_length(" in plan and " length(" not in plan and "(length(" not in plan


def test_term_plans(spark):
    """Never a nested-loop join; a long list is an equi join on grams that stands below
    any exchange of the posts."""
    p = unified(spark, SF_SMALL).select("platform", "object_id", "title", "text")
    for n in (3, 300):
        m = Q.substring_matches(spark, p, [f"t{i}" for i in range(n)], F.concat_ws(" ", "title", "text"))
        full = m._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in full and "Cartesian" not in full and "EvalPython" not in full and "MapInPandas" not in full
        assert ("BroadcastHashJoin [_gram" in full) == (n > Q.DIRECT_TERMS)
        assert full.index("Generate explode") > 0


def test_term_blocks_and_odd_texts(spark, monkeypatch):
    """Terms in many blocks, of one byte to many, in texts of many alphabets."""
    import random
    draw = random.Random(3)
    texts = ["".join(draw.choice("abcäö漢😀 \n") for _ in range(draw.choice([0, 5, 70, 400]))) for _ in range(40)] + ["x" * 500 + "needle" + "y" * 500, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    terms = sorted({t[i:i + k] for t in texts if t for i in range(0, len(t) - 8, 31) for k in (1, 2, 3, 5, 8)}) + ["needle", "xn", "XNEE", "y" * 200]
    monkeypatch.setattr(Q, "BLOCK_TERMS", 100)
    want = [(i, j, t.lower().count(w.lower())) for i, t in enumerate(texts) if t for j, w in enumerate(terms) if w and w.lower() in t.lower()]
    for few in (60, 5):                                        # the short terms as literals, and all in the gram join
        monkeypatch.setattr(Q, "DIRECT_TERMS", few)
        got = Q.substring_matches(spark, rows, terms, F.col("text")).select("id", "term_pos", "hits").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_registered_platform_runs_and_unknown_is_skipped(spark):
    from postlake import schemas as S
    from postlake.operators import normalize as N
    from postlake.plans.common import raw_frames
    from postlake.spec import ADAPTERS, CollectSpec, PlatformAdapter, collect, register_platform
    from postlake.streaming import stream as ST
    raw = {"sky2": raw_frames(spark, SF_SMALL)["bluesky"]}
    register_platform(PlatformAdapter("sky2", S.BLUESKY_POST, N.bluesky_post))
    try:
        spec = CollectSpec(as_of="2024-01-29 00:00:00", platforms=("sky2", "nosuch"), max_posts=7)
        out = collect(spark, raw, spec)
        assert sorted(r["rank"] for r in out.collect()) == list(range(1, 8))
        assert ST.posts_stream(raw).count() == raw["sky2"].count()
    finally:
        del ADAPTERS["sky2"]


def test_continuous_collect_term_limit(spark):
    from postlake.plans.common import raw_frames
    from postlake.spec import CollectSpec, collect
    kws = ["the", "and", "de", "der", "la", "et", "of"]          # 7 keywords: first 5 used
    tags = ["topic0", "topic1", "topic2", "topic3", "topic4", "topic5"]
    spec = CollectSpec(as_of="2024-01-08 00:00:00", platforms=("reddit", "bluesky"),
                       subreddits=("all",), keywords=tuple(kws), hashtags=tuple(tags), continuous=True,
                       term_limit=5)
    out = collect(spark, raw_frames(spark, SF_SMALL), spec)
    rows = out.select("platform", "source", "rank").collect()
    blue = [r for r in rows if r.platform == "bluesky"]
    used_kw = {r.source.split(":", 1)[1] for r in blue if r.source.startswith("keyword:")}
    used_tag = {r.source.split(":", 1)[1].lstrip("#") for r in blue if r.source.startswith("hashtag:")}
    assert used_kw <= set(kws[:5]) and used_kw and used_tag <= set(tags[:5]) and used_tag
    assert max(r.rank for r in blue) <= 30
    reddit = [r for r in rows if r.platform == "reddit"]
    assert reddit and all(r.source.startswith("feed:") for r in reddit)   # Reddit ignores keywords
    assert max(r.rank for r in reddit) <= 50


def test_repeated_statuses_and_tags_count_once(spark):
    from postlake import schemas as S
    from postlake.sources import fixtures as FX
    raw = FX.raw_mastodon_status(spark, SF_SMALL).orderBy("seq").limit(1) \
        .withColumn("tags", F.expr("array(named_struct('name', 'A'), named_struct('name', 'a'))")).withColumn("seq", F.lit(7))
    later = raw.withColumn("seq", F.lit(9)).withColumn("content", F.lit("later"))
    rows = Q.mastodon_hashtag_search(spark, later.unionByName(raw), ["#a"], 10).collect()
    assert [(r.seq, r["rank"]) for r in rows] == [(7, 1)]
    assert set(f.name for f in S.MASTODON_STATUS.fields) <= set(rows[0].asDict())


def test_collection_scans_every_table_once(spark):
    from postlake.plans import q_collect
    plan = q_collect.collect_batch(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 4             # documents of three platforms, labels of one
