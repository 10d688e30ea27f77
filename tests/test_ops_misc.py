"""Smaller operators: feed items, quarantine split, metrics views, retry."""

import datetime as dt

import pytest

from postlake import schemas as S
from postlake.operators import normalize as N
from postlake.operators import quality as QA
from postlake.operators import stats as ST
from postlake.streaming import stream as STR


def test_feed_items_without_post_are_skipped(spark):
    post = ("at://did/app.bsky.feed.post/p1", None, ("hi", "2024-01-01T00:00:00Z", None),
            ("did", "h.bsky.app", None, None), 3, 1, 2, None, None)
    items = spark.createDataFrame([(post, 1), (None, 2)], S.BLUESKY_FEED_ITEM)
    out = N.bluesky_feed_items(items).collect()
    assert [r.object_id for r in out] == ["p1"]
    assert out[0].metrics["likes"] == 3 and out[0].metrics["reposts"] == 1   # read when present


def test_split_valid_quarantines_missing_fields(spark):
    rows = [("mastodon", "1", "a", "t", "2024-01-01T00:00:00Z", "m.example"),
            ("mastodon", "", "a", "t", "2024-01-01T00:00:00Z", "m.example"),
            ("mastodon", "3", "a", "t", "2024-01-01T00:00:00Z", None)]
    f = S.MASTODON_STATUS.fieldNames()

    def raw(r):
        d = {"id": r[1], "content": r[3], "created_at": r[4], "account": (r[2], None, None),
             "api_base_url": r[5], "seq": 1}
        return tuple(d.get(n) for n in f)
    posts = N.mastodon_status(spark.createDataFrame([raw(r) for r in rows], S.MASTODON_STATUS))
    valid, bad = QA.split_valid(posts)
    assert [r.object_id for r in valid.collect()] == ["1"]
    issues = {r.object_id: r.errors for r in bad.collect()}
    assert issues[""] == ["missing_object_id"] and issues["3"] == ["missing_instance"]


def test_metrics_views(spark):
    t = dt.datetime(2024, 1, 1)
    m = spark.createDataFrame([
        (0, "all", t, 10, 5, 1, 0, 2.0, "ok", None, {"reddit": (10, 5, 1, 0)}),
        (1, "all", t + dt.timedelta(seconds=5), 20, 2, 3, 1, 90.0, "error", "boom " * 20, {"reddit": (5, 1, 3, 1), "bluesky": (15, 1, 0, 0)}),
    ], STR.METRICS_SCHEMA)
    s = ST.latest_status(m).collect()[0]
    assert s.status == "error" and s.posts == 7 and s.incoming == 30
    tp = ST.throughput(m).collect()[0]
    assert tp.failures == 1 and tp.success_rate == 0.5
    assert [(r.batch_id, r.error) for r in STR.alerts(m, slow_s=60).collect()] == [(1, ("boom " * 20)[:30])]
    assert {r.platform: r.inserted for r in STR.totals_by_platform(m).collect()} == {"reddit": 5}
    live = {r.platform: r.incoming for r in STR.live_counters(m).collect()}
    assert live == {"reddit": 15, "bluesky": 15}


def test_run_with_retry_backs_off_then_succeeds(monkeypatch):
    calls = []

    class Q:
        def __init__(self, fail):
            self.fail = fail

        def awaitTermination(self):
            if self.fail:
                raise RuntimeError("source down")

    def start():
        calls.append(1)
        return Q(len(calls) < 3)
    monkeypatch.setattr(STR.time, "sleep", lambda s: None)
    assert isinstance(STR.run_with_retry(start, attempts=3, backoff_s=0.01), Q)
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(RuntimeError):
        STR.run_with_retry(lambda: (calls.append(1), Q(True))[1], attempts=2, backoff_s=0.01)


def test_record_json_round_trip(spark):
    from postlake.plans.common import unified
    from tests.conftest import SF_SMALL
    posts = unified(spark, SF_SMALL)
    back = N.from_record_json(N.to_record_json(posts))
    cols = [c for c in S.POST_COLUMNS if c != "metrics"]
    assert back.count() == posts.count()
    assert back.select(*cols).exceptAll(posts.select(*cols)).count() == 0
    one = N.to_record_json(posts).where("platform = 'reddit'").first().record
    assert '"views":null' in one or '"views": null' in one
