"""Normalizers on hand-written payload rows."""

import datetime as dt
import json

from postlake import schemas as S
from postlake.operators import normalize as N
from postlake.operators import quality as QA


def _rows(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_reddit_submission_rules(spark):
    rows = [
        {"id": "a1", "author": {"name": "alice", "id": "t2_x"}, "selftext": "", "title": "Title only",
         "created_utc": 1704067200.5, "subreddit": {"display_name": "python"}, "over_18": True,
         "permalink": "/r/python/comments/a1/", "ups": 5, "downs": 1, "score": 4, "num_comments": 2,
         "gilded": 0, "seq": 1},
        {"id": "a2", "author": None, "selftext": "Body", "title": "T", "created_utc": 1704067260.0,
         "subreddit": {"display_name": "python"}, "over_18": None, "permalink": "/r/python/comments/a2/",
         "ups": 1, "downs": 0, "score": 1, "num_comments": 0, "gilded": 1, "seq": 2},
    ]
    df = _rows(spark, S.REDDIT_SUBMISSION, [tuple(r.get(f.name) for f in S.REDDIT_SUBMISSION.fields) for r in rows])
    out = {r.object_id: r for r in N.reddit_submission(df).collect()}
    assert out["a1"].text == "Title only"          # E3: empty selftext -> title
    assert out["a2"].text == "Body"
    assert out["a2"].author_handle == "[deleted]"  # E4
    assert out["a1"].url == "https://reddit.com/r/python/comments/a1/"
    assert out["a1"].created_at == dt.datetime(2024, 1, 1, 0, 0, 0, 500000)  # UTC (D10)
    assert out["a1"].metrics["comments"] == 2 and out["a1"].metrics["upvotes"] == 5
    assert "views" in out["a1"].metrics and out["a1"].metrics["views"] is None
    assert out["a1"].is_nsfw is True and out["a2"].is_nsfw is False
    raw = json.loads(out["a1"].raw_data)
    assert raw["submission_id"] == "a1" and raw["author_id"] == "t2_x" and "edited" in raw
    assert out["a1"].tags is None


def test_bluesky_timestamps_and_flags(spark):
    def row(uri, text, created, seq):
        return (uri, None, (text, created, None), ("did:x", "h.bsky.app", "H", None), None, None, None, None, seq)
    df = spark.createDataFrame([
        row("at://did/app.bsky.feed.post/p1", "hi", "2024-01-05T13:15:00Z", 1),
        row("at://did/app.bsky.feed.post/p2", "bad", "not-a-date", 2),
        row("at://did/app.bsky.feed.post/p3", "none", None, 3),
        row("at://did/app.bsky.feed.post/p4", "offset", "2024-01-05T15:15:00+02:00", 4),
    ], S.BLUESKY_POST)
    out = {r.object_id: r for r in N.storage_form(N.bluesky_post(df, "2024-02-01 00:00:00")).collect()}
    assert out["p1"].created_at == dt.datetime(2024, 1, 5, 13, 15)
    assert out["p4"].created_at == dt.datetime(2024, 1, 5, 13, 15)       # offsets to UTC
    assert out["p2"].created_at == dt.datetime(2024, 2, 1) and out["p2"].created_at_fallback  # D11
    assert out["p3"].created_at_fallback
    assert out["p1"].url == "https://bsky.app/profile/h.bsky.app/post/p1"
    assert out["p1"].tags == [] and out["p1"].is_reply is False
    assert out["p1"].metrics["likes"] == 0 and out["p1"].metrics["reposts"] == 0
    issues = {r.object_id: r for r in QA.issues_report(N.bluesky_post(df)).collect()}
    assert set(issues) == {"p2", "p3"} and not issues["p2"].quarantined


def test_mastodon_presence_flags(spark):
    f = S.MASTODON_STATUS.fieldNames()

    def row(**kw):
        base = {"id": "1", "content": "<p>x</p>", "created_at": "2024-01-01T00:00:00+00:00",
                "account": ("u", "U", None), "tags": [("Py",)], "api_base_url": "https://m.example", "seq": 1}
        base.update(kw)
        return tuple(base.get(n) for n in f)
    df = spark.createDataFrame([
        row(id="1", in_reply_to_id="0"), row(id="2", in_reply_to_id=None, reblog=("9",)),
        row(id="3", in_reply_to_id="7", sensitive=True), row(id="4", in_reply_to_id=""),
    ], S.MASTODON_STATUS)
    out = {r.object_id: r for r in N.storage_form(N.mastodon_status(df)).collect()}
    assert not out["1"].is_reply and out["1"].reply_to is None      # 0 is falsy (E10)
    assert out["2"].is_reblog and out["2"].reblog_of == "9"
    assert out["3"].is_reply and out["3"].reply_to == "7" and out["3"].is_sensitive
    assert not out["4"].is_reply
    assert out["1"].instance == "m.example" and out["1"].text == "<p>x</p>"
    assert out["1"].tags is None  # read but not stored (N4, N6)
    assert set(out["1"].metrics) == {"favourites", "reblogs", "replies"}


def test_union_and_unique_keys(spark):
    from postlake.plans.common import unified
    from tests.conftest import SF_SMALL
    u = unified(spark, SF_SMALL)
    assert u.columns == S.POST_COLUMNS
    assert QA.duplicate_keys(u).count() == 0
