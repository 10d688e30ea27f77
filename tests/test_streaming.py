"""Streaming equals batch."""

import pytest
from pyspark.sql import functions as F

from postlake import schemas as S
from postlake.operators import normalize as N
from postlake.operators.quality import split_valid
from postlake.plans.common import raw_frames
from postlake.session import scratch_path
from postlake.sources import fixtures as FX
from postlake.sources.store import Store
from postlake.streaming import progress as PG
from postlake.streaming import stream as ST
from postlake.streaming import supervise as SV
from tests.conftest import SF_SMALL

RAW_SCHEMAS = {"reddit_submission": S.REDDIT_SUBMISSION, "reddit_comment": S.REDDIT_COMMENT,
               "bluesky": S.BLUESKY_POST, "mastodon": S.MASTODON_STATUS}


def test_posts_stream_equals_batch(spark):
    raw = raw_frames(spark, SF_SMALL)
    streams = {}
    for p, df in raw.items():
        path = scratch_path(spark, f"land-{p}")
        df.repartition(3).write.json(path)           # three landed files per platform
        streams[p] = ST.landed_stream(spark, path, RAW_SCHEMAS[p], max_files_per_trigger=2)
    store = Store(spark, scratch_path(spark, "s-store"), parts=4)
    q = ST.start_upsert(ST.posts_stream(streams), store, scratch_path(spark, "ckpt"),
                        scratch_path(spark, "metrics"), trigger={"availableNow": True})
    q.awaitTermination()
    got = store.read()
    want, bad = split_valid(N.storage_form(N.all_fixture_posts(raw)))
    assert ST.read_quarantine(spark, store).count() == bad.count()
    cols = [c for c in S.POST_COLUMNS if c != "metrics"]
    assert got.count() == want.count()
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_firehose_stream(spark):
    path = scratch_path(spark, "land-firehose")
    FX.firehose_messages(spark, SF_SMALL).repartition(2).write.json(path)
    src = ST.landed_stream(spark, path, S.FIREHOSE_MESSAGE, max_files_per_trigger=1)
    out = scratch_path(spark, "fh-out")
    q = ST.firehose_posts(src).writeStream.format("parquet").option("path", out) \
        .option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ST.firehose_posts(FX.firehose_messages(spark, SF_SMALL))
    assert spark.read.parquet(out).count() == batch.count() > 0


def test_landed_and_staged_files_are_packed(spark):
    import glob
    from postlake.plans.q_stream import land_payloads
    from postlake.session import local_path
    paths = land_payloads(spark, SF_SMALL)
    for name, raw in raw_frames(spark, SF_SMALL).items():
        files = glob.glob(f"{local_path(paths[name])}/part-*")
        assert files and all(f.endswith(".json.gz") for f in files)
        assert spark.read.schema(RAW_SCHEMAS[name]).json(paths[name]).exceptAll(raw).count() == 0
    staged = scratch_path(spark, "staged")
    src = ST.landed_stream(spark, paths["bluesky"], RAW_SCHEMAS["bluesky"])
    SV.start_source({"bluesky": src}, staged, scratch_path(spark, "ckpt"), {"availableNow": True}).awaitTermination()
    files = glob.glob(f"{local_path(staged)}/part-*")
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert spark.read.parquet(staged).count() == raw_frames(spark, SF_SMALL)["bluesky"].count()


def test_dedup_within_watermark_batch_semantics(spark):
    df = spark.createDataFrame([("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:10:00"),
                                ("j", "2024-01-01 00:00:00")], "key string, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    assert ST.dedup_within_watermark(df, "ts", "1 hour", ["key"]).count() == 2


def test_landed_json_quarantines_corrupt_lines(spark):
    import os
    from postlake.session import local_path
    from postlake.sources.landed import read_landed
    path = scratch_path(spark, "land-bad")
    os.makedirs(local_path(path), exist_ok=True)
    with open(os.path.join(local_path(path), "part-0.json"), "w") as f:
        f.write('{"id": "1", "content": "ok", "seq": 1}\n')
        f.write('{"id": "2", "content": \n')
        f.write('{"id": "3", "content": "fine", "seq": 3}\n')
    good, bad = read_landed(spark, path, S.MASTODON_STATUS)
    assert sorted(r.id for r in good.collect()) == ["1", "3"]
    assert bad.count() == 1


def test_live_counters_per_platform(spark):
    raw = raw_frames(spark, SF_SMALL)
    streams = {}
    for p in ("bluesky", "mastodon"):
        path = scratch_path(spark, f"land-{p}")
        raw[p].repartition(2).write.json(path)
        streams[p] = ST.landed_stream(spark, path, RAW_SCHEMAS[p], max_files_per_trigger=1)
    store = Store(spark, scratch_path(spark, "lc-store"), parts=2)
    metrics = scratch_path(spark, "metrics")
    q = ST.start_upsert(ST.posts_stream(streams), store, scratch_path(spark, "ckpt"), metrics,
                        trigger={"availableNow": True})
    q.awaitTermination()
    got = {r.platform: r.incoming for r in ST.live_counters(ST.read_metrics(spark, metrics)).collect()}
    assert got["bluesky"] == raw["bluesky"].count() and got["mastodon"] == raw["mastodon"].count()
    assert got.get("reddit", 0) == 0


def test_replayed_micro_batch_changes_nothing(spark):
    """foreachBatch may run twice for one batch id after a failure."""
    raw = raw_frames(spark, SF_SMALL)
    posts = N.storage_form(N.bluesky_post(raw["bluesky"]))
    store = Store(spark, scratch_path(spark, "rp-store"), parts=2)
    metrics = scratch_path(spark, "metrics")
    sink = ST.UpsertSink(store, metrics)
    sink(posts, 0)
    edited = posts.limit(4).withColumn("text", F.lit("edited"))
    sink(edited, 1)
    before = (store.pointer()["batches"], sorted(tuple(r) for r in store.read().select("object_id", "text").collect()))
    sink(edited.withColumn("text", F.lit("other")), 1)          # replay of batch 1 with different data
    after = (store.pointer()["batches"], sorted(tuple(r) for r in store.read().select("object_id", "text").collect()))
    assert before == after
    m = ST.read_metrics(spark, metrics)
    assert sorted(r.batch_id for r in m.collect()) == [0, 1]


def test_new_checkpoint_is_a_new_source(spark):
    raw = raw_frames(spark, SF_SMALL)["bluesky"]
    store = Store(spark, scratch_path(spark, "nc-store"), parts=2)
    metrics = scratch_path(spark, "metrics")
    for part in (raw.where("seq % 2 = 0"), raw.where("seq % 2 = 1")):
        path = scratch_path(spark, "land-nc")
        part.write.json(path)
        src = ST.posts_stream({"bluesky": ST.landed_stream(spark, path, S.BLUESKY_POST)})
        ST.start_upsert(src, store, scratch_path(spark, "ckpt"), metrics, trigger={"availableNow": True}).awaitTermination()
    assert store.read().count() == raw.count()
    assert sum(r.incoming for r in ST.read_metrics(spark, metrics).collect()) == raw.count()


def test_stream_quarantines_broken_lines_and_blank_ids(spark):
    import os
    from postlake.session import local_path
    path = scratch_path(spark, "land-broken")
    os.makedirs(local_path(path), exist_ok=True)
    row = '{"id": %s, "content": "ok", "account": {"acct": "a"}, "created_at": "2024-01-01T00:00:00Z", ' \
          '"api_base_url": "https://m.example", "seq": 1}\n'
    with open(os.path.join(local_path(path), "part-0.json"), "w") as f:
        f.write(row % '"1"' + '{"id": "2", "content": \n' + "\n" + row % '""' + "no json\n")
    store = Store(spark, scratch_path(spark, "br-store"), parts=2)
    src = ST.posts_stream({"mastodon": ST.landed_stream(spark, path, S.MASTODON_STATUS)})
    ST.start_upsert(src, store, scratch_path(spark, "ckpt"), trigger={"availableNow": True}).awaitTermination()
    assert [r.object_id for r in store.read().collect()] == ["1"]
    assert [r.errors for r in ST.read_quarantine(spark, store).collect()] == [["missing_object_id"]]
    out = scratch_path(spark, "corrupt")
    ST.corrupt_stream(spark, path, S.MASTODON_STATUS).writeStream.format("parquet").option("path", out) \
        .option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["no json", '{"id": "2", "content": ']


def test_dedup_drops_old_state_and_counts_late_rows(spark):
    """A delay of two hours over thirty days: nothing is lost, state is dropped on the
    way, and rows that come too late are counted."""
    from postlake.plans.q_stream import run_dedup
    from postlake.sources.tables import table
    events = table(spark, SF_SMALL, "events")
    late = events.orderBy("ts").limit(7)
    got, progress = run_dedup(spark, events, late=late)
    want = events.select("user_id", "event_type", F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp")))).distinct()
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())
    seen = PG.late_rows(progress).first()
    assert seen.late_rows == 7
    assert seen.state_rows < seen.most_state_rows < want.count()
    assert PG.throughput(progress).first().input_rows == events.count() + 7


def test_collection_over_cycles(spark):
    """Each micro-batch is a cycle of its own; broken lines are kept apart."""
    import os
    from postlake.session import local_path
    from postlake.spec import CollectSpec
    path = scratch_path(spark, "land-cycles")
    os.makedirs(local_path(path), exist_ok=True)
    line = '{"uri": "at://x/app.bsky.feed.post/%s", "record": {"text": "%s", "created_at": "2024-01-0%dT00:00:00Z"}, ' \
           '"author": {"handle": "h"}, "seq": %d}\n'
    spec = CollectSpec(as_of="2024-02-01 00:00:00", platforms=("bluesky",), keywords=("spark",), hashtags=("tag",),
                       continuous=True, continuous_batch={"bluesky": 1})
    store = Store(spark, scratch_path(spark, "cy-store"), parts=2)
    ckpt = scratch_path(spark, "ckpt")
    cycles = ([("a", "spark one", 1), ("b", "spark two", 2), ("c", "nothing", 3)],
              [("d", "SPARK #tag", 4), ("a", "spark edited", 5), ("e", "a #Tag", 6)])
    for n, rows in enumerate(cycles):
        with open(os.path.join(local_path(path), f"part-{n}.json"), "w") as f:
            f.writelines(line % (i, text, day, day + 10 * n) for i, text, day in rows)
            f.write("{broken\n")
        ST.start_collect(ST.lines_stream(spark, {"bluesky": path}), store, spec, ckpt,
                         trigger={"availableNow": True}).awaitTermination()
    # One newest post per term and cycle: b, then a (keyword) and e (hashtag).
    assert {r.object_id: r.text for r in store.read().collect()} == {"b": "spark two", "a": "spark edited", "e": "a #Tag"}
    broken = spark.read.schema("line string, payload string").parquet(f"{store.root}/_broken_lines")
    assert [(r.payload, r.line) for r in broken.collect()] == [("bluesky", "{broken")] * 2


def test_status_and_totals_per_platform(spark):
    raw = raw_frames(spark, SF_SMALL)
    streams = {}
    for p in ("bluesky", "mastodon"):
        path = scratch_path(spark, f"land-{p}")
        raw[p].write.json(path)
        streams[p] = ST.landed_stream(spark, path, RAW_SCHEMAS[p])
    store = Store(spark, scratch_path(spark, "st-store"), parts=2)
    metrics = scratch_path(spark, "metrics")
    q = ST.start_upsert(ST.posts_stream(streams), store, scratch_path(spark, "ckpt"), metrics, trigger={"availableNow": True})
    q.awaitTermination()
    totals = {r.platform: (r.incoming, r.inserted) for r in ST.stop_and_report(q, metrics).collect()}
    n = {p: raw[p].count() for p in streams}
    assert totals == {p: (n[p], n[p]) for p in streams}
    got = {r.platform: (r.status, r.incoming, r.posts) for r in ST.platform_status(ST.read_metrics(spark, metrics)).collect()}
    assert got == {p: ("ok", n[p], n[p]) for p in streams}


def test_a_lost_report_is_made_up_for(spark):
    """The store has published, but the micro-batch failed before its row was written."""
    from postlake.plans.q_stream import Fault
    posts = N.storage_form(N.bluesky_post(raw_frames(spark, SF_SMALL)["bluesky"]))
    store = Store(spark, scratch_path(spark, "lr-store"), parts=2, on_step=Fault({0: "done"}))
    metrics = scratch_path(spark, "metrics")
    sink = ST.UpsertSink(store, metrics)
    with pytest.raises(RuntimeError):
        sink(posts, 0)
    sink(posts, 0)
    rows = {r.status: r for r in ST.read_metrics(spark, metrics).collect()}
    assert set(rows) == {"ok", "error"} and rows["error"].error == "fault at done"
    assert rows["ok"].inserted == store.read().count() == ST.totals_by_platform(ST.read_metrics(spark, metrics)).first().inserted
    assert ST.alerts(ST.read_metrics(spark, metrics)).count() == 1


def test_micro_batch_is_parsed_once(spark):
    """Rows read by the source are counted once, however often the sink uses them."""
    raw = raw_frames(spark, SF_SMALL)["mastodon"]
    path = scratch_path(spark, "land-once")
    raw.write.json(path)
    store = Store(spark, scratch_path(spark, "po-store"), parts=2)
    log = PG.ProgressLog(spark, scratch_path(spark, "progress"))
    with log:
        q = ST.start_upsert(ST.posts_stream({"mastodon": ST.landed_stream(spark, path, S.MASTODON_STATUS)}), store,
                            scratch_path(spark, "ckpt"), trigger={"availableNow": True}, name="once")
        q.awaitTermination()
        log.settle(q)
    row = PG.throughput(log.table()).first()
    assert (row.input_rows, row.failures, row.success_rate) == (raw.count(), 0, 1.0) and row.rows_per_s > 0
    assert PG.source_counters(log.table()).first().input_rows == raw.count()


def test_supervisor_gives_up_only_the_broken_source(spark):
    good, bad = scratch_path(spark, "sv-good"), scratch_path(spark, "sv-bad")
    raw = raw_frames(spark, SF_SMALL)["mastodon"]
    raw.repartition(2).write.json(good)
    raw.write.json(bad)
    out = {n: scratch_path(spark, f"sv-out-{n}") for n in ("a", "b", "c")}
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return SV.start_source({"mastodon": ST.landed_stream(spark, good, S.MASTODON_STATUS)}, out["c"], scratch_path(spark, "ckpt"), {"availableNow": True})

    starts = {
        "a": lambda: SV.start_source({"mastodon": ST.landed_stream(spark, good, S.MASTODON_STATUS)}, out["a"], scratch_path(spark, "ckpt"), {"availableNow": True}),
        "b": lambda: SV.start_source({"mastodon": ST.landed_stream(spark, bad, S.MASTODON_STATUS, "parquet")}, out["b"], scratch_path(spark, "ckpt"), {"availableNow": True}),
        "c": flaky}
    states = SV.Supervisor(spark, starts, attempts=3, backoff_s=0.05).run()
    assert {n: (s.status, s.attempts) for n, s in states.items()} == {"a": ("done", 1), "b": ("failed", 3), "c": ("done", 3)}
    assert "Parquet" in states["b"].error or "FAILED_READ_FILE" in states["b"].error
    assert spark.read.parquet(out["a"]).count() == spark.read.parquet(out["c"]).count() == raw.count()


def test_firehose_by_bytes(spark):
    from postlake.plans.q_stream import run_firehose
    sink = run_firehose(spark, SF_SMALL, max_bytes=40_000)
    counts = sink.counts(spark)
    assert counts.count() > 1                                   # several micro-batches
    assert sink.posts(spark).count() == counts.agg(F.sum("post")).first()[0] == ST.firehose_posts(FX.firehose_messages(spark, SF_SMALL)).count()
    first = counts.orderBy("batch_id").first()
    assert first.batch_id == 0
