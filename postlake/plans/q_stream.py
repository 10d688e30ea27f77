"""Streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake import schemas as S
from postlake.plans import oracle as O
from postlake.plans.common import raw_frames
from postlake.plans.flat import flat_posts
from postlake.plans.q_upsert import _REPLAY_SQL, _STATES
from postlake.plans.registry import register
from postlake.session import PACKED_TEXT, configure, folders, make_folder, move, scratch_path
from postlake.sources import fixtures as FX
from postlake.sources.store import Store
from postlake.sources.tables import table
from postlake.streaming import progress as PG
from postlake.streaming import stream as ST
from postlake.streaming import supervise as SV

VERSION_SCHEMA = T.StructType([
    T.StructField("platform", T.StringType()), T.StructField("object_id", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

_RUNS: dict[tuple, tuple[str, str]] = {}

# Where the restart query breaks, by the ordinal of the day: before the snapshot is
# written, before it is published, and before the stream commits it.
FAULTS = {3: "write", 10: "publish", 17: "done"}


class Fault:
    """Raises once at each of the given steps of a store's batches."""

    def __init__(self, at: dict[int, str]):
        self.left = dict(at)

    def __call__(self, step: str, batch_id: int) -> None:
        if self.left.get(batch_id) == step:
            del self.left[batch_id]
            raise RuntimeError(f"fault at {step}")


def land(spark, rows, by: str, name: str) -> tuple[str, list[str]]:
    """Write ``rows`` in one job, a folder for each value of ``by``, outside the
    folder that a stream will watch; returns that folder and the names, in order.
    A landed folder is moved into it whole, so that a micro-batch never sees a part
    of it, and order does not depend on the times of files."""
    ready = scratch_path(spark, f"ready-{name}")
    rows.write.partitionBy(by).parquet(ready)
    landing = make_folder(spark, scratch_path(spark, f"landing-{name}"))
    return landing, [f"{ready}/{x}" for x in folders(spark, ready) if x.startswith(f"{by}=")]


def arrive(spark, landing: str, folder: str) -> None:
    move(spark, folder, f"{landing}/{folder.rsplit('/', 1)[1]}")


def run_version_stream(spark, sf_dir, faults: dict[int, str] | None = None):
    """Land post_versions day by day, and stream each day as one micro-batch into a
    store; with ``faults`` the query is broken there and restarted from its
    checkpoint.  Returns (store root, metrics path)."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir, str(faults))
    if key in _RUNS:
        return _RUNS[key]
    landing, days = land(spark, FX.post_versions(spark, sf_dir), "batch_day", "versions")
    store = _store(spark, scratch_path(spark, "store-versions"), Fault(faults or {}))
    schema = T.StructType(VERSION_SCHEMA.fields + [T.StructField("batch_day", T.DateType())])
    metrics, ckpt = scratch_path(spark, "metrics"), scratch_path(spark, "ckpt")
    running: list = []

    def start():
        if not running or not running[-1].isActive:
            src = ST.landed_stream(spark, landing, schema, fmt="parquet").select(*VERSION_SCHEMA.fieldNames())
            running.append(ST.start_upsert(src, store, ckpt, metrics, trigger={"processingTime": "0 seconds"}))
        return running[-1]

    try:
        for day in days:
            arrive(spark, landing, day)
            ST.run_with_retry(start, attempts=3, backoff_s=0.05, wait=lambda q: q.processAllAvailable())
    finally:
        for q in running:
            q.stop()
    _RUNS[key] = (store.root, metrics)
    return _RUNS[key]


def _store(spark, root, on_step=None):
    return Store(spark, root, VERSION_SCHEMA, replace=("text", "seq", "value"), replace_if_reddit=(), parts=4, on_step=on_step)


@register("stream_upsert", _REPLAY_SQL)
def stream_upsert(spark, sf_dir):
    root, _ = run_version_stream(spark, sf_dir)
    return _store(spark, root).read().select("platform", "object_id", "text", "seq", "value")


@register("stream_restart", _REPLAY_SQL)
def stream_restart(spark, sf_dir):
    """The same stream, broken at three places of a micro-batch and
    restarted from its checkpoint each time: nothing is lost or applied twice."""
    root, _ = run_version_stream(spark, sf_dir, FAULTS)
    return _store(spark, root).read().select("platform", "object_id", "text", "seq", "value")


_SBM_SQL = _STATES + """,
h as (select st.*, lag(st.text) over (partition by platform, object_id order by st.i) as prev_text from st),
pres as (select distinct platform, object_id, i from v),
inc as (select i, count(*) as n from v group by i)
select cast(dd.i - 1 as bigint) as batch_id,
       cast(inc.n as bigint) as incoming,
       cast(count(*) filter (where h.changed and h.prev_text is null) as bigint) as inserted,
       cast(count(*) filter (where h.changed and h.prev_text is not null) as bigint) as updated,
       cast(count(*) filter (where not h.changed and h.prev_text is not null
                             and pres.object_id is not null) as bigint) as unchanged
from dd join inc on inc.i = dd.i
left join h on h.i = dd.i
left join pres on pres.platform = h.platform and pres.object_id = h.object_id and pres.i = h.i
group by dd.i, inc.n"""


@register("stream_batch_metrics", _SBM_SQL)
def stream_batch_metrics(spark, sf_dir):
    """K9: one metrics row per micro-batch (durations left out: not
    deterministic)."""
    _, metrics = run_version_stream(spark, sf_dir)
    return ST.read_metrics(spark, metrics).select("batch_id", "incoming", "inserted", "updated", "unchanged")


_ALERTS_SQL = _SBM_SQL.replace("select cast(dd.i - 1 as bigint) as batch_id", """, f(batch_id, step) as (values """ + ", ".join(
    f"({i}, '{step}')" for i, step in FAULTS.items()) + """),
b as (select cast(dd.i - 1 as bigint) as batch_id""") + """)
select b.batch_id, 'all' as platform, 'error' as status, 'fault at ' || f.step as error, b.incoming as recovered_rows
from b join f on f.batch_id = b.batch_id"""


@register("alerts", _ALERTS_SQL)
def alerts(spark, sf_dir):
    """Failed attempts at micro-batches, with the rows that the batch
    brought when it was tried again (also if only its report was lost)."""
    _, metrics = run_version_stream(spark, sf_dir, FAULTS)
    m = ST.read_metrics(spark, metrics)
    again = m.where("status = 'ok'").select("batch_id", F.col("incoming").alias("recovered_rows"))
    return ST.alerts(m, slow_s=1e9).join(again, "batch_id", "left").select("batch_id", "platform", "status", "error", "recovered_rows")


_SD_SQL = """select distinct user_id, event_type, epoch_us(date_trunc('hour', ts)) as hour_us from events"""


@register("stream_dedup", _SD_SQL)
def stream_dedup(spark, sf_dir):
    """Replays of (user, event type, hour) dropped within a watermark, on the
    events table landed in the order of event time."""
    return run_dedup(spark, table(spark, sf_dir, "events"))[0]


DEDUP_DELAY, DEDUP_LANDINGS = "2 hours", 6


def run_dedup(spark, events, delay: str = DEDUP_DELAY, landings: int = DEDUP_LANDINGS, late=None):
    """(rows, progress table): days of events arrive in order, in ``landings`` steps
    (then ``late``, rows of any time).  An event is at most a day off the order of
    arrival inside a step, and steps do not overlap, so a delay of hours loses
    nothing, and state older than that is dropped."""
    configure(spark)
    ev = events.withColumn("ts", F.col("ts").cast("timestamp"))
    landing, days = land(spark, ev.withColumn("day", F.to_date("ts")), "day", "events")
    src = ST.landed_stream(spark, landing, T.StructType(ev.schema.fields + [T.StructField("day", T.DateType())]), "parquet")
    d = ST.dedup_within_watermark(src.withColumn("hour", F.date_trunc("hour", "ts")), "ts", delay, ["user_id", "event_type", "hour"])
    out = scratch_path(spark, "dedup-out")
    log = PG.ProgressLog(spark, scratch_path(spark, "progress"))
    with log:
        q = d.select("user_id", "event_type", F.unix_micros("hour").alias("hour_us")) \
            .writeStream.queryName("dedup").format("parquet").option("path", out) \
            .option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(processingTime="0 seconds").start()
        try:
            step = max(1, -(-len(days) // landings))
            for i in range(0, len(days), step):
                for day in days[i:i + step]:
                    arrive(spark, landing, day)
                q.processAllAvailable()
            if late is not None:
                rest, parts = land(spark, late.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.lit("9999-12-31").cast("date")), "day", "late")
                for x in parts:
                    arrive(spark, landing, x)
                q.processAllAvailable()
        finally:
            q.stop()
        log.settle(q)
    return spark.read.schema("user_id bigint, event_type string, hour_us bigint").parquet(out), log.table()


_FH_SQL = f"""with firehose_messages as ({O.FIX["firehose_messages"]}),
posts as (select * from firehose_messages where kind = 'commit' and collection = 'app.bsky.feed.post')
select """ + O.flat_select(
    platform="'bluesky'", object_id="regexp_extract(uri, '([^/]*)$', 1)", author_handle="handle",
    text="text", created_us="epoch_us(created_at)", tags="''",
    url="'https://bsky.app/profile/' || handle || '/post/' || regexp_extract(uri, '([^/]*)$', 1)",
    handle="handle", seq="seq", m_likes="0", m_shares="0", m_comments="0", m_upvotes="0",
    m_downvotes="0", m_reposts="0", m_replies="0") + "\nfrom posts"


@register("firehose_posts", _FH_SQL)
def firehose_posts(spark, sf_dir):
    configure(spark)
    return flat_posts(ST.firehose_posts(FX.firehose_messages(spark, sf_dir)))


@register("firehose_stream", _FH_SQL)
def firehose_stream(spark, sf_dir):
    """The same from a stream of ten landed files of many sizes, taken a
    few megabytes at a time."""
    return flat_posts(run_firehose(spark, sf_dir).posts(spark))


def run_firehose(spark, sf_dir, max_bytes: int = 4 << 20):
    """Ten folders of messages, the largest with ten times the smallest's share; a
    micro-batch takes files until it has ``max_bytes``."""
    configure(spark)
    m = FX.firehose_messages(spark, sf_dir)
    share = F.pmod(F.xxhash64("seq"), F.lit(55))
    slot = sum((share >= n * (n + 1) // 2).cast("int") for n in range(1, 10))
    path = scratch_path(spark, "landing-firehose")
    m.select(F.to_json(F.struct(*m.columns)).alias("value"), slot.alias("slot")).write.partitionBy("slot").text(path)
    sink = ST.FirehoseSink(scratch_path(spark, "firehose"))
    src = ST.landed_stream(spark, path, S.FIREHOSE_MESSAGE, max_bytes_per_trigger=max_bytes)
    ST.start_firehose(src, sink, scratch_path(spark, "ckpt"), {"availableNow": True}).awaitTermination()
    return sink


_FK_SQL = f"""with firehose_messages as ({O.FIX["firehose_messages"]}),
k as (select case when kind = 'commit' and collection = 'app.bsky.feed.post' then 'post'
                  when kind = 'commit' then 'other_commit' else 'other_message' end as kind from firehose_messages)
select kind, count(*) as n from k group by kind"""


@register("firehose_kinds", _FK_SQL)
def firehose_kinds(spark, sf_dir):
    """Messages by kind, counted while the stream is written."""
    sink = run_firehose(spark, sf_dir)
    kinds = ST.FirehoseSink.KINDS
    pairs = ", ".join(f"'{k}', {k}" for k in kinds)
    rows = sink.counts(spark).selectExpr(f"stack({len(kinds)}, {pairs}) as (kind, n)")
    return rows.groupBy("kind").agg(F.sum("n").alias("n")).where("n > 0")


_VALID = """object_id <> '' and author_handle <> '' and text is not null
  and (platform <> 'reddit' or (subreddit is not null and title is not null))
  and (platform not in ('bluesky', 'mastodon') or handle <> '')
  and (platform <> 'mastodon' or instance <> '')"""

RAW_SCHEMAS = {"reddit_submission": S.REDDIT_SUBMISSION, "reddit_comment": S.REDDIT_COMMENT,
               "bluesky": S.BLUESKY_POST, "mastodon": S.MASTODON_STATUS}


def land_payloads(spark, sf_dir) -> dict[str, str]:
    """Every platform's payloads as landed JSON lines: payload to folder."""
    paths = {}
    for name, raw in raw_frames(spark, sf_dir).items():
        paths[name] = scratch_path(spark, f"landing-{name}")
        raw.write.options(**PACKED_TEXT).json(paths[name])
    return paths


def run_posts_stream(spark, sf_dir):
    """Land every platform's payloads as JSON lines, stream them all into one
    store; returns (store, metrics path, progress table)."""
    configure(spark)
    streams = {name: ST.landed_stream(spark, path, RAW_SCHEMAS[name]) for name, path in land_payloads(spark, sf_dir).items()}
    store = Store(spark, scratch_path(spark, "store-posts"))
    metrics = scratch_path(spark, "metrics")
    log = PG.ProgressLog(spark, scratch_path(spark, "progress"))
    with log:
        q = ST.start_upsert(ST.posts_stream(streams), store, scratch_path(spark, "ckpt"), metrics,
                            trigger={"availableNow": True}, name="posts")
        q.awaitTermination()
        log.settle(q)
    return store, metrics, log.table()


_STATUS_SQL = f"""{O.posts_cte()}
select platform, 'ok' as status, count(distinct object_id) as posts, count(*) as incoming
from posts where {_VALID} group by platform"""


@register("stream_status", _STATUS_SQL)
def stream_status(spark, sf_dir):
    """Latest status and totals per platform of the streamed payloads
    of all platforms (the update time is left out: wall clock)."""
    _, metrics, _ = run_posts_stream(spark, sf_dir)
    return ST.platform_status(ST.read_metrics(spark, metrics)).select("platform", "status", "posts", "incoming")


@register("live_counters", f"""{O.posts_cte()}
select platform, count(*) as incoming, count(distinct object_id) as posts from posts where {_VALID} group by platform""")
def live_counters(spark, sf_dir):
    """Rows received and posts stored per platform so far."""
    _, metrics, _ = run_posts_stream(spark, sf_dir)
    return ST.live_counters(ST.read_metrics(spark, metrics)).select("platform", "incoming", "posts")


@register("throughput", """select 'posts' as query, cast(1 as bigint) as batches,
  (select 3 * count(*) from documents) + (select count(*) from conversations) as input_rows,
  cast(0 as bigint) as failures, cast(1 as double) as success_rate, true as measured""")
def throughput(spark, sf_dir):
    """What Spark's progress events say of the stream of all payloads (the rates
    themselves left out: wall clock)."""
    _, _, progress = run_posts_stream(spark, sf_dir)
    return PG.throughput(progress).select("query", "batches", "input_rows", "failures", "success_rate",
                                          ((F.col("rows_per_s") > 0) & (F.col("peak_rows_per_s") > 0)).alias("measured"))


BROKEN = "mastodon"
_ISOLATION_SQL = f"""{O.posts_cte()},
p as (select case platform when 'reddit' then case when is_comment then 'reddit_comment' else 'reddit_submission' end
             else platform end as source, object_id from posts where {_VALID})
select source, case when source = '{BROKEN}' then 'failed' else 'done' end as status,
  case when source = '{BROKEN}' then 3 else 1 end as attempts,
  case when source = '{BROKEN}' then 0 else count(distinct object_id) end as posts from p group by source"""


@register("source_isolation", _ISOLATION_SQL)
def source_isolation(spark, sf_dir):
    """Four sources under one supervisor, of which one is broken (its landed
    files are no Parquet files, as it claims): it is tried three times and given up,
    the others complete, and one writer merges what they staged."""
    configure(spark)
    starts, staged = {}, {}
    for name, path in land_payloads(spark, sf_dir).items():
        staged[name] = scratch_path(spark, f"staged-{name}")
        src = ST.landed_stream(spark, path, RAW_SCHEMAS[name], "parquet" if name == BROKEN else "json")
        starts[name] = lambda name=name, src=src, ckpt=scratch_path(spark, "ckpt"): SV.start_source(
            {name: src}, staged[name], ckpt, {"availableNow": True}, name=name)
    states = SV.Supervisor(spark, starts, attempts=3, backoff_s=0.1).run()
    store = Store(spark, scratch_path(spark, "store-isolated"))
    SV.start_merge(spark, list(staged.values()), store, scratch_path(spark, "ckpt"), trigger={"availableNow": True}).awaitTermination()
    source = F.when(F.col("platform") == "reddit", F.when(F.col("is_comment"), "reddit_comment").otherwise("reddit_submission")) \
        .otherwise(F.col("platform"))
    held = store.read().groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("posts"))
    told = spark.createDataFrame([(n, s.status, s.attempts) for n, s in states.items()], "source string, status string, attempts int")
    return told.join(held, "source", "left").select("source", "status", "attempts", F.coalesce("posts", F.lit(0)).alias("posts"))


_QUARANTINE_SQL = f"""{O.posts_cte(("mastodon",))},
w as (select *, seq % 11 = 0 as broken, seq % 7 = 0 as blank, seq % 13 = 0 or created_at_fallback as undated from posts)
select 'broken_line' as reason, count(*) as n from w where broken
union all select 'missing_object_id', count(*) from w where not broken and blank
union all select 'created_at_fallback', count(distinct object_id) from w where not broken and not blank and undated
union all select 'stored', count(distinct object_id) from w where not broken and not blank"""


@register("quarantine_report", _QUARANTINE_SQL)
def quarantine_report(spark, sf_dir):
    """Q1-Q3: what the streamed write does with faulty input.  All statuses are
    landed as JSON lines, of which every 11th is cut in half, every 7th has a
    blank id and every 13th a bare time instead of a date."""
    configure(spark)
    raw = FX.raw_mastodon_status(spark, sf_dir)
    faulty = raw.withColumn("id", F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("id"))) \
        .withColumn("created_at", F.when(F.col("seq") % 13 == 0, "12:30:00").otherwise(F.col("created_at")))
    line = F.to_json(F.struct(*[F.col(c) for c in raw.columns]))
    cut = F.when(F.col("seq") % 11 == 0, F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    path = scratch_path(spark, "landing-faulty")
    faulty.select(cut.alias("value")).write.text(path)
    store = Store(spark, scratch_path(spark, "store-faulty"))
    posts = ST.posts_stream({"mastodon": ST.landed_stream(spark, path, S.MASTODON_STATUS)})
    ST.start_upsert(posts, store, scratch_path(spark, "ckpt"), trigger={"availableNow": True}).awaitTermination()
    out = scratch_path(spark, "broken")
    ST.corrupt_stream(spark, path, S.MASTODON_STATUS).toDF("line").writeStream.format("parquet").option("path", out) \
        .option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    broken = spark.read.schema("line string").parquet(out).select(F.lit("broken_line").alias("reason"))
    kept_out = ST.read_quarantine(spark, store).select(F.explode("errors").alias("reason"))
    stored = store.read().select(F.explode(F.array_compact(F.array(
        F.lit("stored"), F.when(F.col("created_at_fallback"), F.lit("created_at_fallback"))))).alias("reason"))
    return broken.unionAll(kept_out).unionAll(stored).groupBy("reason").agg(F.count("*").alias("n"))
