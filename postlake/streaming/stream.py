"""Streaming jobs over landed payload files.

The reference runs one endless loop per platform, hands batches to a single
writer through a queue, and de-duplicates against its database.  Here:

* each platform is a file source (``readStream`` with an explicit schema,
  ``maxFilesPerTrigger`` bounds a micro-batch, T7);
* the normalizers are plain projections, so the same code serves batch and
  stream; the platform streams are unioned into one query (T2), whose
  ``foreachBatch`` applies the keyed upsert to the store (T5) -- one writer
  per store keeps it consistent;
* the checkpoint makes the query resumable (T9); the store skips a batch id
  that the same query has already applied, so a replayed micro-batch changes nothing;
* every micro-batch is evaluated once: what is used more than once is staged;
* every attempt at a micro-batch leaves one metrics row (K9), the source of live
  counters, totals and alerts (A6, T11, T12); Spark's own progress events become
  rows too (``streaming.progress``: rates, T8, A8);
* bounded de-duplication of replays for append-only outputs uses a
  watermark (T6).
"""

from __future__ import annotations

import json
import logging
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postlake import schemas as S
from postlake.functions import scalars as X
from postlake.operators import normalize as N
from postlake.operators.upsert import first_copies
from postlake.session import delete, exists, read_text, scratch_path, write_text
from postlake.sources.landed import parse_lines, parse_payloads, split_corrupt
from postlake.sources.store import COUNTS, Store
from postlake.spec import ADAPTERS, CollectSpec, collect

log = logging.getLogger(__name__)

# The reference's pauses between cycles (normal, after an error).
PAUSE_S, ERROR_PAUSE_S = 5, 10

METRICS_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("platform", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("incoming", T.LongType()),
    T.StructField("inserted", T.LongType()), T.StructField("updated", T.LongType()),
    T.StructField("unchanged", T.LongType()), T.StructField("duration_s", T.DoubleType()),
    T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("by_platform", T.MapType(T.StringType(), T.StructType(
        [T.StructField(c, T.LongType()) for c in COUNTS]))),
])


def landed_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                  max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | None = None) -> DataFrame:
    """T1 source: landed payload files, explicit schema; a micro-batch is bounded in
    files or in bytes (L7), not both.  Of JSON the lines that parse;
    ``corrupt_stream`` has the others (Q3)."""
    if fmt == "json":
        return split_corrupt(_lines(spark, path, schema, max_files_per_trigger, max_bytes_per_trigger))[0]
    return _bounded(spark.readStream.schema(schema).format(fmt), max_files_per_trigger, max_bytes_per_trigger).load(path)


def _bounded(reader, max_files: int | None, max_bytes: int | None):
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader


def corrupt_stream(spark: SparkSession, path: str, schema: T.StructType,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Q3: the raw text of the landed JSON lines that do not parse, as a stream
    to be written to a quarantine folder."""
    return split_corrupt(_lines(spark, path, schema, max_files_per_trigger))[1]


def _lines(spark, path, schema, max_files=None, max_bytes=None) -> DataFrame:
    return parse_lines(_bounded(spark.readStream.schema("value string").format("text"), max_files, max_bytes).load(path), schema)


def posts_stream(raw_streams: dict[str, DataFrame], collected_at=None) -> DataFrame:
    """Normalize each platform's stream by its registered adapter (X1) and
    union them into one."""
    parts = [ADAPTERS[p].normalizer(df, collected_at) for p, df in raw_streams.items()]
    return N.union_posts(*parts)


def firehose_posts(messages: DataFrame, collected_at=None) -> DataFrame:
    """Firehose envelopes to posts (batch or stream)."""
    return N.bluesky_post(N.firehose_to_post_view(messages), collected_at)


def read_quarantine(spark: SparkSession, store: Store) -> DataFrame:
    """Posts that streams kept out of the store, with ``errors``, ``warnings``
    and the ``batch`` that brought them."""
    schema = T.StructType(S.POST.fields + [
        T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("batch", T.StringType())])
    path = store.quarantine_path()
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


class UpsertSink:
    """``foreachBatch`` body: posts without a required field go to the store's
    quarantine folder (Q1, Q2), the others are upserted, then one metrics row.
    A store of another schema than that of posts takes every row."""

    def __init__(self, store: Store, metrics_path: str | None = None, platform_label: str = "all",
                 checkpoint: str | None = None):
        self.store = store
        self.checkpoint = checkpoint
        self.source: str | None = None
        self.metrics_path = metrics_path
        self.platform_label = platform_label

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        t0 = time.time()
        spark = df.sparkSession
        try:
            source = self._source(spark)
            write = self.store.ingest if self.store.schema == S.POST else self.store.upsert
            res = write(df, int(batch_id), source)
        except Exception as e:  # noqa: BLE001 -- recorded, then re-raised
            log.exception("micro-batch %s failed", batch_id)
            self._record(spark, batch_id, t0, {}, "error", str(e))
            raise
        # A replayed micro-batch was applied before, but its row may not have been
        # written: the store knows the counts of the last one.
        if not res["skipped"] or res["by_platform"]:
            self._record(spark, batch_id, t0, res, "ok", None)

    def _source(self, spark) -> str:
        """The query's id, which its checkpoint keeps: batch ids start anew
        with a new checkpoint, and must not be taken for old ones."""
        if self.source is None:
            text = read_text(spark, f"{self.checkpoint}/metadata") if self.checkpoint else None
            self.source = json.loads(text)["id"] if text else ""
        return self.source

    def _record(self, spark, batch_id, t0, res, status, err):
        """One JSON line per attempt, written through the Hadoop FS API (a few
        hundred bytes: no Spark job).  A successful attempt's file carries the batch
        id, so a re-run overwrites instead of duplicating; a failed one's also the
        time."""
        if not self.metrics_path:
            return
        now = time.time()
        row = {"batch_id": int(batch_id), "platform": self.platform_label,
               "ts": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(now)) + f".{int(now * 1000) % 1000:03d}Z",
               **{c: res.get(c, 0 if c == "incoming" else None) for c in COUNTS},
               "duration_s": float(now - t0), "status": status, "error": err, "by_platform": res.get("by_platform")}
        failed = f"failed-{int(now * 1000)}" if status != "ok" else None
        name = "-".join(filter(None, ("batch", self.source, f"{int(batch_id):010d}", failed)))
        write_text(spark, f"{self.metrics_path}/{name}.json", json.dumps(row))


def start_upsert(stream: DataFrame, store: Store, checkpoint: str, metrics_path: str | None = None,
                 trigger: dict | None = None, name: str | None = None) -> StreamingQuery:
    """One query, ``foreachBatch`` upsert, checkpointed.
    ``trigger`` e.g. ``{"processingTime": "5 seconds"}`` (the reference's
    pause) or ``{"availableNow": True}`` for bounded runs."""
    store.create()
    w = stream.writeStream.foreachBatch(UpsertSink(store, metrics_path, checkpoint=checkpoint)) \
        .option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    w = w.trigger(**(trigger or {"processingTime": f"{PAUSE_S} seconds"}))
    return w.start()


class FirehoseSink:
    """``foreachBatch`` body of a firehose of mixed messages.  A micro-batch
    is written once, split into posts and the rest, to a folder of its own that a
    re-run overwrites; its messages are counted by kind during the write."""

    KINDS = ("post", "other_commit", "other_message")

    def __init__(self, folder: str, collected_at=None):
        self.folder, self.collected_at = folder, collected_at

    def __call__(self, messages: DataFrame, batch_id: int) -> None:
        commit = F.coalesce(F.col("kind") == "commit", F.lit(False))
        post = commit & F.coalesce(F.col("commit.collection") == N.POST_COLLECTION, F.lit(False))
        named = F.when(post, "post").when(commit, "other_commit").otherwise("other_message")
        seen = Observation(f"firehose-{uuid.uuid4().hex[:8]}")
        sorted_out = messages.withColumn("sort", named)
        (sorted_out.observe(seen, *[F.count_if(F.col("sort") == k).alias(k) for k in self.KINDS])
         .write.mode("overwrite").partitionBy("sort").parquet(f"{self.folder}/messages/batch={int(batch_id):010d}"))
        got = seen.get
        row = {"batch_id": int(batch_id), **{k: int(got.get(k) or 0) for k in self.KINDS}}
        write_text(messages.sparkSession, f"{self.folder}/counts/{int(batch_id):010d}.json", json.dumps(row))

    def posts(self, spark: SparkSession) -> DataFrame:
        """The posts of all micro-batches; only their folders are read."""
        schema = T.StructType(S.FIREHOSE_MESSAGE.fields + [T.StructField("batch", T.StringType()), T.StructField("sort", T.StringType())])
        rows = spark.read.schema(schema).parquet(f"{self.folder}/messages").where("sort = 'post'").drop("batch", "sort")
        return firehose_posts(rows, self.collected_at)

    def counts(self, spark: SparkSession) -> DataFrame:
        """Messages by kind, a row for each micro-batch."""
        return spark.read.schema("batch_id bigint, " + ", ".join(f"{k} bigint" for k in self.KINDS)).json(f"{self.folder}/counts")


def start_firehose(messages: DataFrame, sink: FirehoseSink, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Sort a stream of firehose messages (see ``landed_stream``: its limits
    bound a micro-batch in files or bytes) into the folder of ``sink``."""
    return messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"processingTime": f"{PAUSE_S} seconds"})).start()


def lines_stream(spark: SparkSession, paths: dict[str, str], max_files_per_trigger: int | None = None) -> DataFrame:
    """The landed lines of many platforms as one stream (payload, value): one
    query, and so one writer, for collection over all of them."""
    out = None
    for payload, path in paths.items():
        r = _bounded(spark.readStream.schema("value string").format("text"), max_files_per_trigger, None)
        lines = r.load(path).select(F.lit(payload).alias("payload"), "value")
        out = lines if out is None else out.unionByName(lines)
    return out


class CollectSink:
    """``foreachBatch`` body of continuous collection.  Each micro-batch
    is one cycle: the spec's selection runs over the payloads that have landed
    since the last one, and the selected posts are validated and upserted.  A
    line that does not parse goes to the store's quarantine of lines.  Lines are
    parsed once, into a staging folder that every selection reads."""

    def __init__(self, store: Store, spec: CollectSpec, checkpoint: str, metrics_path: str | None = None,
                 collected_at=None):
        self.spec, self.collected_at = spec, collected_at
        self.sink = UpsertSink(store, metrics_path, checkpoint=checkpoint)

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        path = scratch_path(spark, "parsed")
        parsed = parse_payloads(df, {name: a.raw_schema for name, a in ADAPTERS.items()})
        try:
            parsed.write.parquet(path)
            rows = spark.read.schema(parsed.schema).parquet(path)
            folder = f"{self.sink.store.root}/_broken_lines/batch={self.sink._source(spark) or 'none'}-{int(batch_id):010d}"
            rows.where("line is not null").select("line", "payload").write.mode("overwrite").parquet(folder)
            fit = rows.where("line is null")
            raw = {name: fit.where(F.col("payload") == name).select(f"{name}.*") for name in ADAPTERS}
            # A post that several terms select is one row for the upsert.
            chosen = collect(spark, raw, self.spec, self.collected_at).drop("source", "rank")
            self.sink(first_copies(chosen), batch_id)
        finally:
            delete(spark, path)


def start_collect(lines: DataFrame, store: Store, spec: CollectSpec, checkpoint: str,
                  metrics_path: str | None = None, collected_at=None, trigger: dict | None = None) -> StreamingQuery:
    """Continuous collection of ``lines`` (see ``lines_stream``)."""
    store.create()
    sink = CollectSink(store, spec.check(), checkpoint, metrics_path, collected_at)
    return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"processingTime": f"{PAUSE_S} seconds"})).start()


def run_with_retry(start, attempts: int = 3, backoff_s: float = ERROR_PAUSE_S,
                   factor: float = 2.0, wait=lambda q: q.awaitTermination()) -> StreamingQuery:
    """Restart a failed query with exponential backoff.  ``start`` is a
    zero-argument function returning a started query; the checkpoint makes
    each restart resume where the last one stopped.  ``wait`` returns when the
    query has done what it should, and raises if it failed."""
    delay = backoff_s
    last = None
    for i in range(attempts):
        q = start()
        try:
            wait(q)
            return q
        except Exception as e:  # noqa: BLE001
            last = e
            log.warning("stream failed (attempt %d/%d): %s", i + 1, attempts, str(e)[:200])
            if i + 1 < attempts:
                time.sleep(delay)
                delay *= factor
    raise RuntimeError(f"stream failed after {attempts} attempts") from last


def totals_by_platform(metrics: DataFrame) -> DataFrame:
    """Rows that came and what became of them, per platform, over all batches."""
    per = metrics.where("status = 'ok'").select(F.explode("by_platform").alias("platform", "c"))
    return per.groupBy("platform").agg(*[F.sum(f"c.{c}").alias(c) for c in COUNTS])


def stop_and_report(query: StreamingQuery, metrics_path: str) -> DataFrame:
    """Stop gracefully, then the totals per platform."""
    query.stop()
    return totals_by_platform(read_metrics(SparkSession.active(), metrics_path))


def read_metrics(spark: SparkSession, metrics_path: str) -> DataFrame:
    """The metrics table (K9): one row per attempt at a micro-batch."""
    return spark.read.schema(METRICS_SCHEMA).json(metrics_path)


def live_counters(metrics: DataFrame) -> DataFrame:
    """Rows received and posts stored per platform so far and the last
    update, from the per-batch metrics of a unioned stream."""
    per = metrics.select("ts", F.explode("by_platform").alias("platform", "c"))
    return per.groupBy("platform").agg(F.sum("c.incoming").alias("incoming"), F.sum("c.inserted").alias("posts"),
                                       F.max("ts").alias("last_update"))


def platform_status(metrics: DataFrame) -> DataFrame:
    """The last status and update time of every platform that a unioned
    stream has brought rows of, the rows received and the posts stored."""
    per = metrics.select("ts", "status", F.explode("by_platform").alias("platform", "c")).where("c.incoming > 0")
    return per.groupBy("platform").agg(F.max("ts").alias("last_update"), F.max_by("status", "ts").alias("status"),
                                       F.sum("c.incoming").alias("incoming"), F.sum("c.inserted").alias("posts"))


def alerts(metrics: DataFrame, slow_s: float = 60.0) -> DataFrame:
    """Attempts at micro-batches that failed or took longer than ``slow_s``,
    with the error cut for a status line (E18)."""
    return metrics.where((F.col("status") != "ok") | (F.col("duration_s") > slow_s)) \
        .select("batch_id", "platform", "ts", "status", X.short_error("error").alias("error"), "duration_s")


def dedup_within_watermark(stream: DataFrame, ts_col: str, delay: str, key: list[str]) -> DataFrame:
    """Drop replays of a key that arrive within ``delay`` of the first
    copy's event time; state is dropped as the watermark passes, so memory
    stays bounded.  (The store's upsert is unbounded in time, T5; this one
    forgets and must not feed the store.)  A batch frame holds all its rows
    at once, so there it is a plain de-duplication on the key."""
    if not stream.isStreaming:
        return stream.dropDuplicates(key)
    return stream.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(key)
