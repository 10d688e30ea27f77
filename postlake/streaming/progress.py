"""Spark's progress events as a table.

A listener writes one JSON line per progress event of every query of the session, and
one when a query ends; a table of them gives rates, state sizes and late rows of all
queries, without a query of its own knowing about it.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from postlake.session import make_folder, write_text

PROGRESS_SCHEMA = T.StructType([
    T.StructField("event", T.StringType()), T.StructField("query", T.StringType()), T.StructField("query_id", T.StringType()),
    T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("input_rows", T.LongType()), T.StructField("input_rows_per_s", T.DoubleType()),
    T.StructField("processed_rows_per_s", T.DoubleType()), T.StructField("duration_ms", T.LongType()),
    T.StructField("state_rows", T.LongType()), T.StructField("late_rows", T.LongType()),
    T.StructField("sources", T.ArrayType(T.StructType([T.StructField("description", T.StringType()), T.StructField("rows", T.LongType())]))),
    T.StructField("error", T.StringType()),
])


class ProgressLog(StreamingQueryListener):
    """Writes the events of all queries of a session to a folder, a file each::

        log = ProgressLog(spark, path)
        with log:
            query = ...start()
            query.awaitTermination()
            log.settle(query)       # events arrive late, on another thread
        table = log.table()
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, make_folder(spark, path)
        self._names: dict[str, str | None] = {}
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def __enter__(self) -> "ProgressLog":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        states = p.get("stateOperators") or []
        row = {
            "event": "progress", "query": p.get("name"), "query_id": p["id"], "run_id": p["runId"], "batch_id": p["batchId"],
            "ts": p["timestamp"], "input_rows": sum(s.get("numInputRows") or 0 for s in p["sources"]),
            "input_rows_per_s": _rate(p.get("inputRowsPerSecond")), "processed_rows_per_s": _rate(p.get("processedRowsPerSecond")),
            "duration_ms": (p.get("durationMs") or {}).get("triggerExecution"),
            "state_rows": sum(s.get("numRowsTotal") or 0 for s in states),
            "late_rows": sum(s.get("numRowsDroppedByWatermark") or 0 for s in states),
            "sources": [{"description": s.get("description"), "rows": s.get("numInputRows")} for s in p["sources"]],
        }
        write_text(self.spark, f"{self.path}/{p['runId']}-{int(p['batchId']):010d}.json", json.dumps(row))

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        row = {"event": "terminated", "query": self._names.get(run), "query_id": str(event.id), "run_id": run, "error": event.exception}
        write_text(self.spark, f"{self.path}/{run}-end.json", json.dumps(row))
        with self._change:
            self._ended.add(run)
            self._change.notify_all()

    def settle(self, query: StreamingQuery, timeout_s: float = 60.0) -> None:
        """Wait for the last event of a query that has ended."""
        with self._change:
            if not self._change.wait_for(lambda: str(query.runId) in self._ended, timeout_s):
                raise TimeoutError(f"no end of run {query.runId} was reported in {timeout_s} s")

    def table(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS_SCHEMA).json(self.path)


def _rate(value) -> float | None:
    return float(value) if isinstance(value, (int, float)) else None


def throughput(progress: DataFrame) -> DataFrame:
    """Per query, micro-batches with rows, rows read, rows a second over the time
    spent in them, runs that failed, and the share of attempts that succeeded."""
    busy = (F.col("event") == "progress") & (F.col("input_rows") > 0)
    failed = (F.col("event") == "terminated") & F.col("error").isNotNull()
    spent = F.sum(F.when(busy, F.col("duration_ms")))
    return progress.groupBy("query").agg(
        F.count_if(busy).alias("batches"), F.coalesce(F.sum(F.when(busy, F.col("input_rows"))), F.lit(0)).alias("input_rows"),
        (1000 * F.sum(F.when(busy, F.col("input_rows"))) / F.greatest(spent, F.lit(1))).alias("rows_per_s"),
        F.max("processed_rows_per_s").alias("peak_rows_per_s"), F.count_if(failed).alias("failures"),
        (F.count_if(busy) / F.greatest(F.count_if(busy) + F.count_if(failed), F.lit(1))).alias("success_rate"))


def source_counters(progress: DataFrame) -> DataFrame:
    """Rows read so far and the last update per source of every query."""
    rows = progress.where("event = 'progress'").select("query", "ts", F.explode("sources").alias("s"))
    return rows.groupBy("query", F.col("s.description").alias("source")).agg(
        F.sum("s.rows").alias("input_rows"), F.max("ts").alias("last_update"))


def late_rows(progress: DataFrame) -> DataFrame:
    """Per query, rows that came behind the watermark and were dropped, the most
    rows held as state, and those held in the end."""
    rows = progress.where("event = 'progress'")
    return rows.groupBy("query").agg(F.sum("late_rows").alias("late_rows"), F.max("state_rows").alias("most_state_rows"),
                                     F.max_by("state_rows", F.struct("batch_id", "ts")).alias("state_rows"))
