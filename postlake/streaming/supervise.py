"""Sources that fail on their own (Q3, T1): one query per source, one supervisor.

Each source has a query that writes its posts to a staging folder of its own; a
single writer merges the folders into the store.  A source that fails is started
again after a pause that grows with each attempt, while the others go on; one that
keeps failing is given up and reported.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from postlake import schemas as S
from postlake.session import PACKED_TABLE, make_folder
from postlake.sources.store import Store
from postlake.streaming.stream import ERROR_PAUSE_S, PAUSE_S, posts_stream, start_upsert

log = logging.getLogger(__name__)


@dataclass
class SourceState:
    """``status``: waiting (for its next start), running, done, or failed."""
    status: str = "waiting"
    attempts: int = 0
    error: str | None = None
    query: StreamingQuery | None = None
    due: float = 0.0


class Supervisor:
    """Runs the queries that ``starts`` (source: function that starts its query)
    begin, each with its own attempts and pauses."""

    def __init__(self, spark: SparkSession, starts: dict[str, Callable[[], StreamingQuery]], attempts: int = 3,
                 backoff_s: float = ERROR_PAUSE_S, factor: float = 2.0):
        self.spark, self.starts = spark, starts
        self.attempts, self.backoff_s, self.factor = attempts, backoff_s, factor
        self.sources = {name: SourceState() for name in starts}

    def run(self, poll_s: int = 1) -> dict[str, SourceState]:
        """Returns when every source is done or given up (for queries that never end:
        when ``stop`` is called from elsewhere)."""
        while any(s.status in ("waiting", "running") for s in self.sources.values()):
            for name, s in self.sources.items():
                if s.status == "waiting" and s.due <= time.time():
                    self._start(name, s)
            if any(s.status == "running" for s in self.sources.values()):
                try:
                    self.spark.streams.awaitAnyTermination(poll_s)
                except Exception:  # noqa: BLE001 -- each query is asked below
                    pass
                self.spark.streams.resetTerminated()
                for name, s in self.sources.items():
                    if s.status == "running" and not s.query.isActive:
                        self._ended(name, s, s.query.exception())
            else:
                due = [s.due for s in self.sources.values() if s.status == "waiting"]
                time.sleep(max(0.0, min(due, default=0.0) - time.time()))
        return self.sources

    def stop(self) -> None:
        for s in self.sources.values():
            if s.status == "running":
                s.query.stop()
            s.status = "done" if s.status in ("waiting", "running") else s.status

    def _start(self, name: str, s: SourceState) -> None:
        s.attempts += 1
        try:
            s.query, s.status = self.starts[name](), "running"
        except Exception as e:  # noqa: BLE001
            self._ended(name, s, e)

    def _ended(self, name: str, s: SourceState, error: Exception | None) -> None:
        if error is None:
            s.status, s.error = "done", None
            return
        s.error = str(error)
        log.warning("source %s failed (attempt %d/%d): %s", name, s.attempts, self.attempts, s.error[:200])
        if s.attempts >= self.attempts:
            s.status = "failed"
        else:
            s.status, s.due = "waiting", time.time() + self.backoff_s * self.factor ** (s.attempts - 1)


def start_source(raw: dict[str, DataFrame], folder: str, checkpoint: str, trigger: dict | None = None,
                 collected_at=None, name: str | None = None) -> StreamingQuery:
    """One source (payload: its stream) normalized into its staging folder, exactly
    once by the file sink's log."""
    w = posts_stream(raw, collected_at).writeStream.format("parquet").options(**PACKED_TABLE) \
        .option("path", folder).option("checkpointLocation", checkpoint)
    w = w.queryName(name) if name else w
    return w.trigger(**(trigger or {"processingTime": f"{PAUSE_S} seconds"})).start()


def start_merge(spark: SparkSession, staged: list[str], store: Store, checkpoint: str, metrics_path: str | None = None,
                trigger: dict | None = None) -> StreamingQuery:
    """The one writer: everything that the sources have staged, upserted."""
    rows = None
    for folder in staged:
        part = spark.readStream.schema(S.POST).parquet(make_folder(spark, folder))
        rows = part if rows is None else rows.unionByName(part)
    return start_upsert(rows, store, checkpoint, metrics_path, trigger)
