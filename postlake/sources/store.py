"""The post store (K1-K3, K8, S14, L6): partitioned Parquet snapshots and a pointer.

Layout::

    <root>/_current.json                                  which snapshot is current
    <root>/snapshot=<i>/platform=<p>/part=<h>/part-*.parquet
    <root>/_quarantine/batch=<source>-<id>/               posts without required fields

A snapshot is a plain Parquet dataset, partitioned by ``platform`` and by a hash of
the key (``pmod(xxhash64(platform, object_id), parts)``), so platform filters prune
folders (F1) and a key names its partition.

A batch is one Spark job from the current snapshot to the other one: the batch's keys
name the partitions they fall in; the rows of these partitions meet the batch in the
keyed upsert, and dynamic partition overwrite replaces just these partitions in the
other snapshot.  Then one pointer change publishes it.  There are two copies of the
data, used in turn.  The one that was current before lacks the partitions of the last
batch; the pointer lists them as stale, and the next batch brings them along.  They
are listed before a write begins, so a write that fails half-way leaves the current
snapshot as it was, and what it may have spoilt in the other is rewritten by the next
(K3).  A DataFrame read from the store stays valid until the second batch after it
begins.

Of a large store, rows that the batch's Bloom filter rules out go from scan to file
without a shuffle; only the others take part in the join (``operators.keys``).  The cost of a batch is
that of the partitions its keys fall in, so batches should be large against ``parts``.

The first batch has nothing to meet.  A partition in which every key stands once is
published as it was staged: its folder is moved into the snapshot, neither shuffled nor
written again (its files also hold the columns ``errors`` and ``warnings``, which reads
leave out).  In the others only rows whose key may come again are shuffled, if they are
few.

Input is evaluated once: it is written to a staging folder, split by validity,
platform and partition, and the staged rows are read for everything that follows.  A
``batch_id`` that its source (a stream's query id) has already applied is skipped
(idempotent ``foreachBatch``).  A new source starts its ids anew; rows carry the
store's own ascending batch number.  The settings that decide where a row lies and how
it is merged are part of the pointer; opening a store with others is an error.  One
writer per store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake import schemas as S
from postlake.operators import keys as K
from postlake.operators import upsert as U
from postlake.operators.quality import with_issues
from postlake.session import PACKED_TABLE, delete, exists, folders, make_folder, move, read_text, write_text

POINTER = "_current.json"
COPIES = 2
SMALL_ROWS = 1_000_000  # of a store that is joined whole: the filter would cost more than it saves
COUNTS = ("incoming", "inserted", "updated", "unchanged")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the folder of null


class Store:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = S.POST,
                 key: list[str] | None = None, parts: int = 16, order: str = "seq",
                 compare: str = "text", replace=U.POST_REPLACE,
                 replace_if_reddit=U.POST_REPLACE_IF_REDDIT, within_batch: str = "first", refresh=(),
                 on_step: Callable[[str, int], None] | None = None, small_rows: int = SMALL_ROWS):
        if "platform" not in schema.fieldNames():
            raise ValueError("store schema needs a platform column")
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema
        self.key = list(key or S.KEY)
        self.parts = parts
        self.order, self.compare = order, compare
        self.replace, self.replace_if_reddit = tuple(replace), tuple(replace_if_reddit)
        # Upsert options (D7, D8); the defaults are the reference's rule.
        self.within_batch, self.refresh = within_batch, tuple(refresh)
        self.small_rows = small_rows
        # Called with "write", "publish" and "done" and the source's batch id before
        # the snapshot is written, before it is published, and after.
        self.on_step = on_step or (lambda step, batch_id: None)
        self.data_cols = schema.fieldNames() + ["batch_id"]

    # ------------------------------------------------------------ pointer
    def pointer(self) -> dict | None:
        txt = read_text(self.spark, f"{self.root}/{POINTER}")
        at = json.loads(txt) if txt else None
        if at and at["settings"] != self._settings():
            wrong = [k for k, v in self._settings().items() if at["settings"].get(k) != v]
            raise ValueError(f"the store at {self.root} was created with other values of {wrong}")
        return at

    def _settings(self) -> dict:
        return {"parts": self.parts, "key": self.key, "order": self.order, "compare": self.compare,
                "replace": list(self.replace), "replace_if_reddit": list(self.replace_if_reddit),
                "within_batch": self.within_batch, "refresh": list(self.refresh)}

    def _publish(self, at: dict) -> None:
        write_text(self.spark, f"{self.root}/{POINTER}", json.dumps(at, sort_keys=True))

    def exists(self) -> bool:
        return exists(self.spark, f"{self.root}/{POINTER}")

    def create(self) -> "Store":
        """K1: idempotent; an empty store has a pointer and no snapshot."""
        if not self.exists():
            self._publish({"snapshot": None, "batches": 0, "rows": 0, "last_batch_id": -1, "sources": {},
                           "stale": {str(i): [] for i in range(COPIES)}, "settings": self._settings()})
        return self

    # ------------------------------------------------------------ read
    def _file_schema(self, extra: tuple[T.StructField, ...] = ()) -> T.StructType:
        fields = [f for f in self.schema.fields if f.name != "platform"]
        return T.StructType([*fields, T.StructField("batch_id", T.LongType()), *extra,
                             T.StructField("platform", T.StringType()), T.StructField("part", T.IntegerType())])

    def _snapshot(self, at: dict, only: set[tuple[str | None, int]] | None = None) -> DataFrame:
        """Data columns and ``part`` of the current snapshot (of the partitions ``only``)."""
        if at["snapshot"] is None or only == set():
            return self.spark.createDataFrame([], self._file_schema()).select(*self.data_cols, "part")
        df = self.spark.read.schema(self._file_schema()).parquet(f"{self.root}/snapshot={at['snapshot']}")
        if only is not None:
            df = df.where(self._among(only))
        return df.select(*self.data_cols, "part")

    @staticmethod
    def _among(only: set[tuple[str | None, int]]) -> Column:
        by_platform: dict[str | None, list[int]] = {}
        for p, h in sorted(only, key=repr):
            by_platform.setdefault(p, []).append(h)
        named = [(F.col("platform").isNull() if p is None else F.col("platform") == p) & F.col("part").isin(parts)
                 for p, parts in by_platform.items()]
        return reduce(Column.__or__, named)

    def read(self, with_batch: bool = False) -> DataFrame:
        """The current rows (lazy; Catalyst pushes filters and prunes folders)."""
        at = self.pointer()
        if at is None:
            raise FileNotFoundError(f"no store at {self.root}")
        return self._snapshot(at).select(*(self.data_cols if with_batch else self.schema.fieldNames()))

    def page(self, platform: str | None = None, offset: int | None = None,
             limit: int | None = None) -> DataFrame:
        """One page in insertion order (batch, seq, key).  ``None`` means
        not set; 0 means 0 (D9).  A top-k that keeps offset + limit rows in a task:
        for deep pages see ``page_after``."""
        df = self.read(with_batch=True)
        if platform is not None:
            df = df.where(F.col("platform") == platform)
        df = df.orderBy("batch_id", self.order, *self.key)
        if offset is not None:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
        return df

    def page_after(self, cursor: dict | None, limit: int, platform: str | None = None) -> DataFrame:
        """The ``limit`` rows behind ``cursor`` in insertion order; the first
        page if it is None.  A page costs the same however deep it lies: the batch
        number is pushed to the scan, whose files are sorted by it, so row groups
        before the cursor are skipped, and a task keeps ``limit`` rows."""
        df = self.read(with_batch=True)
        if platform is not None:
            df = df.where(F.col("platform") == platform)
        names = ["batch_id", self.order, *self.key]
        if cursor is not None:
            later, same = F.lit(False), F.lit(True)
            for c in names:
                value = cursor[c]
                # In this order null comes first.
                later = later | (same & (F.col(c).isNotNull() if value is None else F.coalesce(F.col(c) > F.lit(value), F.lit(False))))
                same = same & F.col(c).eqNullSafe(F.lit(value))
            df = df.where(F.col("batch_id") >= F.lit(cursor["batch_id"])).where(later)
        return df.orderBy(*names).limit(limit)

    def cursor(self, page: DataFrame) -> dict | None:
        """The cursor of the last row of a page, for the page behind it; None if
        the page is empty."""
        names = ["batch_id", self.order, *self.key]
        last = page.select(*names).orderBy(*[F.col(c).desc_nulls_last() for c in names]).first()
        return last.asDict() if last else None

    # ------------------------------------------------------------ write
    def upsert(self, batch: DataFrame, batch_id: int, source: str = "") -> dict:
        """K3: apply one batch with the upsert rule; returns what became of its rows,
        in all and ``by_platform``.  Skips a ``batch_id`` that ``source`` has already
        applied.  The store numbers its batches itself: by ``batch_id`` as long as
        that ascends, else by the next number."""
        return self._write(batch, batch_id, source)

    def ingest(self, posts: DataFrame, batch_id: int, source: str = "") -> dict:
        """Q1/Q2 on the write path: posts without a required field go to the
        quarantine folder, the others are upserted."""
        return self._write(posts, batch_id, source, check=True)

    def insert(self, batch: DataFrame, batch_id: int, source: str = "") -> dict:
        """K2: strict insert.  Raises, and writes nothing, if a key of ``batch``
        is in the store or occurs twice in the batch; otherwise as ``upsert``."""
        return self._write(batch, batch_id, source, strict=True)

    def quarantine_path(self) -> str:
        return f"{self.root}/_quarantine"

    def _write(self, batch: DataFrame, batch_id: int, source: str, check: bool = False, strict: bool = False) -> dict:
        at = self.create().pointer()
        applied = at["sources"].get(source)
        if applied and batch_id <= applied["batch_id"]:
            # The counts of the last batch are known, in case its report got lost.
            return self._report(batch_id, applied["counts"] if batch_id == applied["batch_id"] else {}, skipped=True)
        number = max(batch_id, at["last_batch_id"] + 1)
        path = f"{self.root}/_staged/{number:010d}-{uuid.uuid4().hex[:8]}"
        try:
            rows = self._stage(batch, number, path, check)
            if "valid=false" in folders(self.spark, path):
                # One folder per batch, overwritten if the batch runs again.
                bad = self._staged(path, "false", check)
                bad.write.mode("overwrite").options(**PACKED_TABLE).parquet(f"{self.quarantine_path()}/batch={source or 'none'}-{int(batch_id):010d}")
            good = self._staged(path, "true", check).select(*self.data_cols, "part")
            staged = self._partitions(f"{path}/valid=true")
            if strict:
                known = self._snapshot(at, set(staged)).select(*self.key)
                if not U.strict_append_conflicts(known, good, self.key, K.blocks_for(rows)).isEmpty():
                    raise ValueError("strict insert rejected: duplicate keys")
            self.on_step("write", batch_id)
            counts = self._merge(at, good, staged, K.blocks_for(rows))
            self.on_step("publish", batch_id)
            at["batches"] += 1
            at["rows"] += sum(c["inserted"] for c in counts.values())
            at["last_batch_id"] = number
            at["sources"][source] = {"batch_id": batch_id, "counts": counts}
            self._publish(at)
            self.on_step("done", batch_id)
        finally:
            delete(self.spark, path)
        return self._report(batch_id, counts, skipped=False)

    @staticmethod
    def _report(batch_id: int, counts: dict, skipped: bool) -> dict:
        total = {c: sum(v[c] for v in counts.values()) for c in COUNTS}
        return {"skipped": skipped, "batch_id": batch_id, **total, "by_platform": counts}

    def _stage(self, batch: DataFrame, number: int, path: str, check: bool) -> int:
        """Write the batch once, split by validity, platform and partition; its rows."""
        kept = batch.select(*self.schema.fieldNames())
        part = F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")
        kept = (with_issues(kept) if check else kept).withColumns({"batch_id": F.lit(number).cast("long"), "part": part})
        seen = Observation(f"staged-{uuid.uuid4().hex[:8]}")
        (kept.withColumn("valid", F.size("errors") == 0 if check else F.lit(True)).observe(seen, F.count(F.lit(1)).alias("n"))
         .write.options(**PACKED_TABLE).partitionBy("valid", "platform", "part").parquet(path))
        return int(seen.get.get("n") or 0)

    def _staged(self, path: str, valid: str, check: bool) -> DataFrame:
        texts = T.ArrayType(T.StringType())
        extra = (T.StructField("errors", texts), T.StructField("warnings", texts)) if check else ()
        if f"valid={valid}" not in folders(self.spark, path):
            return self.spark.createDataFrame([], self._file_schema(extra))
        out = self.spark.read.schema(self._file_schema(extra)).parquet(f"{path}/valid={valid}")
        return out.drop("part", "batch_id") if valid == "false" else out

    def _partitions(self, path: str) -> dict[tuple[str | None, int], str]:
        """The partitions in a folder, from the names of their folders."""
        out = {}
        for p in folders(self.spark, path):
            if p.startswith("platform="):
                platform = unquote(p.removeprefix("platform="))
                for h in folders(self.spark, f"{path}/{p}"):
                    out[None if platform == _NO_VALUE else platform, int(h.removeprefix("part="))] = f"{path}/{p}/{h}"
        return out

    def _census(self, batch: DataFrame) -> dict[tuple[str | None, int], tuple[int, int]]:
        """Rows and keys of each partition of a batch."""
        keys = batch.groupBy(*dict.fromkeys(["platform", "part", *self.key])).agg(F.count(F.lit(1)).alias("_n"))
        per = keys.groupBy("platform", "part").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("keys"))
        return {(r["platform"], r["part"]): (r["rows"], r["keys"]) for r in per.collect()}

    def _firsts(self, batch: DataFrame, rows: int, keys: int) -> DataFrame:
        """The first copies of a batch and their number (``_copies``).  If copies are
        few, only rows whose key may come again are shuffled (``rows`` and ``keys``: of
        ``batch``)."""
        near, far = batch, None
        if rows > self.small_rows and 4 * (rows - keys) < rows:
            again = batch.groupBy(*self.key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*self.key)
            near, far = U.split_by_keys(batch, again, self.key, K.blocks_for(rows - keys))
        firsts = U.first_copies(near, self.key, self.order, copies="_copies").hint("rebalance", "platform", "part")
        return firsts if far is None else firsts.unionByName(far.withColumn("_copies", F.lit(1).cast("long")))

    def _merge(self, at: dict, batch: DataFrame, staged: dict[tuple[str | None, int], str], blocks: int) -> dict:
        """Write the touched partitions (those of ``staged``, the folders of the batch),
        merged, and the stale ones into the other snapshot; ``at`` then points to it.
        Returns the counts per platform."""
        if not staged:
            return {}
        touched = set(staged)
        now = at["snapshot"]
        target = 0 if now is None else (now + 1) % COPIES
        stale = {tuple(x) for x in at["stale"][str(target)]}
        # Until it is published, whatever this write may replace counts as stale.
        self._publish({**at, "stale": {**at["stale"], str(target): sorted(map(list, stale | touched), key=repr)}})
        # A stale partition may have no rows now, and would not be overwritten.
        for partition, folder in self._partitions(f"{self.root}/snapshot={target}").items():
            if partition in stale:
                delete(self.spark, folder)
        platforms = sorted({p for p, _ in touched if p is not None})
        counted = Observation(f"merged-{uuid.uuid4().hex[:8]}")
        exprs = [F.count(F.lit(1)).alias("rows")]
        for i, p in enumerate([*platforms, None]):
            own = F.col("platform").isNull() if p is None else F.col("platform") == p
            exprs.append(F.sum(F.when(own, F.col("_copies"))).alias(f"incoming_{i}"))
            exprs += [F.count_if(own & (F.col("_outcome") == o)).alias(f"{o}_{i}") for o in COUNTS[1:]]
        # Rebalancing splits a large partition over tasks and gathers small ones.  The
        # counts are taken behind it, in the task that writes, so that a stage that
        # runs again does not count twice.
        settle = lambda df: df.hint("rebalance", "platform", "part").observe(counted, *exprs).select(*self.data_cols, "part")
        whole: dict[tuple[str | None, int], int] = {}  # partitions that are published as staged: their rows
        if now is None and self.within_batch == "first" and not self.refresh:
            # The folder of null also has the rows of the empty string.
            census = self._census(batch) if "platform" in self.key else {}
            whole = {x: n for x, (n, keys) in census.items() if n == keys and x[0] is not None and x in staged}
            n, keys = (sum(v[i] for x, v in census.items() if x not in whole) for i in (0, 1))
            rest = touched - set(whole)
            rows = self._firsts(batch.where(self._among(rest)), n, keys).withColumn("_outcome", F.lit("inserted")) \
                .observe(counted, *exprs).select(*self.data_cols, "part") if rest else None
        else:
            near, far = self._snapshot(at, stale | touched), None
            if at["rows"] > self.small_rows:
                near, far = U.split_by_keys(near, batch, self.key, blocks)
            done = U.upsert(near, batch, self.key, self.order, self.compare, self.replace, self.replace_if_reddit,
                            with_outcome=True, within_batch=self.within_batch, refresh=self.refresh)
            rows = settle(done) if far is None else settle(done).unionByName(far)
        got = {}
        if rows is not None:
            (rows.sortWithinPartitions("platform", "part", "batch_id", self.order).write.mode("overwrite").options(**PACKED_TABLE)
             .option("partitionOverwriteMode", "dynamic").partitionBy("platform", "part").parquet(f"{self.root}/snapshot={target}"))
            got = counted.get
        for x in whole:
            platform, part = staged[x].split("/")[-2:]
            move(self.spark, staged[x], f"{make_folder(self.spark, f'{self.root}/snapshot={target}/{platform}')}/{part}")
        at["stale"][str(target)] = []
        for i in range(COPIES):
            if i != target:
                at["stale"][str(i)] = sorted(map(list, {tuple(x) for x in at["stale"][str(i)]} | touched), key=repr)
        at["snapshot"] = target
        counts = {p or "": {c: int(got.get(f"{c}_{i}") or 0) for c in COUNTS}
                  for i, p in enumerate([*platforms, None]) if p is not None or got.get(f"incoming_{i}")}
        for (p, _), n in whole.items():
            counts[p]["incoming"] += n
            counts[p]["inserted"] += n
        return counts
