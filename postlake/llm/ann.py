"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
turns a vector; its bucket is the nearest signed axis.  Enough polytopes are
combined (the last one over part of the axes) that a bucket holds
``bucket_rows`` vectors on average.  Each of ``tables`` tables has rotations of
its own; a query probes the ``probes`` buckets of least loss in every table.
Candidates are ranked by exact distances on the original vectors.

Equal vectors form one class, of which only the smallest ids can ever be among
the nearest; so the index holds each distinct vector once, with as many ids as a
result can need, and a vector that a third of all rows share costs no more than
another.  Queries with equal vectors are searched once.  A task streams the
vectors of a bucket past its queries and keeps the best of each, so no list of
candidate pairs is ever made.  Buckets are counted first: one of more than
``slot_vectors`` vectors or ``slot_queries`` queries (a dense cluster) is split
into a grid of cells, each with a part of the vectors and a part of the queries,
so no task holds or streams more than that.

A query with fewer candidates than asked for is searched against all rows, in
blocks.  Recall depends on the data and on the number of rows, so it is measured
first: ``sample`` evenly drawn queries are compared with all rows, and the probes
are raised from ``probes`` until the sample finds ``least_recall`` of its true
neighbours, with two standard errors to spare.  If ``most_probes`` are too few,
buckets are made twice as large, in the end so large that all rows are compared.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without an id.  Vectors are compared with
those of their own length only.  Repeated rows count once; an id with several
vectors counts with the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import stored

TABLES, PROBES, BUCKET_ROWS = 4, 24, 400
SLOT_VECTORS, SLOT_QUERIES = 20_000, 5_000
SEED = 20
BLOCK_QUERIES = 20_000
LEAST_RECALL, SAMPLE, MOST_PROBES = 0.9, 400, 128
CELLS = 1 << 21  # differences held at a time
DEALT_ROWS = 50_000  # in one batch
CELL = ["slot", "vpart", "qpart"]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; the width is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * draw.choice([-1.0, 1.0], x.shape[1]))
    return x


def shape_of(rows: int, dim: int, bucket_rows: int) -> list[int]:
    """Axes used by each polytope so that a bucket has about ``bucket_rows`` rows."""
    width = 1 << max(0, dim - 1).bit_length()
    buckets, axes = max(2.0, rows / bucket_rows), []
    while buckets >= 2 * width and len(axes) < 6:
        axes.append(width)
        buckets /= 2 * width
    if buckets >= 2 or not axes:
        axes.append(int(min(width, max(1, round(buckets / 2)))))
    return axes


def projections(vectors: np.ndarray, table: int, axes: list[int]) -> list[np.ndarray]:
    """Signed coordinates of the unit vectors in each polytope of a table."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.pad(unit, ((0, 0), (0, width - unit.shape[1])))
    turned = [rotate(unit, SEED + 1000 * table + k)[:, :m] for k, m in enumerate(axes)]
    return [np.concatenate([x, -x], axis=1) for x in turned]


def buckets_of(vectors: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    code = np.zeros(len(vectors), np.int64)
    for signed in projections(vectors, table, axes):
        code = code * signed.shape[1] + signed.argmax(axis=1)
    return code


def probes_of(vectors: np.ndarray, table: int, axes: list[int], probes: int) -> np.ndarray:
    """The buckets of least loss for each vector, the own bucket among them."""
    step = max(1, CELLS // (probes * 2 * max(axes)))
    if len(vectors) > step:
        return np.concatenate([probes_of(vectors[i:i + step], table, axes, probes) for i in range(0, len(vectors), step)])
    loss, code = np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1), np.int64)
    for signed in projections(vectors, table, axes):
        gap = (signed.max(axis=1, keepdims=True) - signed) ** 2
        total = (loss[:, :, None] + gap[:, None, :]).reshape(len(vectors), -1)
        codes = (code[:, :, None] * signed.shape[1] + np.arange(signed.shape[1])).reshape(len(vectors), -1)
        best = np.argsort(total, axis=1, kind="stable")[:, :probes]
        loss, code = np.take_along_axis(total, best, 1), np.take_along_axis(codes, best, 1)
    return code


def probes_needed(queries: np.ndarray, at: np.ndarray, near: np.ndarray, tables: int, axes: list[int], most: int) -> np.ndarray:
    """For each neighbour, a row of ``near`` of the query numbered in ``at``: how
    many probes in every table find it; ``most + 1`` if ``most`` do not."""
    needed = np.full(len(near), most + 1)
    for table in range(tables):
        probed = probes_of(queries, table, axes, most)
        hit = probed[at] == buckets_of(near, table, axes)[:, None]
        needed = np.minimum(needed, np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, most + 1))
    return needed


def plan_of(rows: int, queries: np.ndarray, at: np.ndarray, near: np.ndarray, whole: bool, tables: int, probes: int,
            bucket_rows: int, least_recall: float, most_probes: int) -> tuple[list[int], int]:
    """The axes and the fewest probes, ``probes`` at least, that find
    ``least_recall`` of the neighbours ``near`` of the drawn queries."""
    most = max(probes, most_probes)
    size = np.bincount(at, minlength=len(queries))
    while True:
        axes = shape_of(rows, queries.shape[1], bucket_rows)
        needed = probes_needed(queries, at, near, tables, axes, most)
        for n in range(probes, most + 1):
            found = np.bincount(at, needed <= n, minlength=len(queries))[size > 0] / size[size > 0]
            error = 0.0 if whole or not len(found) else found.std() / np.sqrt(len(found))
            if not len(found) or found.mean() - 2 * error >= least_recall:
                return axes, n
        bucket_rows *= 2


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1).astype(np.float64)


def _best(dist: np.ndarray, first: np.ndarray, ref: np.ndarray, most: int) -> tuple:
    order = np.lexsort((first, dist), axis=1)[:, :most]
    return tuple(np.take_along_axis(x, order, 1) for x in (dist, first, ref))


def nearest_in_slots(rows: DataFrame, most: int) -> DataFrame:
    """``rows``: (slot, vpart, qpart, is_vector, key, vec, ids), dealt and sorted
    by cell (slot, vpart, qpart) with the queries first.  Per query and cell the
    nearest classes (qkey, score, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, queries, keys, best, lists = None, None, None, None, None

        def flush():
            if best is None:
                return
            at = np.isfinite(best[0])
            who = np.broadcast_to(keys[:, None], at.shape)[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(who), pa.array(best[0][at]), pa.array([lists[r] for r in best[2][at]], pa.list_(pa.int64()))],
                names=["qkey", "score", "ids"])

        for batch in batches:
            cells = np.stack([batch.column(c).to_numpy() for c in CELL], axis=1)
            kinds = batch.column("is_vector").to_numpy()
            all_keys = batch.column("key").to_numpy()
            cuts = np.flatnonzero((np.diff(cells, axis=0) != 0).any(axis=1) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(kinds)]):
                if a < b and tuple(cells[a]) != slot:
                    yield from flush()
                    slot, queries, keys, best, lists = tuple(cells[a]), None, None, None, []
                part = batch.slice(a, b - a)
                vec = _matrix(part.column("vec"), np.float64)
                if not kinds[a]:
                    queries = vec if queries is None else np.concatenate([queries, vec])
                    keys = all_keys[a:b] if keys is None else np.concatenate([keys, all_keys[a:b]])
                    continue
                if queries is None:
                    continue
                if best is None:
                    best = (np.full((len(keys), most), np.inf), np.full((len(keys), most), -1, np.int64),
                            np.full((len(keys), most), -1, np.int64))
                ids = part.column("ids").to_pylist()
                step = max(1, CELLS // max(1, len(keys) * vec.shape[1]))
                rows_at = max(1, CELLS // (step * vec.shape[1]))
                for s in range(0, len(vec), step):
                    base, block, names = len(lists), vec[s:s + step], ids[s:s + step]
                    lists.extend(names)
                    first = np.array([x[0] for x in names], np.int64)
                    for r in range(0, len(keys), rows_at):
                        q = queries[r:r + rows_at]
                        dist = np.sqrt(((q[:, None, :] - block[None, :, :]) ** 2).sum(axis=2))
                        shape = dist.shape
                        joined = [np.concatenate([old[r:r + rows_at], new], axis=1) for old, new in zip(
                            best, (dist, np.broadcast_to(first, shape), np.broadcast_to(base + np.arange(len(names)), shape)))]
                        for old, new in zip(best, _best(*joined, most)):
                            old[r:r + rows_at] = new
                if len(lists) > 4 * best[2].size + 10_000:  # forget what is no longer among the best
                    used = np.unique(best[2][best[2] >= 0])
                    lists = [lists[i] for i in used]
                    best[2][best[2] >= 0] = np.searchsorted(used, best[2][best[2] >= 0])
        yield from flush()

    return (rows.repartition(*CELL).sortWithinPartitions(*CELL, "is_vector")
            .mapInArrow(run, "qkey bigint, score double, ids array<bigint>"))


def true_neighbours(classes: DataFrame, dim: int, queries: np.ndarray, most: int) -> DataFrame:
    """(q, score, vec, ids): the nearest ``most`` classes of each row of
    ``queries`` among all classes of their length."""
    item = dict(classes.dtypes)["vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = None, None
        step = max(1, CELLS // len(queries))
        for batch in batches:
            for s in range(0, len(batch), step):
                part = batch.slice(s, step)
                vec = _matrix(part.column("vec"), np.float64)
                dist = (queries ** 2).sum(axis=1)[:, None] + (vec ** 2).sum(axis=1) - 2 * queries @ vec.T
                rows = pa.Table.from_batches([part])
                if held is not None:
                    dist, rows = np.concatenate([best, dist], axis=1), pa.concat_tables([held, rows])
                if dist.shape[1] > most:  # forget what is not among the best of any query
                    near = np.argpartition(dist, most - 1, axis=1)[:, :most]
                    used = np.unique(near)
                    dist, rows = dist[:, used], rows.take(pa.array(used))
                best, held = dist, rows
        if held is not None:
            near = np.argsort(best, axis=1, kind="stable")[:, :most]
            taken = held.take(pa.array(near.ravel())).combine_chunks()
            for rows in taken.append_column("q", pa.array(np.repeat(np.arange(len(queries)), near.shape[1]), pa.int32())).append_column(
                    "score", pa.array(np.take_along_axis(best, near, 1).ravel())).select(["q", "score", "vec", "ids"]).to_batches():
                yield rows

    found = classes.where(F.col("dim") == dim).select("vec", "ids").mapInArrow(run, f"q int, score double, vec {item}, ids array<bigint>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", F.col("ids")[0]))
    return found.withColumn("n", rank).where(F.col("n") <= most).drop("n")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = TABLES, probes: int = PROBES, bucket_rows: int = BUCKET_ROWS,
            slot_vectors: int = SLOT_VECTORS, slot_queries: int = SLOT_QUERIES, least_recall: float = LEAST_RECALL,
            sample: int = SAMPLE, most_probes: int = MOST_PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row
    whose id is divisible by ``every``, ties to the smaller id."""
    v = F.col("vec")
    fit = (vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("vec"))
           .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
           .where(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)))
    # A class: one distinct vector with its k + 1 smallest ids (one may be the query's own).
    once = fit.groupBy("vec", "vec_id").agg(F.lit(1).alias("one"))
    small = once.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = stored(small.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
                     .select(F.xxhash64("vec").alias("key"), F.size("vec").alias("dim"), "vec", "ids"), "classes")
    asked = stored(once.where(F.col("vec_id") % every == 0)
                   .select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("qkey"), "vec"), "queries")
    queries = asked.groupBy("vec").agg(F.first("qkey").alias("key")).select("key", "vec", F.size("vec").alias("dim"))
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().orderBy(F.desc("count")).collect()}
    plans = {dim: shape_of(rows, dim, bucket_rows) for dim, rows in sizes.items()}
    probes_at = dict.fromkeys(plans, probes)

    def drawn(dim: int) -> tuple[list[int], int]:
        """Axes and probes by the recall of evenly drawn queries."""
        rows = (asked.where(F.size("vec") == dim).orderBy(F.xxhash64("query_id", F.lit(SEED)), "query_id").limit(sample)
                .select("query_id", "vec").collect())
        if not rows:
            return plans[dim], probes
        own = np.array([r["vec"] for r in rows], np.float64)
        at, near, left = [], [], [k] * len(rows)
        for r in sorted(true_neighbours(classes, dim, own, k + 1).collect(), key=lambda r: (r["q"], r["score"], r["ids"][0])):
            others = min(left[r["q"]], sum(i != rows[r["q"]]["query_id"] for i in r["ids"]))
            left[r["q"]] -= others
            at += [r["q"]] * others
            near += [r["vec"]] * others
        return plan_of(sizes[dim], own, np.array(at, np.int64), np.array(near, np.float64).reshape(-1, dim), len(rows) < sample,
                       tables, probes, bucket_rows, least_recall, most_probes)

    for dim, axes in plans.items():
        if np.prod([2 * m for m in axes]) > probes:  # else every bucket is probed
            plans[dim], probes_at[dim] = drawn(dim)
    spans = {dim: int(np.prod([2 * m for m in axes])) for dim, axes in plans.items()}
    starts, total = {}, 0
    for dim in plans:
        starts[dim], total = total, total + spans[dim] * tables

    def slots(is_vector: bool, count_only: bool):
        """Deals rows to the slots of all tables; or only counts them."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    own, axes, most = _matrix(part.column("vec"), np.float64), plans[int(dim)], probes_at[int(dim)]
                    for table in range(tables):
                        base = starts[int(dim)] + table * spans[int(dim)]
                        code = buckets_of(own, table, axes)[:, None] if is_vector else probes_of(own, table, axes, most)
                        if count_only:
                            at, n = np.unique(code, return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(base + at), pa.array(n)], names=["slot", "n"])
                            continue
                        step = max(1, DEALT_ROWS // code.shape[1])
                        for s in range(0, len(own), step):
                            some = code[s:s + step]
                            moved = part.take(pa.array(s + np.repeat(np.arange(len(some)), code.shape[1])))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(base + some.ravel()), moved.column("key"), moved.column("vec"), moved.column("ids")],
                                names=["slot", "key", "vec", "ids"])
        return run

    item = dict(classes.dtypes)["vec"]
    out = f"slot bigint, key bigint, vec {item}, ids array<bigint>"
    blank = F.lit(None).cast("array<bigint>").alias("ids")
    both = [(True, classes.select("key", "dim", "vec", "ids")), (False, queries.select("key", "dim", "vec", blank))]
    # Slots too large for one task, and into how many parts each side is cut.
    held = [rows.select("dim", "vec").mapInArrow(slots(side, True), "slot bigint, n bigint")
            .select("slot", F.lit(side).alias("v"), "n") for side, rows in both]
    n_of = [F.sum(F.when(F.col("v") == F.lit(side), F.col("n")).otherwise(0)) for side in (True, False)]
    large = stored(held[0].unionAll(held[1]).groupBy("slot").agg(
        F.ceil(n_of[0] / slot_vectors).alias("vparts"), F.ceil(n_of[1] / slot_queries).alias("qparts"))
        .where("vparts > 0 and qparts > 0 and vparts + qparts > 2"), "large-slots")

    def dealt(is_vector: bool, rows: DataFrame) -> DataFrame:
        """Rows by cell: a vector lies in one part of the vectors and meets
        every part of the queries, and the other way round."""
        own, other = ("vpart", "qpart") if is_vector else ("qpart", "vpart")
        at = rows.mapInArrow(slots(is_vector, False), out).join(large, "slot", "left")
        parts = {c: F.coalesce(F.col(c + "s"), F.lit(1)) for c in (own, other)}
        return (at.withColumn(own, F.pmod(F.xxhash64("key"), parts[own]))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), parts[other] - 1)))
                .select(*CELL, F.lit(int(is_vector)).alias("is_vector"), "key", "vec", "ids"))

    def ranked(found: DataFrame) -> DataFrame:
        """The best k rows of every query row, own row left out."""
        each = (found.select("qkey", "score", F.explode("ids").alias("vec_id"))
                .groupBy("qkey", "vec_id").agg(F.min("score").alias("score")))
        order = [F.col("score"), F.col("vec_id")]
        top = each.withColumn("n", F.row_number().over(Window.partitionBy("qkey").orderBy(*order))).where(F.col("n") <= k + 1)
        mine = asked.select("query_id", "qkey").join(top.drop("n"), "qkey").where("vec_id <> query_id")
        # An id may have several vectors, and so several query classes.
        nearest_of = mine.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        return nearest_of.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    result = stored(ranked(nearest_in_slots(dealt(*both[0]).unionAll(dealt(*both[1])), k + 1)), "nearest")

    short = (asked.join(result.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
             .where(F.coalesce("n", F.lit(0)) < k))
    short_queries = stored(short.groupBy("vec").agg(F.first("qkey").alias("key"))
                           .withColumn("dim", F.size("vec")), "short")
    n_short = short_queries.count()
    if not n_short:
        return result
    # Too few candidates: these queries against all rows, in blocks.
    blocks, parts = -(-n_short // BLOCK_QUERIES), 64
    whole_cell = [F.lit(0).cast("bigint").alias(c) for c in CELL[1:]]
    wide = (classes.select("key", "dim", "vec", "ids", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
            .select(((F.col("dim").cast("bigint") * blocks + F.col("block")) * parts + F.pmod("key", F.lit(parts))).alias("slot"),
                    *whole_cell, F.lit(1).alias("is_vector"), "key", "vec", "ids"))
    probing = (short_queries.select("key", "dim", "vec", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
               .select(((F.col("dim").cast("bigint") * blocks + F.pmod(F.xxhash64("key"), F.lit(blocks))) * parts + F.col("part")).alias("slot"),
                       *whole_cell, F.lit(0).alias("is_vector"), "key", "vec", blank))
    whole = ranked(nearest_in_slots(wide.unionAll(probing), k + 1))
    ids = short.select("query_id").distinct()
    return result.join(ids, "query_id", "left_anti").unionAll(whole.join(ids, "query_id", "left_semi"))
