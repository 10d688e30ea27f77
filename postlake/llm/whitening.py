"""Embedding whitening: principal components by a block Jacobi-Davidson method.

Entries are put on a grid, x = floor(``grid`` * c), so that sums and deviations are
exact integers (a constant added to x changes neither deviations nor components).  The covariance V (divisor n, centred first) is never
formed: a product of V with a block of vectors is one pass over the rows, in which
each task adds up c (c' u) over its centred rows c; the partial sums, one small
matrix a task, are merged in two levels.

Jacobi-Davidson: Rayleigh-Ritz on a subspace gives the best approximate pairs.  Those
whose residual has reached double precision are locked, in falling order, and
projected out from then on.  For the others the correction equation
(I - QQ')(V - e I)(I - QQ') t = -r is solved roughly by a few steps of MINRES (Q
holds the locked and the current vectors); all pairs of a block advance in step, so
a step is one product.  The corrections extend the subspace, which is cut back to
its best vectors when it grows too large.  Once it fills the whole space, the
Rayleigh-Ritz pairs are exact up to rounding; should their residuals still be above the
limit, only the rounding of the products is left, and the limit is doubled.

Defined results: rows whose vector is null, empty, or has an entry that is null, not
finite or too large for the grid take no part.  Vectors of several lengths have no
common covariance: those of the most frequent length take part (of several the
longest).  Rows without an id take part and keep their null id; repeated rows count
each time.  A component whose variance is not above 1e-9 of the largest is zero up to
rounding, cannot be whitened and is not returned, so equal rows only, a single row, or an empty table give no rows.
Components of equal variance span a space of which any basis is right.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import map_arrow, stored

GRID = 64
COMPONENTS = 32
TOLERANCE = 256 * np.finfo(float).eps  # of a residual, relative to the largest eigenvalue
FLAT = 1e-9  # of the largest variance: what is not above it is rounding
BLOCK, INNER = 16, 4  # vectors a correction adds, MINRES steps
ROUNDS = 200
MERGERS = 8
LARGEST = 1 << 52  # of a grid value
ROWS = 8192  # vectors in a batch


def grid_vectors(vectors: DataFrame, id_col: str, vector_col: str, grid: int) -> DataFrame:
    """(vec_id, x): the rows that take part."""
    v = F.col(vector_col)
    scaled = F.transform(v, lambda c: F.floor(c.cast("double") * grid))
    usable = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) * grid < LARGEST, F.lit(False)))  # nan is the largest value
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & usable).select(F.col(id_col).cast("bigint").alias("vec_id"), scaled.alias("x"))
    rows = stored(rows, "grid")
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.struct("n", "dim")).alias("best")).first()["best"]  # a number of lengths
    return rows.where(F.size("x") == (best["dim"] if best else 0))


def matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def sums_of(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows, and the sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if len(batch):
                x = matrix(batch.column("x"))
                n += len(x)
                total = total + x.astype(object).sum(axis=0) if int(np.abs(x).max()) > 1 << 40 else total + x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in total]], pa.list_(pa.string()))], names=["n", "s"])

    parts = map_arrow(rows.select("x"), run, "n bigint, s array<string>", ROWS)
    exact = parts.select("n", F.posexplode("s").alias("i", "s")).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # a row a dimension
    return (exact[0]["n"], [int(r["s"]) for r in exact]) if exact else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit integers if they suffice, else Python's."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most < 1 << 62:
        return x.astype(np.int64) * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (deviations(x, n, sums) / n).astype(np.float64)


def added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of ``part`` of a batch of them, a matrix of ``shape``.
    Each task adds up its rows, a few mergers the tasks, the driver the mergers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += part(matrix(batch.column("x")))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for m in batch.column("m"):
                total += np.frombuffer(m.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = map_arrow(rows.select("x"), run, "m binary", ROWS).repartition(MERGERS)
    merged = map_arrow(parts, merge, "m binary", ROWS).collect()
    return sum((np.frombuffer(r["m"]).reshape(shape) for r in merged), np.zeros(shape))


def orthonormal(block: np.ndarray, against: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the bases ``against``."""
    for _ in range(3):
        for q in against:
            block = block - q @ (q.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * s[0]]
    return block


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """A few steps of MINRES for every column of ``right``; ``apply`` is a symmetric
    operator for each column.  All columns advance together."""
    size = np.linalg.norm(right, axis=0)
    v, before, beta = right / np.where(size > 0, size, 1), np.zeros_like(right), np.zeros(len(size))
    answer, d1, d2 = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c1, s1, c2, s2 = np.ones_like(size), np.zeros_like(size), np.ones_like(size), np.zeros_like(size)
    left = size.copy()
    for _ in range(steps):
        w = apply(v) - beta * before
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v
        after = np.linalg.norm(w, axis=0)
        # The two last rotations on the new column, then one that clears ``after``.
        r3, r2 = s2 * beta, c2 * beta
        r2, r1 = c1 * r2 + s1 * alpha, -s1 * r2 + c1 * alpha
        norm = np.hypot(r1, after)
        c, s = np.where(norm > 0, r1 / np.where(norm > 0, norm, 1), 1), np.where(norm > 0, after / np.where(norm > 0, norm, 1), 0)
        d = np.where(norm > 0, (v - r3 * d2 - r2 * d1) / np.where(norm > 0, norm, 1), 0)
        answer = answer + c * left * d
        left = -s * left
        c2, s2, c1, s1, d2, d1 = c1, s1, c, s, d1, d
        before, v, beta = v, w / np.where(after > 0, after, 1), after
    return answer


def largest_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, tolerance: float = TOLERANCE, block: int = BLOCK,
                  inner: int = INNER, most_basis: int | None = None, rounds: int = ROUNDS, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and eigenvectors (columns) of the
    symmetric positive operator ``product`` (dim x b -> dim x b)."""
    k, draw = min(k, dim), np.random.default_rng(seed)
    most_basis = most_basis or 4 * max(k, block)
    locked, values, scale = np.zeros((dim, 0)), np.zeros(0), 0.0
    basis = orthonormal(draw.normal(size=(dim, min(dim, max(k, block)))), [])
    image = product(basis)
    for _ in range(rounds):
        # Rayleigh-Ritz on the subspace.
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, basis, image = theta[::-1], basis @ s[:, ::-1], image @ s[:, ::-1]
        residual = image - basis * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        scale = max(scale, theta[0])
        # Lock the leading pairs that have converged.
        lock = 0
        while lock < len(theta) and len(values) + lock < k and size[lock] <= tolerance * scale:
            lock += 1
        filled = locked.shape[1] + basis.shape[1] == dim
        locked, values = np.hstack([locked, basis[:, :lock]]), np.concatenate([values, theta[:lock]])
        if len(values) == k:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        basis, image, theta, residual, size = basis[:, lock:], image[:, lock:], theta[lock:], residual[:, lock:], size[lock:]
        if filled:  # only the rounding of the products is left: renew them, and allow for more of it
            basis, tolerance = orthonormal(basis, [locked]), 2 * tolerance
            image = product(basis)
            continue
        if basis.shape[1] + block > most_basis:
            keep = max(k - len(values), block) + block
            basis, image, theta, residual, size = basis[:, :keep], image[:, :keep], theta[:keep], residual[:, :keep], size[:keep]
        # Corrections of the first pairs that have not converged.
        open_ = np.flatnonzero(size[:k - len(values)] > tolerance * scale)[:block]
        space = np.hstack([locked, basis[:, open_]])
        off = lambda y: y - space @ (space.T @ y)
        step = minres(lambda y: off(product(off(y)) - off(y) * theta[open_]), -off(residual[:, open_]), inner)
        more = orthonormal(step, [locked, basis])
        if not more.shape[1]:  # nothing new in them: a drawn direction
            more = orthonormal(draw.normal(size=(dim, block)), [locked, basis])
        more = more[:, :dim - locked.shape[1] - basis.shape[1]]
        basis, image = np.hstack([basis, more]), np.hstack([image, product(more)])
    raise RuntimeError(f"{len(values)} of {k} pairs reached a residual of {tolerance:.1e} in {rounds} rounds")


# --- Whitening ----------------------------------------------------------

SCHEMA = ("vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
          "identity_error double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           grid: int = GRID, **options) -> DataFrame:
    """One row for each vector that takes part and each of the first ``components``:
    (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    rows = grid_vectors(vectors, id_col, vector_col, grid)
    n, sums = sums_of(rows)
    if not n:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    dim = len(sums)

    def product(u: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ u)
        return added(rows, part, u.shape) / n

    trace = added(rows, lambda x: (centred(x, n, sums) ** 2).sum(axis=0)[None], (1, dim)).sum() / n
    values, axes = largest_pairs(product, dim, components, **options)
    real = values > FLAT * max(values[0], 0.0)
    values, axes = values[real], axes[:, real]
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    onto = axes / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums) @ onto
        return np.hstack([z.T @ z, z.sum(axis=0)[:, None]])

    held = added(rows, spread, (k, k + 1)) / n
    error = float(np.abs(held[:, :k] - np.outer(held[:, k], held[:, k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = matrix(batch.column("x"))
                d = deviations(x, n, sums)
                most = n * int(np.abs(x).max()) + max(map(abs, sums))
                d2 = d * d if most * most * dim < 1 << 63 else d.astype(object) ** 2
                z = (d / n).astype(np.float64) @ onto
                squares = pa.array(d2.sum(axis=1)).cast(pa.string()) if d2.dtype != object else pa.array(map(str, d2.sum(axis=1)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k, np.int32)), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), squares, lists], names=["vec_id", "deviation", "z"])

    done = map_arrow(rows, run, "vec_id bigint, deviation string, z array<double>", ROWS)
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return done.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
