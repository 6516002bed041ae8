"""Whitening of embeddings by LOBPCG.

The covariance is never formed. Its products with blocks of a few columns are sums over the centred rows, added up
per task and then by dimension; a Rayleigh-Ritz step on the span of the iterate, its residuals and the previous
directions gives the next iterate. Guard columns beside the wanted ones keep close eigenvalues from slowing that
down. Iteration ends once fresh products certify the residuals of all wanted components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vestige.llm.common import staged, tidy

#: Components that are wanted, and further columns of the block.
COMPONENTS, GUARDS = 8, 8
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024.0, 100_000
#: A component is certified once its residual is at most this share of the largest eigenvalue.
TOLERANCE, ROUNDS = 1e-13, 500
_SAFE = 1 << 62


def integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows of integers) of the vectors of this length whose entries are all there, finite and in a long."""
    lengths = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    fits = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(fits)).flatten()
    c = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(fits), size)  # null: NaN
    scaled = np.floor(SCALE * c)
    with np.errstate(invalid="ignore"):
        whole = (np.abs(scaled) < 2.0**62).all(axis=1)
    return fits[whole], scaled[whole].astype(np.int64) + SHIFT


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, x): the vectors as integers; see whitened() for those that go."""
    vectors = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("x"))
    # A vector with nulls has no size here, and so hasn't an empty one.
    top = vectors.where("size(x) > 0 and not exists(x, c -> c is null)").groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = top[0].n if top else 0

    def each(batches):
        for b in batches:
            at, x = integers(b.column(1), size)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * size, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), lists], ["id", "x"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.where("size(x) > 0").mapInArrow(tidy(each), f"id {kind}, x array<bigint>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments(x: DataFrame) -> tuple[int, np.ndarray, int]:
    """n, the sums of each dimension, and the sum of all rows' (n*x - S)^2 over n, exactly, as Python's integers."""

    def each(batches):
        n, sums, squares = 0, 0, 0
        for b in batches:
            m = _matrix(b.column(1)).astype(object) if _largest(b.column(1)) >= 1 << 24 else _matrix(b.column(1))
            for at in range(0, len(m), 1 << 14):  # so many squares of 48 bits fit in a long
                part = m[at : at + (1 << 14)]
                n, sums, squares = n + len(part), sums + part.sum(axis=0).astype(object), squares + (part * part).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(sums)), pa.int32()), "n": [n] * len(sums), "s": list(map(str, sums)), "q": list(map(str, squares))})

    parts = x.mapInArrow(tidy(each), "dim int, n long, s string, q string")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), wide("s"), wide("q")).orderBy("dim").collect()
    if not rows:
        return 0, np.empty(0, object), 0
    n = rows[0].n
    return n, np.array([int(r.s) for r in rows], object), sum(n * int(r.q) - int(r.s) ** 2 for r in rows)


def _largest(column: pa.Array) -> int:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return max(abs(int(flat.max())), abs(int(flat.min()))) if len(flat) else 0


def centred(column: pa.Array, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S of each row, exactly: longs where those suffice, else Python's integers."""
    x = _matrix(column)
    if n * _largest(column) + max((abs(s) for s in sums), default=0) < _SAFE:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _product(x: DataFrame, n: int, sums: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The covariance times the block: a task sends one row a dimension to the sum."""
    d, k = block.shape

    def each(batches):
        total = np.zeros((d, k))
        for b in batches:
            c = (centred(b.column(1), n, sums) / n).astype(float)
            total += c.T @ (c @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), *[pa.array(total[:, i]) for i in range(k)]], ["dim", *[f"c{i}" for i in range(k)]])

    parts = x.mapInArrow(tidy(each), "dim int, " + ", ".join(f"c{i} double" for i in range(k)))
    rows = parts.groupBy("dim").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).orderBy("dim").collect()
    return np.array([r[1:] for r in rows]).reshape(d, k) / n


def _beside(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of new add to the orthonormal columns of old."""
    for _ in range(2):
        new = new - old @ (old.T @ new)
        norms = np.linalg.norm(new, axis=0)
        new = new[:, norms > 1e-150] / norms[norms > 1e-150]
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10 * s.max(initial=0)][:, : old.shape[0] - old.shape[1]]
    return new


def lobpcg(product, d: int, wanted: int, guards: int = GUARDS, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 13) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, largest residual) of the largest `wanted` eigenvalues of the
    symmetric operator product(block) of d dimensions. The residuals are those of fresh products. Where rounding
    keeps them above the tolerance, iteration ends once they no longer fall; above 1e4 tolerances that is an error."""
    size = min(d, wanted + guards)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
    vx, p, fresh, best, since = product(x), np.empty((d, 0)), True, math.inf, 0
    for _ in range(rounds):
        values, turn = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, vx = x @ turn, vx @ turn
        r = vx - x * values
        largest = max(values[0], 0.0)
        worst = float(np.linalg.norm(r[:, :wanted], axis=0).max(initial=0))
        since = 0 if worst < best / 2 else since + 1
        best = min(best, worst)
        done = worst <= tolerance * largest or (since >= 8 and worst <= 1e4 * tolerance * largest)
        if done and fresh:
            return values[:wanted], x[:, :wanted], worst
        if done:  # certify it
            x = np.linalg.qr(x)[0]
            vx, fresh, p = product(x), True, np.empty((d, 0))
            continue
        z = _beside(np.hstack((r, p)), x)
        if not z.shape[1]:
            x = np.linalg.qr(x)[0]
            vx, fresh, p = product(x), True, np.empty((d, 0))
            tolerance = max(tolerance, 1e4 * TOLERANCE)
            continue
        basis, image = np.hstack((x, z)), np.hstack((vx, product(z)))
        _, c = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        c = c[:, ::-1][:, :size]
        p = z @ c[size:]
        x, vx, fresh = basis @ c, image @ c, False
    raise RuntimeError(f"no certified components after {rounds} rounds: residual {worst}, largest eigenvalue {largest}")


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: the id, component, n, deviation, whitened, explained, identity_error.

    A vector goes that is null or empty, holds a null or non-finite entry or one whose integer doesn't fit in a long,
    or isn't as long as most are (of equally frequent lengths the longest counts). The others are all fitted, rows
    that repeat or have no id included. Components without variance (at most 1e-12 of the largest) can't be whitened
    and are left out; so a single vector, or equal ones, give no rows. A deviation beyond a long is null. Other
    columns aren't read."""
    x = staged(usable(vectors, id_column, vector_column))
    kind = x.schema["id"].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums, squares = _moments(x)
    trace = squares / n**2 if n else 0.0
    if not trace:
        return x.sparkSession.createDataFrame([], schema)
    d = len(sums)
    values, axes, _ = lobpcg(lambda block: _product(x, n, sums, block), d, min(components, d))
    there = values > 1e-12 * values[0]
    values, axes = values[there], axes[:, there]
    turn, k = axes / np.sqrt(values), len(values)

    def project(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        c = centred(column, n, sums)
        return c, (c / n).astype(float) @ turn

    def spread(batches):
        total, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = project(b.column(1))[1]
            total, second = total + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(total), *[pa.array(second[:, i]) for i in range(k)]], ["dim", "total", *[f"c{i}" for i in range(k)]])

    names = ["total", *[f"c{i}" for i in range(k)]]
    rows = x.mapInArrow(tidy(spread), "dim int, " + ", ".join(f"{c} double" for c in names)).groupBy("dim").agg(*[F.sum(c).alias(c) for c in names]).orderBy("dim").collect()
    mean, second = np.array([r.total for r in rows]) / n, np.array([r[2:] for r in rows]) / n
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())

    def each(batches):
        for b in batches:
            c, w = project(b.column(1))
            m = len(c)
            if m and c.dtype != object and max(abs(int(c.max())), abs(int(c.min()))) ** 2 * d < _SAFE:
                deviation = pa.array((c * c).sum(axis=1))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in c]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            again = pa.array(np.repeat(np.arange(m), k))
            columns = [b.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n, np.int64)), deviation.take(again), pa.array(w.reshape(-1)), pa.array(np.tile(values / trace, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(tidy(each), schema)
