"""Whitening of embeddings by a covariance of two passes.

Exact integer sums give the mean, a second pass sums centred outer products, merged
over the executors; the eigenvectors of that matrix are computed once and sent to all.
A third pass measures how far the whitened vectors are from uncorrelated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components that are returned.
COMPONENTS = 8
#: Entries become floor(SCALE * c) + SHIFT ...
SCALE, SHIFT = 1024.0, 100_000
#: ... which are exact as doubles for entries below this size.
MOST = 2.0**52 / SCALE - SHIFT
#: Vectors that one product takes.
STEP = 4096


def whole(vector: str, most: float = MOST) -> Column:
    """Not null, with entries that all are finite numbers below ``most`` in size."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < most), F.lit(False)))


def integers(column: pa.Array, dims: int) -> np.ndarray:
    c = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _steps(batches: Iterable[pa.RecordBatch], at: int, dims: int) -> Iterator[np.ndarray]:
    for b in batches:
        for low in range(0, b.num_rows, STEP):
            yield integers(b.column(at).slice(low, STEP), dims)


@dataclass
class Whitening:
    """n vectors, their exact sums, and the leading components: directions (d x k), eigenvalues, trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once: the integer part of the mean is taken off exactly."""
        quotient = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - quotient).astype(np.float64) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components; NaN for those along which nothing varies."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.eigenvalues > 0, self.centred(x) @ self.directions / np.sqrt(self.eigenvalues), np.nan)

    def deviation(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sum over dimensions of (n * x - S)**2, exactly."""
        quotient = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n for s in self.sums], dtype=object)
        near = x - quotient
        most = int(np.abs(near).max(initial=0)) + 1
        if self.n * most < 2**31 and x.shape[1] * (self.n * most) ** 2 < 2**63:
            return ((self.n * near - rest.astype(np.int64)) ** 2).sum(axis=1)
        wide = self.n * near.astype(object) - rest
        return (wide**2).sum(axis=1).tolist()


def _merge_tree(parts: DataFrame, zero: tuple, merge) -> tuple:
    """One tuple of all partitions' tuples, merged by executors in levels; the driver gets the last few."""
    return parts.rdd.map(lambda r: tuple(r)).treeAggregate(zero, merge, merge, depth=3)


def exact_sums(rows: DataFrame, vector_col: str, dims: int) -> tuple[int, list[int]]:
    """(n, sums of the integer vectors), without rounding or overflow at any size."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for x in _steps(batches, 0, dims):
            n += len(x)
            # halves of 32 bits can't overflow within a step
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["n", "sums"])

    def merge(a: tuple, b: tuple) -> tuple:
        return (a[0] + b[0], [str(int(x) + int(y)) for x, y in zip(a[1], b[1])])

    n, sums = _merge_tree(rows.select(vector_col).mapInArrow(partial, "n long, sums array<string>"), (0, ["0"] * dims), merge)
    return n, [int(s) for s in sums]


def covariance(rows: DataFrame, vector_col: str, dims: int, make, out: int) -> np.ndarray:
    """Covariance, divisor n, of ``make(integer vectors)``, which has ``out`` columns; each partition is centred before multiplying.

    Partitions give (count, mean, centred products), which merge without
    cancellation, so the covariance is exact to rounding wherever the data lie.
    """

    def fold(a: tuple, b: tuple) -> tuple:
        if not a[0] or not b[0]:
            return a if a[0] else b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (0, np.zeros(out), np.zeros((out, out)))
        for x in _steps(batches, 0, dims):
            y = make(x)
            mean = y.mean(axis=0)
            state = fold(state, (len(y), mean, (y - mean).T @ (y - mean)))
        yield pa.RecordBatch.from_arrays([pa.array([state[0]], pa.int64()), pa.array([state[1].tobytes()], pa.binary()), pa.array([state[2].tobytes()], pa.binary())], names=["n", "mean", "products"])

    def read(t: tuple) -> tuple:
        return t[0], np.frombuffer(t[1]), np.frombuffer(t[2]).reshape(out, out)

    def merge(a: tuple, b: tuple) -> tuple:
        n, mean, products = fold(read(a), read(b))
        return n, mean.tobytes(), products.tobytes()

    parts = rows.select(vector_col).mapInArrow(partial, "n long, mean binary, products binary")
    zero = (0, np.zeros(out).tobytes(), np.zeros((out, out)).tobytes())
    n, _, products = read(_merge_tree(parts, zero, merge))
    return products / max(n, 1)


def fit(rows: DataFrame, vector_col: str, dims: int, components: int = COMPONENTS) -> Whitening:
    n, sums = exact_sums(rows, vector_col, dims)
    start = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0)
    shared = rows.sparkSession.sparkContext.broadcast(start)
    v = covariance(rows, vector_col, dims, lambda x: shared.value.centred(x), dims)
    v = (v + v.T) / 2
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, trace = values[order], float(np.trace(v))
    # what rounding leaves of directions along which nothing varies isn't variance
    values = np.where(values > trace * dims * np.finfo(np.float64).eps, values, 0.0)
    return Whitening(n, sums, vectors[:, order], values, trace)


def width(df: DataFrame, vector_col: str) -> int | None:
    """The length that most vectors have, of equally frequent ones the smallest; None without vectors."""
    most = df.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return most[0][0] if most else None


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error), one for each vector and leading component.

    Vectors that are null or hold null or non-finite entries take no part, nor do
    those with an entry of 2**52 / 1024 or more in size, which no exact integer stands
    for, or of another length than most. Each row counts, also those that repeat an id
    or have none. ``deviation`` is a decimal, null where it has more than 38 digits.
    With fewer dimensions than ``components`` there are as many components as
    dimensions; along a component without variance ``whitened`` is null and
    ``explained`` 0, and ``identity_error`` is that of the others (null if there are
    none). An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    schema = f"{id_col} long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = df.where(whole(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    dims = width(rows, "v")
    if not dims:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == dims)
    model = fit(rows, "v", dims, components)
    shared = spark.sparkContext.broadcast(model)
    varies = np.flatnonzero(model.eigenvalues > 0)
    error = None
    if len(varies):
        w = covariance(rows, "v", dims, lambda x: shared.value.project(x)[:, varies], len(varies))
        error = float(np.abs(w - np.eye(len(varies))).max())
    kept = len(model.eigenvalues)
    explained = (model.eigenvalues / model.trace if model.trace > 0 else np.zeros(kept)).tolist()

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for low in range(0, b.num_rows, STEP):
                ids = b.column(0).slice(low, STEP)
                x = integers(b.column(1).slice(low, STEP), dims)
                w = model.project(x).ravel()
                exact = [d if d < 10**38 else None for d in map(int, model.deviation(x))]
                each = np.repeat(np.arange(len(x)), kept)
                deviation = pa.array(exact, pa.decimal128(38, 0)).take(pa.array(each))
                component = np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))
                columns = [ids.take(pa.array(each)), pa.array(component), pa.array(np.full(len(each), model.n)), deviation, pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, len(x))), pa.array([error] * len(each), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema.replace(f"{id_col} long", "id long", 1)).withColumnRenamed("id", id_col)
