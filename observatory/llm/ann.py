"""Nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids divide the vectors into lists. A vector's residual to its
centroid is stored as one byte for each of its parts, the nearest of 256 centroids
of that part. A query reads the lists nearest to it, scores their vectors from a
table of its inner products with all part centroids (asymmetric: the query itself
is not quantised), and ranks the best of them again by the original vectors.

What is stored besides, the norm of what the quantised vector leaves and the radius of
each list, bounds the true product from above (Cauchy-Schwarz). A query first reads the
lists nearest to it; its k-th best product there decides which other lists, and which
of their vectors, may hold a better one. All of those are compared, so that nothing
is missed whatever the vectors are; how well the centroids fit only sets the cost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from observatory.shared import cut

#: Vectors that the centroids are fitted on, at most: those whose id has the smallest hash.
SAMPLE = 20_000
#: Vectors that a list holds, about.
LIST_ROWS = 400
MOST_LISTS = 4096
#: Vectors that the lists which a query reads first hold together, at least.
PROBE_ROWS = 4000
#: Queries that are sent to all tasks at a time ...
QUERIES = 4096
#: ... of which a task looks at so many at once, with so many vectors.
RUN, STEP = 256, 4096
#: Vectors that one task compares, about.
TASK_ROWS = 1 << 18
#: Pairs whose exact products are made at once.
PAIRS = 1 << 14


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds; k rows, repeated if there are fewer distinct vectors."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        nearest = np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)
        count = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        full = count > 0
        centroids[full] = sums[full] / count[full, None]
    return np.resize(centroids, (k, x.shape[1])) if len(centroids) < k else centroids


@dataclass
class Quantiser:
    """Coarse centroids (lists x d) and, for each part of the dimensions, 256 centroids of residuals."""

    coarse: np.ndarray
    parts: list[np.ndarray]

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([p.shape[1] for p in self.parts])])

    def lists(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.coarse.T - 0.5 * (self.coarse**2).sum(axis=1), axis=1)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest, b = x - self.coarse[lists], self.bounds
        out = np.empty((len(x), len(self.parts)), dtype=np.uint8)
        for i, p in enumerate(self.parts):
            out[:, i] = np.argmax(rest[:, b[i] : b[i + 1]] @ p.T - 0.5 * (p**2).sum(axis=1), axis=1)
        return out

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that the codes stand for."""
        return np.concatenate([p[codes[:, i]] for i, p in enumerate(self.parts)], axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with the part centroids: queries x parts x 256."""
        b = self.bounds
        return np.stack([queries[:, b[i] : b[i + 1]] @ p.T for i, p in enumerate(self.parts)], axis=1)


def fit(sample: np.ndarray, lists: int, parts: int) -> Quantiser:
    coarse = _kmeans(sample, lists, 8, 1)
    q = Quantiser(coarse, [])
    rest = sample - coarse[q.lists(sample)]
    cuts = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
    for i, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
        q.parts.append(_kmeans(rest[:, low:high].copy(), 256, 6, 2 + i))
    return q


def usable(vector: str) -> Column:
    """Not null or zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)


def nearest(
    df: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, probe_rows: int = PROBE_ROWS,
    most_lists: int = MOST_LISTS, exact: bool = False, queries: int = QUERIES,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k vectors of largest inner product with each query vector.

    ``query`` is true for the rows that are queries; a query's own id is no
    neighbour of it. Products are of doubles. Ties go to the smaller id. Vectors
    that are null, zero or hold null or non-finite components, and rows with null
    ids, take no part, nor do vectors of another length than most; rows that repeat
    an id count once, by their smallest vector. The centroids are fitted on at most
    ``sample`` vectors; all are indexed, in at most ``most_lists`` lists. A query first
    reads its nearest lists, so many that they hold ``probe_rows`` vectors and k others,
    then all others that may hold a better one by their bounds; none is missed. ``exact``
    compares every query with every vector, without bounds. Vectors may be of any scale
    whose products are finite. An empty table gives no rows; other columns are ignored.

    Queries go to all tasks in batches of about ``queries``; a task keeps the k best of
    each query over all it reads, so the index is written once and never shuffled again.
    """
    spark = df.sparkSession
    rows = df.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("q"))
    schema = "query_id long, rank int, vec_id long, score double"
    widths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    dims, total, most = widths[0]
    # products are of vectors divided by powers of two near their largest component, which takes no bit off them
    power = int(np.frexp(most)[1])
    rows = rows.where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    taken = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    x = np.ldexp(_matrix(taken.column(0).combine_chunks(), dims), -power)
    n_lists = int(max(1, min(most_lists, total // LIST_ROWS, len(x) // 4)))
    q = fit(x, n_lists, dims // 2 if dims % 2 == 0 else dims)
    index = spark.sparkContext.broadcast(q)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = index.value
        for b in batches:
            x = np.ldexp(_matrix(b.column(1), dims), -power)
            lists = q.lists(x) if len(x) else np.zeros(0, np.int64)
            codes = q.codes(x, lists)
            far, off = _errors(q, x, lists, codes)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists.astype(np.int32)), packed, pa.array(far), pa.array(off)], names=["id", "v", "q", "list", "codes", "far", "off"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    placed = rows.mapInArrow(assign, "id long, v array<double>, q boolean, list int, codes binary, far double, off double")
    # a task has its share of every list, however large that is
    entries = cut(placed.sortWithinPartitions("list", "id"), "index")
    # two numbers for each list
    held, radius = np.zeros(n_lists, dtype=np.int64), np.zeros(n_lists)
    for r in entries.groupBy("list").agg(F.count("*"), F.max("far")).collect():
        held[r[0]], radius[r[0]] = r[1], r[2]
    scanned = entries.select("id", "list", "v", "codes", "off").coalesce(tasks)

    def scan(asked: _Asked) -> DataFrame:
        shared = spark.sparkContext.broadcast(asked)
        best = scanned.mapInArrow(lambda batches: _scan(batches, index.value, shared.value, dims, power, k, exact), "query_id long, vec_id long, score double, s double")
        # each task has given the k best of its own rows
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return best.where(F.col("rank") <= k)

    batches = max(1, -(-entries.where("q").count() // queries))
    found = []
    for number in range(batches):
        own = entries.where("q").where(F.pmod(F.xxhash64("id"), F.lit(batches)) == number).select("id", "v").orderBy("id").toArrow()
        if not own.num_rows:
            continue
        # a batch's ids and vectors, of a fixed number at any size of the table
        asked = _Asked(own["id"].to_numpy(), _matrix(own["v"].combine_chunks(), dims))
        if exact:
            found.append(scan(asked))
            continue
        asked.probe(q, held, max(probe_rows, k + 1))
        first = cut(scan(asked), "probed")
        found.append(first)
        # one number for each query of the batch that has k neighbours by now
        known = first.where(F.col("rank") == k).select("query_id", "s").toArrow()
        asked.narrow(q, held, radius, known["query_id"].to_numpy(), known["s"].to_numpy())
        if asked.reads.any():
            found.append(scan(asked))
    if not found:
        return spark.createDataFrame([], schema)
    near = reduce(DataFrame.unionAll, found)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _errors(q: Quantiser, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance from the list's centroid, from the quantised vector), both rounded up.

    The second holds what sums of 24 bits may be off besides: half a unit in each term
    and step, four times that to be safe, and what is too small for them.
    """
    centre, rest = q.coarse[lists], q.decoded(codes)
    size = np.linalg.norm(centre, axis=1) + np.linalg.norm(rest, axis=1)
    far = np.linalg.norm(x - centre, axis=1) * (1 + 1e-9) + size * 1e-12
    off = np.linalg.norm(x - centre - rest, axis=1) * (1 + 1e-6) + size * (len(q.parts) + 8) * 2.0**-22 + 1e-36
    return far, off


class _Asked:
    """A batch of queries, each divided by a power of two near its largest component, and the lists that they read."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids = ids
        self.power = np.frexp(np.abs(x).max(axis=1))[1]
        self.x = np.ldexp(x, -self.power[:, None])
        self.norms = np.linalg.norm(self.x, axis=1) * (1 + 1e-6)
        #: the product that a vector has to reach
        self.least = np.full(len(ids), -np.inf)
        #: lists x queries
        self.reads = np.zeros((0, len(ids)), dtype=bool)

    def probe(self, q: Quantiser, held: np.ndarray, enough: int) -> None:
        """The nearest lists."""
        self.reads = np.zeros((len(held), len(self.ids)), dtype=bool)
        for i, o in enumerate(np.argsort(-(self.x @ q.coarse.T), axis=1, kind="stable")):
            self.reads[o[: int(np.searchsorted(np.cumsum(held[o]), enough)) + 1], i] = True

    def narrow(self, q: Quantiser, held: np.ndarray, radius: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Those lists, of the ones not read so far, whose vectors may reach ``s``, the product of the last neighbour of ``ids``."""
        self.least[np.searchsorted(self.ids, ids)] = s
        highest = q.coarse @ self.x.T + radius[:, None] * self.norms
        self.reads = ~self.reads & (held > 0)[:, None] & (highest >= self.least)


#: A run of queries that reads this share of all lists or more is scored against all rows at once, and what it doesn't read is left out after that.
DENSE = 0.25


def _scan(batches: Iterable[pa.RecordBatch], q: Quantiser, asked: _Asked, dims: int, power: int, k: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """(query, id, score, scaled score): the k best of each query among a task's vectors."""
    runs = [(slice(low, low + RUN), _Best(k, asked.least[low : low + RUN])) for low in range(0, len(asked.ids), RUN)]
    for b in batches:
        for start in range(0, b.num_rows, STEP):
            part = b.slice(start, STEP)
            ids, lists, off = (part.column(c).to_numpy() for c in (0, 1, 4))
            rows = np.ldexp(_matrix(part.column(2), dims), -power)
            codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
            for at, best in runs:
                if exact:
                    pairs = [np.divmod(np.arange(len(ids) * len(asked.ids[at])), len(asked.ids[at]))]
                else:
                    pairs = _may_be(q, asked.x[at], asked.norms[at], asked.reads[:, at], lists, codes, off, best)
                for row, query in pairs:
                    for cut_at in range(0, len(row), PAIRS):
                        i, j = row[cut_at : cut_at + PAIRS], query[cut_at : cut_at + PAIRS]
                        other = ids[i] != asked.ids[at][j]
                        i, j = i[other], j[other]
                        best.add(j, ids[i], np.einsum("ij,ij->i", rows[i], asked.x[at][j]))
                best.settle()
    for at, best in runs:
        score = np.ldexp(best.s, power + asked.power[at][best.query])
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[at][best.query]), pa.array(best.id), pa.array(score), pa.array(best.s)], names=["query_id", "vec_id", "score", "s"])


def _may_be(q: Quantiser, x: np.ndarray, norms: np.ndarray, reads: np.ndarray, lists: np.ndarray, codes: np.ndarray, off: np.ndarray, best: _Best) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, queries) of those pairs whose product may be among the best, by the lists read and the bounds."""
    present, of_row = np.unique(lists, return_inverse=True)
    if not reads[present].any():
        return
    tables = q.tables(x).transpose(1, 2, 0).astype(np.float32)  # parts x 256 x queries
    base = (q.coarse[present] @ x.T).astype(np.float32)
    if reads[present].mean() >= DENSE:
        s = base[of_row]
        for i in range(codes.shape[1]):
            s += np.take(tables[i], codes[:, i], axis=0)
        read = reads[lists]
        yield np.nonzero(read & best.reach(s, off, norms, np.arange(len(x)), read))
        return
    for n, one in enumerate(present):
        of = np.flatnonzero(reads[one])
        if len(of):
            at = np.flatnonzero(of_row == n)
            s = np.tile(base[n, of], (len(at), 1))
            for i in range(codes.shape[1]):
                s += np.take(tables[i][:, of], codes[at, i], axis=0)
            row, column = np.nonzero(best.reach(s, off[at], norms[of], of, None))
            yield at[row], of[column]


class _Best:
    """The ``keep`` largest scores of each query so far, of equal ones those of the smallest ids."""

    def __init__(self, keep: int, least: np.ndarray) -> None:
        self.keep, self.bound = keep, least.copy()
        self.query, self.id, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reach(self, s: np.ndarray, off: np.ndarray, norms: np.ndarray, queries: np.ndarray, read: np.ndarray | None) -> np.ndarray:
        """Where scores (rows x queries), right to within ``off`` times ``norms``, may reach the bounds."""
        width = off.astype(np.float32)[:, None] * norms.astype(np.float32)
        hit = s + width >= np.nextafter(self.bound[queries].astype(np.float32), np.float32(-np.inf))
        # one more than kept: the query itself may be among the rows
        place = len(s) - self.keep - 1
        if place >= 0 and np.count_nonzero(hit) > 4 * self.keep * len(queries):
            sure = s - width
            if read is not None:
                sure[~read] = -np.inf
            sure = np.partition(np.ascontiguousarray(sure.T), place, axis=1)[:, place]
            self.bound[queries] = np.maximum(self.bound[queries], np.nextafter(sure, np.float32(-np.inf)))
            hit = s + width >= np.nextafter(self.bound[queries].astype(np.float32), np.float32(-np.inf))
        return hit

    def add(self, queries: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        self.new.append((queries, ids, s))
        if sum(len(n[0]) for n in self.new) > max(100_000, 2 * len(self.s)):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        query, i, s = (np.concatenate([old, *(n[c] for n in self.new)]) for c, old in enumerate((self.query, self.id, self.s)))
        order = np.lexsort((i, -s, query))
        query = query[order]
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        order, full = order[place < self.keep], order[place == self.keep - 1]
        last = query[place == self.keep - 1]
        self.bound[last] = np.maximum(self.bound[last], s[full])
        self.query, self.id, self.s = query[place < self.keep], i[order], s[order]
        self.new = []
