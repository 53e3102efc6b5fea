"""Hard negatives by product quantisation with stored residual norms.

Each vector is stored as one byte for each of its parts, the nearest centroid of that
part, and the norm of what that leaves. An anchor's product with a stored vector is a
sum from its lookup table, right to within the anchor's norm times the residual's
(Cauchy-Schwarz), so that the sum plus and minus this bound holds the score for certain.
Vectors that cannot be among the first of a window by these bounds are let go; the rest
get their exact integer product. A batch of anchors is sent to all tasks, and a task
keeps only the first few of each window over all vectors it reads: neither the index
nor pairs are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from observatory.llm import ann
from observatory.shared import cut

#: Vectors become floor(SCALE * x).
SCALE = 256.0
#: Vectors that the part centroids are fitted on, at most: those whose id has the smallest hash. Bounds hold whatever they are.
SAMPLE = 20_000
#: Anchors that are sent to all tasks at a time ...
ANCHORS = 4096
#: ... of which a task looks at so many at once, with so many vectors.
RUN, STEP = 128, 4096
#: Vectors that one task compares, about.
TASK_ROWS = 1 << 18
#: Pairs whose exact products are made at once.
PAIRS = 1 << 16


def usable(vector: str, most: float) -> Column:
    """Not null, with entries that all are finite numbers below ``most`` in size."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < most), F.lit(False)))


def integers(column: pa.Array, dims: int) -> np.ndarray:
    return np.floor(SCALE * np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)).astype(np.int64)


class _Windows:
    """The windows of a run of anchors and the best rows of each so far."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int) -> None:
        self.anchor, self.low, self.high, self.keep = anchor, low, high, keep
        #: the exact score that a row has to reach
        self.least = low.copy()
        self.window, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, window: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        fits = (self.low[window] <= score) & (score <= self.high[window])
        window, ids, score = (np.concatenate([old, new[fits]]) for old, new in ((self.window, window), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, window))
        window = window[order]
        begin = np.flatnonzero(np.diff(window, prepend=-1))
        place = np.arange(len(window)) - np.repeat(begin, np.diff(np.append(begin, len(window))))
        first = place < self.keep
        self.window, self.id, self.score = window[first], ids[order][first], score[order][first]
        full = place == self.keep - 1
        self.least[window[full]] = np.maximum(self.least[window[full]], score[order][full])


def _upper_bounds(q: ann.Quantiser, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lookup tables parts x 256 x anchors, product with the centre, norms, rounding error) of float32 sums."""
    tables = q.tables(anchors).transpose(1, 2, 0)
    base = anchors @ q.coarse[0]
    size = np.abs(tables).max(axis=1).sum(axis=0) + np.abs(base)
    # each of the sums' terms and steps is off by half a unit of 24 bits at most; four times that to be safe
    off = size * (len(q.parts) + 4) * 2.0**-22
    return tables.astype(np.float32), base.astype(np.float32), np.linalg.norm(anchors, axis=1) * (1 + 1e-6), off


def _scan(batches: Iterable[pa.RecordBatch], q: ann.Quantiser, dims: int, asked: dict[str, np.ndarray], same: bool, keep: int) -> Iterator[pa.RecordBatch]:
    """(window, id, score): the first rows of each window among a task's vectors."""
    runs = []
    for low in range(0, len(asked["id"]), RUN):
        at = slice(low, low + RUN)
        mine = np.flatnonzero((asked["of"] >= low) & (asked["of"] < low + RUN))
        if not len(mine):
            continue
        x = asked["x"][at]
        runs.append((at, x, mine, _Windows(asked["of"][mine] - low, asked["low"][mine], asked["high"][mine], keep)))
    for b in batches:
        for start in range(0, b.num_rows, STEP):
            part = b.slice(start, STEP)
            ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
            v = np.asarray(part.column(2).flatten()).reshape(-1, dims)
            codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
            norms = part.column(4).to_numpy()
            for at, x, mine, windows in runs:
                tables, base, size, off = _upper_bounds(q, x.astype(np.float64))
                labels_of, id_of = asked["label"][at], asked["id"][at]
                rows = np.flatnonzero(np.isin(labels, labels_of)) if same else np.arange(len(ids))
                s = np.tile(base, (len(rows), 1))
                for i in range(codes.shape[1]):
                    s += np.take(tables[i], codes[rows, i], axis=0)
                s = s.astype(np.float64)
                width = norms[rows][:, None] * size + off
                fits = labels[rows][:, None] == labels_of
                fits = fits & (ids[rows][:, None] != id_of) if same else ~fits
                top, bottom = s + width, s - width
                pairs = []
                for w in range(len(mine)):
                    j = windows.anchor[w]
                    up, down, ok = top[:, j], bottom[:, j], fits[:, j]
                    # rows that lie in the window for certain: the keep-th best of their lower bounds is a bound for all
                    sure = down[ok & (down >= windows.low[w]) & (up <= windows.high[w])]
                    least = windows.least[w]
                    if len(sure) >= keep:
                        least = max(least, np.partition(sure, len(sure) - keep)[len(sure) - keep])
                    hit = np.flatnonzero(ok & (up >= least) & (down <= windows.high[w]))
                    pairs.append((np.full(len(hit), w), rows[hit], np.full(len(hit), j)))
                if not pairs:
                    continue
                window, row, anchor = (np.concatenate(p) for p in zip(*pairs))
                for cut_at in range(0, len(row), PAIRS):
                    k = slice(cut_at, cut_at + PAIRS)
                    exact = np.einsum("ij,ij->i", v[row[k]], x[anchor[k]])
                    windows.add(window[k], ids[row[k]], exact)
    for _, _, mine, windows in runs:
        yield pa.RecordBatch.from_arrays([pa.array(mine[windows.window]), pa.array(windows.id), pa.array(windows.score)], names=["window", "id", "score"])


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), sample: int = SAMPLE, anchors: int = ANCHORS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the integer product of two vectors floor(256 * x). An anchor's positives
    are the first ``positives`` other rows of its label, a positive's negatives the
    first ``negatives`` rows of other labels with a score of ``percent`` [low, high] of
    the positive's, both by score, then by smaller id. All rows are compared, exactly.

    Rows with a null id, label, vector or a null or non-finite component take no part,
    nor do vectors of another length than most, or with a component so large that a
    score might not fit a long (about 1.5e9 / 256 / sqrt(length) and more). Rows that
    repeat an id count once, by their smallest label and vector. A positive without
    negatives has no rows; an empty table gives none. Other columns are ignored.
    """
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("a"))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not most or not most[0][0]:
        return spark.createDataFrame([], schema)
    dims = most[0][0]
    rows = rows.where((F.size("v") == dims) & usable("v", (math.isqrt((2**61) // dims) - 1) / SCALE))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("m"), F.max("a").alias("a")).select("id", "m.label", "m.v", "a")
    taken = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column(0).combine_chunks()
    if not len(taken):
        return spark.createDataFrame([], schema)
    fitted = spark.sparkContext.broadcast(ann.fit(integers(taken, dims).astype(np.float64), 1, dims // 2 if dims % 2 == 0 else dims))

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = fitted.value
        for b in batches:
            x = integers(b.column(2), dims)
            lists = np.zeros(len(x), dtype=np.int64)
            codes = q.codes(x.astype(np.float64), lists)
            near = q.coarse[lists] + np.concatenate([p[codes[:, i]] for i, p in enumerate(q.parts)], axis=1)
            # rounded up, so that it bounds the residual for certain
            norms = np.linalg.norm(x - near, axis=1) * (1 + 1e-9) + 1e-9
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vectors, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), b.column(3)], names=["id", "label", "x", "codes", "norm", "a"])

    index = cut(rows.mapInArrow(store, "id long, label long, x array<long>, codes binary, norm double, a boolean"), "negatives")
    counts = index.agg(F.count("*").alias("n"), F.count_if("a").alias("a")).first()
    if not counts.a:
        return spark.createDataFrame([], schema)
    tasks = max(spark.sparkContext.defaultParallelism, -(-counts.n // TASK_ROWS))
    scanned = index.select("id", "label", "x", "codes", "norm").coalesce(tasks)
    batches = -(-counts.a // anchors)
    batch_of = F.pmod(F.xxhash64("id"), F.lit(batches))
    found = []
    for number in range(batches):
        # a batch of anchors, about ``anchors`` of them, whatever the table's size
        asked = index.where("a").where(batch_of == number).select("id", "label", "x").orderBy("id").toArrow()
        if not asked.num_rows:
            continue
        own = {"id": asked["id"].to_numpy(), "label": asked["label"].to_numpy(), "x": np.asarray(asked["x"].combine_chunks().flatten()).reshape(-1, dims)}
        found.append(_of_batch(scanned, fitted, dims, own, positives, negatives, percent))
    out = reduce(DataFrame.unionAll, found)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _of_batch(scanned: DataFrame, fitted, dims: int, own: dict[str, np.ndarray], positives: int, negatives: int, percent: tuple[int, int]) -> DataFrame:
    spark = scanned.sparkSession

    def first(asked: dict[str, np.ndarray], same: bool, keep: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(asked)
        best = scanned.mapInArrow(lambda batches: _scan(batches, fitted.value, dims, shared.value, same, keep), "window long, id long, score long")
        # each task has given the first ``keep`` of its own rows
        place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "id"))
        return best.withColumn("place", place).where(F.col("place") <= keep)

    n = len(own["id"])
    widest = np.full(n, 2**62)
    near = first(own | {"of": np.arange(n), "low": -widest, "high": widest}, True, positives).orderBy("window", "place").toArrow()
    anchor, positive, score = (near[c].to_numpy() for c in ("window", "id", "score"))
    low = np.array([-(-percent[0] * int(s) // 100) for s in score], dtype=np.int64)
    high = np.array([percent[1] * int(s) // 100 for s in score], dtype=np.int64)
    # equal scores of an anchor's positives have one window
    windows, which = np.unique(np.stack([anchor, low, high, score], axis=1), axis=0, return_inverse=True)
    open_ = windows[:, 1] <= windows[:, 2] if len(windows) else np.zeros(0, bool)
    number = np.cumsum(open_) - 1
    asked = own | {"of": windows[open_, 0], "low": windows[open_, 1], "high": windows[open_, 2]}
    lost = first(asked, False, negatives)
    which = which.ravel()
    pairs = [(int(number[w]), int(own["id"][a]), int(p), int(s)) for w, a, p, s in zip(which, anchor, positive, score) if open_[w]]
    links = spark.createDataFrame(pairs, "window long, anchor_id long, positive_id long, positive_score long")
    return lost.join(F.broadcast(links), "window").select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
