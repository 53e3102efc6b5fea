"""Near-duplicates by circulant MinHash, banding and exact verification.

One permutation scatters the shingles over a ring of positions; a second one, read
at every shift of the ring, gives all coordinates of the signature. Signatures are
cut into bands; texts that share a band are candidates, and a link stands only if
the full shingle sets say so.

Equal sets are one representative. Each representative is compared with one pivot of
each of its buckets, the member that shares buckets with most others, so a group of
copies costs as many comparisons as it has members and becomes one component. A
bucket whose other members are all of one component has nothing more to tell, nor
have those of sizes too far apart. Members of the other buckets meet again in their shingles, rarest first: two sets as alike as
asked for share one within the first few of either, and only such pairs of different
components are compared. Of each shingle's holders those of the largest component
meet the others, not each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from observatory.llm.arrow import filled, let_go, passes, utf8
from observatory.llm.filters import bitmap
from observatory.llm.shingles import mix, shingles
from observatory.operators.components import connected_components
from observatory.shared import cut

COORDINATES = 128
ROWS = 4
#: Positions of the ring.
RING = 1 << 20
#: Pairs with one text that one task verifies.
PAIRS = 500
_ring: list[np.ndarray] = []


def _shifts() -> np.ndarray:
    """Row p: the second permutation's values at p, p + 1, ... (a view)."""
    if not _ring:
        values = np.random.default_rng(7919).permutation(RING).astype(np.uint32)
        _ring.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:COORDINATES]]), COORDINATES))
    return _ring[0]


def signatures(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of COORDINATES minima; rows of empty sets are all ones."""
    shifts = _shifts()
    at = (mix(found + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)
    out = np.full((len(bounds) - 1, COORDINATES), np.uint32(0xFFFFFFFF), dtype=np.uint32)
    for i in range(len(out)):
        for low in range(bounds[i], bounds[i + 1], 4096):
            np.minimum(out[i], shifts[at[low : min(low + 4096, bounds[i + 1])]].min(axis=0), out=out[i])
    return out


_BAND = np.random.default_rng(104729).integers(1, 2**63, (COORDINATES // ROWS, ROWS + 1), dtype=np.uint64)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    parts = signature.reshape(len(signature), COORDINATES // ROWS, ROWS).astype(np.uint64) + np.uint64(1)
    return mix((mix(parts * _BAND[:, :ROWS]) * (_BAND[:, :ROWS] | np.uint64(1))).sum(axis=2) + _BAND[:, ROWS]).view(np.int64)


def _totals(found: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found ^ np.uint64(salt)), dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, s1, s2, bands): set size, 128 bits of the set, band keys.

    s1 and s2 are null for empty sets.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            texts = filled(b.column(1))
            for low, high in passes(texts):
                found, bounds = shingles(*utf8(texts.slice(low, high - low)))
                n = np.diff(bounds)
                signature = signatures(found, bounds)
                keys = bands(signature)
                none = n == 0
                offsets = pa.array(np.arange(high - low + 1, dtype=np.int32) * keys.shape[1])
                listed = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(low, high - low), pa.array(n, pa.int64()), *(pa.array(_totals(found, bounds, salt), mask=none) for salt in (0x2545F4914F6CDD1D, 0x6C8E9CF570932BD5)), listed],
                    names=["id", "n", "s1", "s2", "bands"],
                )

    return df.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n long, s1 long, s2 long, bands array<long>")


def shingle_sets(df: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, mark, shingles array) of the texts whose id is in ``ids`` (column id).

    A bitmap of the ids goes to all workers and spares most other texts; a join
    then takes out the rest. mark tells an id's sets apart; equal ones are one row.
    """
    hashed = F.xxhash64("id")
    may_be = bitmap(ids.select(hashed.alias("h")), "h")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            keep = pa.array(may_be(b.column(2).to_numpy(zero_copy_only=False)))
            texts, ids = filled(b.column(1).filter(keep)), b.column(0).filter(keep)
            for low, high in passes(texts):
                found, bounds = shingles(*utf8(texts.slice(low, high - low)))
                listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(_totals(found, bounds, 0x2545F4914F6CDD1D)), listed], names=["id", "mark", "shingles"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", hashed)
    return rows.mapInArrow(run, "id long, mark long, shingles array<long>").join(ids, "id", "left_semi").dropDuplicates(["id", "mark"])


def _alike_in_size(x: str, y: str, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those rows (a, b) of ``pairs`` (a, b, n: pairs that b is in) whose sets are as alike as asked for.

    A set in many pairs is sent to as many tasks as it has blocks of PAIRS pairs.
    """
    pairs = pairs.select("a", "b", F.ceil(F.col("n") / PAIRS).cast("int").alias("slots")).withColumn("slot", F.pmod(F.xxhash64("a"), "slots").cast("int"))
    right = pairs.select("b", "slots", "slot").distinct().join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a").join(right, ["b", "slots", "slot"])
    shared = F.size(F.array_intersect("left", "right"))
    return both.where(shared * 100 >= (F.size("left") + F.size("right") - shared) * percent).select("a", "b")


def _rare_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that hold all pairs of ``percent`` alike; ``labels`` is (rep, component, members).

    Two sets of sizes x >= y that are alike share ``percent / (100 + percent)`` of
    x + y. So of any one order of shingles, the first one shared stands so early in
    both that this many are left from there on, and y is not too small. The order is
    by number of holders. Shingles whose holders are of one component can't be
    shared by others; they come first and only count.
    """
    size = F.size("shingles").cast("long")
    held = sets.join(labels.withColumnRenamed("rep", "id"), "id").select("id", "mark", "component", "members", size.alias("size"), F.explode("shingles").alias("shingle"))
    shared = held.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"), F.max_by("component", "members").alias("major")).where("x <> y")
    shared = cut(shared.select("shingle", "n", "major"), "shared")
    # a set of which fewer shingles are shared than the smallest partner asks for has no partner
    may_be = held.join(shared, "shingle").select("id", "mark", "component", "size", "shingle", "n", "major")
    of_set = Window.partitionBy("id", "mark")
    count = F.count("*").over(of_set)
    place = F.col("size") - count + F.row_number().over(of_set.orderBy("n", "shingle")) - 1
    placed = may_be.withColumn("place", place).withColumn("count", count).where(F.col("count") * 100 >= F.col("size") * percent)
    # of the smallest partner's shingles and of those of one as large: how many places come into question
    probe = F.col("size") - F.ceil(F.col("size") * percent / 100)
    placed = cut(placed.where(F.col("place") <= probe).select("id", "component", "size", "shingle", "place", F.col("component").eqNullSafe(F.col("major")).alias("usual")), "rare")
    seek, hold = (placed.select("shingle", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "component", "size", "place", "usual"))) for side in ("x", "y"))
    left = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place"))
    fits = (left * (100 + percent) >= (F.col("x_size") + F.col("y_size")) * percent) & _alike_in_size("x_size", "y_size", percent)
    met = seek.where("not x_usual").join(hold, "shingle").where((F.col("x_component") != F.col("y_component")) & (F.col("y_usual") | (F.col("x_id") < F.col("y_id"))) & fits)
    return met.select(F.greatest("x_id", "y_id").alias("a"), F.least("x_id", "y_id").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, exhaustive: bool = False) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept): one for each row of ``df``.

    Links texts with 100 * shared >= percent * united distinct 5-word shingles;
    component_id is the smallest id reachable by links, itself included; kept is
    whether that is the row's own id. A text without words, or a null one, has the
    empty set and no links. A row with a null id cannot be named: its component_id
    is null and it is kept. Rows that repeat an id are one document; it links where
    any of its texts does. Other columns of ``df`` are ignored, an empty table gives
    no rows. A pair at the bound of 0.75 shares no band with probability 5e-6 (less,
    the more alike); with ``exhaustive`` all texts, not only those that share bands,
    meet in their shingles, and none is missed.
    """
    sketch = cut(sketches(df, id_col, text_col), "sketches")
    named = sketch.where("id is not null and s1 is not null")
    heads = cut(named.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "bands"))), "heads")
    equal = heads.select("s1", "s2", "rep")
    keyed = heads.select("rep", "n", "copies", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(keyed.join(shared, "key").select("key", "rep", "n", "copies", "size"), "members")
    # what most others were copied from shares buckets with most of them
    central = members.groupBy("rep").agg(F.sum("size").alias("met"))
    order = F.struct("met", "copies", F.xxhash64("rep"), "rep", "n")
    pivots = members.join(central, "rep").groupBy("key").agg(F.max(order).alias("p")).select("key", F.col("p.rep").alias("pivot"), F.col("p.n").alias("pivot_n"))
    others = cut(members.join(pivots, "key").where("rep <> pivot").select("key", "rep", "n", "pivot", "pivot_n"), "others")
    first = cut(others.where(_alike_in_size("n", "pivot_n", percent)).select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "pivots")
    first = first.join(first.groupBy("b").agg(F.count("*").alias("n")), "b")
    reps = heads.select("rep") if exhaustive else members.select("rep").distinct()
    sets = cut(shingle_sets(df, reps.select(F.col("rep").alias("id")), id_col, text_col), "sets")
    # an id with several texts is one document
    several = named.groupBy("id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).where("x <> y").select("id")
    several = named.join(several, "id").join(equal, ["s1", "s2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    stars = connected_components(linked(first, sets, percent).union(several), "a", "b").withColumnRenamed("node", "rep")
    labels = reps.join(stars, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    labels = cut(labels.join(stars.groupBy("component").agg(F.count("*").alias("members")), "component", "left").select("rep", "component", F.coalesce("members", F.lit(1)).alias("members")), "labels")
    open_reps = labels
    if not exhaustive:
        # sizes that may be alike fall into the same class or the next; what a pivot is to its bucket is known
        step = F.floor(F.log(F.col("n")) / float(np.log(100 / min(percent, 99))) * (1 + 1e-9)).cast("int")
        cells = others.withColumn("step", F.explode(F.array(step, step + 1)))
        several_in = cells.join(labels, "rep").groupBy("key", "step").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key", "step")
        open_reps = labels.join(cells.join(several_in, ["key", "step"]).select("rep").distinct(), "rep", "left_semi")
    looks = cut(_rare_pairs(sets, open_reps, percent), "looks")
    found = linked(looks.join(looks.groupBy("b").agg(F.count("*").alias("n")), "b"), sets, percent)
    # of two components that are linked, the smaller number is that of both
    of = labels.select("rep", "component")
    between = found.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select("x", "y")
    joined = connected_components(between, "x", "y").toDF("component", "least")
    component = stars.join(joined, "component", "left").select("rep", F.coalesce("least", "component").alias("component"))
    alone = joined.join(stars, F.col("rep") == joined["component"], "left_anti").select(F.col("component").alias("rep"), F.col("least").alias("component"))
    component = component.union(alone)
    group = equal.join(component, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    by_row = sketch.join(group, ["s1", "s2"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return by_row.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
