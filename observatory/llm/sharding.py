"""Resharding by minimum-cost flow.

The documents' present shards are sources of bytes, the new shards' capacities
sinks; a byte that stays costs nothing and one that moves costs one. The flow of
least cost says how many bytes each old shard keeps and sends where, and blocks of
its documents, in a fixed order, are cut to these amounts. Only shards that lose or
gain a document have their files written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from observatory.shared import cut

#: A document of at least a new shard's mean size divided by this is placed by itself.
LARGE = 200
#: Documents that a block holds, about.
BLOCK_ROWS = 20_000
LEAST_BLOCKS = 64


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """The amounts from each source to each sink, all supply sent, at least total cost.

    Sends along the cheapest path that is left, by Bellman-Ford, until nothing is
    left to send. Needs sum(supply) <= sum(capacity).
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    far = float("inf")
    while sum(left):
        distance = [0 if left[i] else far for i in range(n)] + [far] * m
        via: list[int] = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if distance[i] + cost[i][j] < distance[n + j]:
                        distance[n + j], via[n + j], changed = distance[i] + cost[i][j], i, True
                    if flow[i][j] and distance[n + j] - cost[i][j] < distance[i]:
                        distance[i], via[i], changed = distance[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (distance[n + j], j), default=None)
        if end is None or distance[n + end] == far:
            raise ValueError("the capacities do not hold the supply")
        path, node = [], n + end
        while via[node] != -1:
            path.append((via[node], node))
            node = via[node]
        amount = min([left[node], room[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[node] -= amount
        room[end] -= amount
    return flow


def levelled(fixed: list[int], total: int) -> list[int]:
    """What each shard gets of ``total`` more so that the shards, ``fixed`` there already, end as level as they can."""
    low, high = 0, sum(fixed) + total + 1
    while high - low > 1:  # the highest level that total reaches
        level = (low + high) // 2
        low, high = (level, high) if sum(max(0, level - x) for x in fixed) <= total else (low, level)
    got = [max(0, low - x) for x in fixed]
    rest = total - sum(got)
    for j in sorted(range(len(fixed)), key=lambda j: (fixed[j] + got[j], j))[:rest]:
        got[j] += 1
    return got


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _keyed(df: DataFrame, old_shard: Column, old_shards: int, id_col: str, text_col: str, *more: Column) -> DataFrame:
    known = F.when(old_shard.isNull() | (old_shard < 0) | (old_shard >= old_shards), F.raise_error(F.lit(f"an old shard is not in 0 to {old_shards - 1}"))).otherwise(old_shard).cast("int")
    crc = F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long")
    return df.select(F.col(id_col).alias("id"), size_of(F.col(text_col)).alias("size"), crc.alias("crc"), known.alias("old"), *more)


class _Plan:
    """Where each row of a keyed table goes, by what it holds alone: the same for every reading of the table."""

    def __init__(self, rows: DataFrame, old_shards: int, shards: int) -> None:
        spark = rows.sparkSession
        olds = {r["old"]: (r["size"], r["n"]) for r in rows.groupBy("old").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        small = [olds.get(i, (0, 0))[0] for i in range(old_shards)]
        self.large_from = max(2, -(-sum(small) // (shards * LARGE)))
        self.blocks = max(LEAST_BLOCKS, max((n for _, n in olds.values()), default=0) // BLOCK_ROWS)
        fixed, goal, placed = [0] * shards, -(-sum(small) // shards), []
        # at most shards * LARGE rows
        large = rows.where(F.col("size") >= self.large_from).select("old", "id", "crc", "size").collect()
        alike: dict[tuple, int] = {}
        for r in sorted(large, key=lambda r: (-r["size"], r["id"] is not None, r["id"] or 0, r["crc"], r["old"])):
            to = r["old"] if r["old"] < shards and fixed[r["old"]] + r["size"] <= goal else min(range(shards), key=lambda j: (fixed[j], j))
            fixed[to] += r["size"]
            small[r["old"]] -= r["size"]
            alike[tuple(r)] = alike.get(tuple(r), 0) + 1
            placed.append((*r, alike[tuple(r)], to))
        flow = min_cost_flow(small, levelled(fixed, sum(small)), [[int(i != j) for j in range(shards)] for i in range(old_shards)])
        self.spans = []
        for i, out in enumerate(flow):
            low = 0
            for j, amount in enumerate(out):
                if amount:
                    self.spans.append((i, j, low, low + amount))
                    low += amount
        #: Shards that a row may leave or enter.
        self.touched = sorted({x for i, j, _, _ in self.spans if i != j for x in (i, j)} | {x for i, *_, j in placed if i != j for x in (i, j)})
        kinds = {f.name: f.dataType for f in rows.schema}
        self.placed = spark.createDataFrame(placed, T.StructType([T.StructField(c, k) for c, k in (("l_old", T.IntegerType()), ("l_id", kinds["id"]), ("l_crc", T.LongType()), ("l_size", T.LongType()), ("l_alike", T.IntegerType()), ("placed", T.IntegerType()))]))
        ahead = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = self.blocked(rows).groupBy("old", "block").agg(F.sum(self.weight()).alias("sum"))
        self.sums = sums.withColumn("ahead", F.coalesce(F.sum("sum").over(ahead), F.lit(0))).select("old", "block", "ahead")

    def blocked(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", F.pmod(F.xxhash64("id", "crc"), F.lit(self.blocks)).cast("int"))

    def weight(self) -> Column:
        return F.when(F.col("size") >= self.large_from, 0).otherwise(F.col("size"))

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with block, shard and place, the number in its shard's part of the block."""
        order = ["id", "crc", "size"]
        in_block = Window.partitionBy("old", "block").orderBy(*order)
        rows = self.blocked(rows).withColumn("upto", F.sum(self.weight()).over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn("alike", F.row_number().over(Window.partitionBy("old", "block", *order).orderBy(F.lit(0)))).join(self.sums, ["old", "block"])
        # a document belongs where its middle byte goes
        middle = F.greatest(F.col("ahead") + F.col("upto") - F.floor(F.col("size") / 2) - 1, F.lit(0))
        by_span = F.lit(0)
        for i, j, low, high in self.spans:
            by_span = F.when((F.col("old") == i) & (F.col("middle") >= low) & (F.col("middle") < high), j).otherwise(by_span)
        same = F.col("id").eqNullSafe(F.col("l_id"))
        for c in ("old", "crc", "size", "alike"):
            same &= F.col(c) == F.col(f"l_{c}")
        rows = rows.withColumn("middle", middle).join(F.broadcast(self.placed), same, "left").withColumn("shard", F.coalesce("placed", by_span.cast("int")))
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("old", "block", "shard").orderBy(*order)) - 1)
        return rows.drop("upto", "alike", "ahead", "middle", "placed", "l_old", "l_id", "l_crc", "l_size", "l_alike")


def _slotted(rows: DataFrame, counted: DataFrame) -> DataFrame:
    # one row for each shard and block
    before = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counted.groupBy("old", "block", "shard").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.join(counts, ["old", "block", "shard"]).withColumn("slot", (F.col("base") + F.col("place")).cast("long"))


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), "shard", "slot")


def reshard(df: DataFrame, old_shard: Column, old_shards: int, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, size, text_crc32, old_shard, shard, slot): one for each row of ``df``.

    ``old_shard`` says where a row is now, 0 to old_shards - 1; a null or any other
    number is an error. The shards' sizes end level but for about a 200th; no cheaper
    set of transfers levels them so. Documents of a 200th of the mean shard or more,
    of which there cannot be more than 200 times the shards, are placed first, where
    they are if there is room. slot counts a shard's rows from 0. Equal texts need not
    stay together: where a row is, its id and its size decide. A null text has size
    1; null ids and repeated rows are rows like any other; an empty table gives no
    rows; other columns are ignored.
    """
    rows = cut(_keyed(df, old_shard, old_shards, id_col, text_col), "sizes")
    placed = cut(_Plan(rows, old_shards, shards).apply(rows), "shards")
    return _result(_slotted(placed, placed), id_col)


def rewrite(df: DataFrame, old_shard: Column, old_shards: int, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """Writes the new files of the shards that may lose or gain a row, under path/shard=N; returns (``reshard``'s rows, these numbers).

    Files hold all columns of ``df``, in a column ``row``, and id, size, crc, old and
    slot. All other shards' old files hold what they should. The rows of written
    shards are read back from their files. Rows that are equal in old shard, id and
    text may take each other's slots. Otherwise as ``reshard``.
    """
    spark = df.sparkSession
    rows = cut(_keyed(df, old_shard, old_shards, id_col, text_col), "sizes")
    plan = _Plan(rows, old_shards, shards)
    placed = cut(plan.apply(rows), "shards")
    whole = plan.apply(_keyed(df, old_shard, old_shards, id_col, text_col, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")))
    moved = _slotted(whole.where(F.col("shard").isin(plan.touched)), placed)
    moved.select("shard", "slot", "id", "size", "crc", "old", "row").write.partitionBy("shard").parquet(path)
    kept = _result(_slotted(placed.where(~F.col("shard").isin(plan.touched)), placed), id_col)
    written = spark.read.schema(T.StructType([*(f for f in moved.select("slot", "id", "size", "crc", "old").schema), T.StructField("shard", T.IntegerType())])).parquet(path)
    return kept.union(_result(written, id_col)), plan.touched
