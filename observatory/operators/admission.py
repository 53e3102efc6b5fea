"""Which candidates a run may still ask for: nested budgets over an order, without a single task that sees them all.

Candidates are dealt into ranges of their order and stored so; counts of each range give
every row the number of rows before it, so that ranks are exact and each task ranks its
own range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from observatory.shared import cut


def ranges(rows: DataFrame, order: list[str], parts: int = 0) -> DataFrame:
    """``rows`` stored in ranges of ``order``, with __range; rows alike in ``order`` lie in one range."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def before(stored: DataFrame, order: list[str], counted: Column, name: str, by: str | None = None) -> DataFrame:
    """Adds ``name``: how many rows before each one, in its ``by``, ``counted`` is true for."""
    keys = ["__range", by] if by else ["__range"]
    # one row for each range and scope
    counts = stored.groupBy(*keys).agg(F.count_if(counted).alias("__c"))
    ahead = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(k).alias(f"o{k}") for k in keys), F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__ahead"))
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = stored.withColumn("__own", F.coalesce(F.sum(counted.cast("bigint")).over(own), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"o{k}")) for k in keys]
    return rows.join(F.broadcast(offsets), on).withColumn(name, F.col("__own") + F.col("__ahead")).drop("__own", "__ahead", *(f"o{k}" for k in keys))


def admit(candidates: DataFrame, order: list[str], scope: str, caps: dict[str, int], total: int, used: dict[str, int] | None = None, parts: int = 0) -> DataFrame:
    """``candidates`` with admitted and refused_by (null, "total" or the scope), as a loop over them in ``order`` would decide.

    A candidate is admitted while its scope's cap and the total have room and then
    takes one of both, whatever becomes of it; one that is refused takes none. A null
    scope, or one without a cap, has the total alone. ``used`` is what earlier runs
    have taken, by scope and under "total". ``order`` has to tell all rows apart.
    """
    used = used or {}
    cap = F.create_map(*(x for k, v in caps.items() for x in (F.lit(k), F.lit(v - used.get(k, 0))))) if caps else F.create_map().cast("map<string,int>")
    room = total - used.get("total", 0)
    stored = ranges(candidates, order, parts)
    ranked = before(stored, order, F.lit(True), "__of_scope", scope)
    fits = F.coalesce(F.col("__of_scope") < F.try_element_at(cap, F.col(scope)), F.lit(True))
    ranked = before(ranked.withColumn("__fits", fits), order, F.col("__fits"), "__of_all")
    refused = F.when(F.col("__of_all") >= room, "total").when(~F.col("__fits"), F.col(scope))
    return ranked.withColumn("refused_by", refused).withColumn("admitted", refused.isNull()).drop("__range", "__of_scope", "__fits", "__of_all")


def replay(requests: DataFrame, stored: DataFrame, keys: list[str], order: str, force: str, budget: int, parts: int = 0) -> DataFrame:
    """``requests`` with outcome: hit, call or refused, as a loop over them in ``order`` has it.

    A request whose key is ``stored``, or was called for before in this run, is a hit,
    unless ``force``. All others take a call of the budget, or are refused. ``order`` is
    one column that tells all requests apart; nulls in keys equal each other.
    """
    have = stored.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct().withColumn("__stored", F.lit(True))
    same = lambda side: [requests[k].eqNullSafe(side[f"__{k}"]) for k in keys]
    first = requests.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min(order).alias("__first"))
    rows = requests.join(have, same(have), "left").drop(*(f"__{k}" for k in keys))
    rows = rows.join(first, [rows[k].eqNullSafe(first[f"__{k}"]) for k in keys]).drop(*(f"__{k}" for k in keys))
    known = F.coalesce("__stored", F.lit(False))
    rows = cut(rows.withColumn("__known", known).withColumn("__calls", F.coalesce(F.col(force), F.lit(False)) | (~known & (F.col(order) == F.col("__first")))), "requests")
    calls = admit(rows.where("__calls").select(F.col(order).alias("__order")).withColumn("__scope", F.lit(None).cast("string")), ["__order"], "__scope", {}, budget, parts=parts).select("__order", "admitted")
    # of a key that isn't stored, whether its first call was admitted says what became of the others
    own = F.when(F.col("__calls") | ~F.col("__known"), F.when(F.col("__calls"), F.col(order)).otherwise(F.col("__first")))
    rows = rows.withColumn("__own", own).join(calls, F.col("__own") == F.col("__order"), "left")
    outcome = F.when(F.col("__calls"), F.when(F.col("admitted"), "call").otherwise("refused")).when(F.col("__known") | F.col("admitted"), "hit").otherwise("refused")
    return rows.select(*requests.columns, outcome.alias("outcome"))
