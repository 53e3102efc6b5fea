"""Whether two tables hold the same rows, and whether keys hold: sums of hashes in a tree.

A row's hash is of its key and its columns as text; a bucket of keys has the sum of its
rows' hashes, in which order and partitions don't matter. Buckets are the leaves of a
tree whose root stands for the table. Two tables are compared from the root down, and
only rows of buckets that differ are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leaves of the tree, and children of a node.
BUCKETS, FAN = 4096, 16


def _hash(text: Column) -> Column:
    """60 bits of a text's md5, which any engine has."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _text(columns: list[str]) -> Column:
    """Columns as one text; each is led by its length, so that no two rows have one text, and null is not empty."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat_ws("|", *(part(c) for c in columns))


def _leaves(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    rest = sorted(c for c in df.columns if c not in key)
    rows = df.select(_text(key).alias("k"), _hash(_text([*key, *rest])).alias("h"))
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
    return per_key.groupBy((_hash(F.col("k")) % buckets).cast("int").alias("bucket")).agg(
        F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.sum("h").alias("sum")
    )


def fingerprint(df: DataFrame, key: list[str], buckets: int = BUCKETS, fan: int = FAN) -> DataFrame:
    """(level, node, rows, keys, repeated_keys, sum): level 0 are the buckets, each next one has ``fan`` times fewer nodes, the last one.

    One shuffle by key, which tells keys that occur more than once (unique keys) in the
    same pass; what follows has at most ``buckets`` rows. Columns are cast to text.
    """
    level = _leaves(df, key, buckets).withColumnRenamed("bucket", "node")
    out, number = level.withColumn("level", F.lit(0)), 0
    while buckets > 1:
        number, buckets = number + 1, -(-buckets // fan)
        level = level.groupBy(F.floor(F.col("node") / fan).cast("int").alias("node")).agg(*(F.sum(c).alias(c) for c in ("rows", "keys", "repeated_keys", "sum")))
        out = out.unionByName(level.withColumn("level", F.lit(number)))
    # the sum of sums is of more digits than a row's hash; its last 18 are kept
    return out.select("level", "node", "rows", "keys", "repeated_keys", (F.col("sum") % F.lit(10**18).cast("decimal(38,0)")).cast("bigint").alias("sum"))


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(node) of the buckets whose rows differ, from two fingerprints; equal roots are looked at and no more."""
    of = lambda x, side: x.where("level = 0").select("node", F.struct("rows", "keys", "sum").alias(side))
    both = of(left, "a").join(of(right, "b"), "node", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node")


def changes(left: DataFrame, right: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(key columns, change): rows that are in one table only, or differ, by key: added, removed, changed.

    Both tables are summed up by buckets; only rows of buckets that differ are joined.
    Keys that occur more than once are compared by the sum of their rows.
    """
    wanted = F.broadcast(differing_buckets(fingerprint(left, key, buckets, buckets), fingerprint(right, key, buckets, buckets)))

    def side(df: DataFrame, name: str) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in key)
        rows = df.withColumn("__node", (_hash(_text(key)) % buckets).cast("int")).join(wanted.withColumnRenamed("node", "__node"), "__node", "left_semi")
        h = F.sum(_hash(_text([*key, *rest])).cast("decimal(38,0)"))
        return rows.groupBy(*key).agg(F.struct(F.count("*"), h).alias(name))

    a, b = (side(df, n).withColumnsRenamed({k: f"__{n}_{k}" for k in key}) for n, df in (("a", left), ("b", right)))
    on = [F.col(f"__a_{k}").eqNullSafe(F.col(f"__b_{k}")) for k in key]
    both = a.join(b, on, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select(*(F.coalesce(f"__a_{k}", f"__b_{k}").alias(k) for k in key), change.alias("change"))


def broken_references(rows: DataFrame, column: str, owners: DataFrame, owner: str) -> DataFrame:
    """(value, rows): values of ``column`` that no ``owner`` has, null aside, and how many rows have them."""
    used = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    return used.join(owners.select(F.col(owner).alias("value")).distinct(), "value", "left_anti")
