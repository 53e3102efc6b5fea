"""Evidence as text: rendered figures, and prompts within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the rendered texts.
UNKNOWN = "unknown"
OMITTED = "(remaining evidence omitted — hit the size cap)"


def signed(x: Column) -> Column:
    return F.coalesce(F.format_string("%+d", x), F.lit(UNKNOWN))


def fixed(x: Column, digits: int) -> Column:
    """x with so many digits after the point, as C and Python print it: its exact binary value is rounded, halves to the even digit."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def fraction(x: Column) -> Column:
    return F.coalesce(fixed(x, 2), F.lit(UNKNOWN))


def repository_evidence(scored: DataFrame) -> DataFrame:
    """(repository_id, kind, payload): counts, growth, momentum and trend of each scored repository, one text each.

    growth_pct and momentum are percentage points and points; they are rendered as such.
    """
    growth = F.col("stars7.growth_pct")
    complete = F.when(F.col("stars7.complete"), "complete").otherwise("partial")
    items = {
        "counts": F.concat(F.lit("stars="), F.col("latest.stars").cast("string"), F.lit(" forks="), F.col("latest.forks").cast("string")),
        "growth": F.when(F.col("stars7").isNull(), "stars over 7 days: " + UNKNOWN).otherwise(F.concat(F.lit("stars over 7 days: "), signed(F.col("stars7.delta")), F.lit(" ("), F.coalesce(F.concat(fixed(growth, 1), F.lit("%")), F.lit(UNKNOWN)), F.lit(", "), complete, F.lit(" window)"))),
        "momentum": F.concat(F.lit("momentum="), fraction(F.col("momentum"))),
        "trend": F.concat(F.lit("trend="), F.coalesce("trend", F.lit(UNKNOWN))),
    }
    entries = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("payload")) for k, v in items.items()))
    return scored.select("repository_id", F.explode(entries).alias("x")).select("repository_id", "x.*")


def prompt(items: DataFrame, entity: str, most: int) -> DataFrame:
    """(entity, items, chars, omitted, text): each entity's items (evidence_id, kind, payload) in the order of their ids as texts, ``most`` characters of payload in all.

    The item that reaches the budget is cut to what is left and is the last one; a line
    then says that others may be missing.
    """
    order = Window.partitionBy(entity).orderBy("evidence_id")
    before = F.coalesce(F.sum(F.length("payload")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = items.withColumn("before", before).where(F.col("before") < most)
    kept = kept.withColumn("payload", F.expr(f"substring(payload, 1, cast({most} - before as int))"))
    entry = F.struct("evidence_id", F.concat(F.lit("["), F.col("evidence_id"), F.lit("] kind="), F.col("kind"), F.lit("\n"), F.col("payload")).alias("line"), F.length("payload").alias("n"))
    out = kept.groupBy(entity).agg(F.count("*").alias("items"), F.sum(F.length("payload")).cast("long").alias("chars"), F.array_sort(F.collect_list(entry)).alias("x"))
    omitted = F.col("chars") >= most
    lines = F.transform("x", lambda e: e["line"])
    return out.select(entity, "items", "chars", omitted.alias("omitted"), F.array_join(F.when(omitted, F.concat(lines, F.array(F.lit(OMITTED)))).otherwise(lines), "\n\n").alias("text"))
