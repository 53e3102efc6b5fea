"""Operators over observation series: what was known when, and what changed since.

A series is the observations of one key, one for each instant: of several at the
same instant the one written last stands. Nothing here reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from observatory.functions.expr import days

# Fixed values of the windows.
WINDOWS = (1, 7, 30)
GAP_SHARE = 0.5


def dedup_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: that of the largest ``seq``. One aggregate, partial before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("__last"))
    return last.select(*keys, *(F.col(f"__last.{c}").alias(c) for c in rest)).select(*df.columns)


def changed_only(df: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """Without the rows whose ``fields`` equal, null-safely, those of the row before."""
    w = Window.partitionBy(key).orderBy(at)
    now = F.struct(*fields)
    before = F.lag(now).over(w)
    rows = df.withColumn("__n", F.row_number().over(w)).withColumn("__same", now.eqNullSafe(before))
    return rows.where("__n = 1 or not __same").drop("__n", "__same")


def _as_of(snapshots: DataFrame, targets: DataFrame, key: str, at: str, target: str, forward: bool = False, inclusive: bool = True) -> DataFrame:
    """One row per row of ``targets``, by (key, target), with ``found``: a struct of the observation, null if none.

    Observations and targets stand in one order of time, in which a target takes the
    last observation before it; nothing is joined but each target's answer.
    """
    row = F.struct(*(c for c in snapshots.columns if c != key))
    seen = snapshots.select(key, F.col(at).alias("__t"), F.lit(0).alias("__k"), row.alias("found"))
    asked = targets.select(key, target).distinct().select(key, F.col(target).alias("__t"), F.lit(1 if inclusive else -1).alias("__k"), F.lit(None).cast(seen.schema["found"].dataType).alias("found"))
    order = Window.partitionBy(key).orderBy(F.desc("__t") if forward else F.asc("__t"), "__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = seen.union(asked).withColumn("found", F.last("found", ignorenulls=True).over(order)).where("__k <> 0").select(key, F.col("__t").alias(target), "found")
    return targets.join(found, [key, target], "left")


def at_or_before(snapshots: DataFrame, targets: DataFrame, key: str, at: str, target: str) -> DataFrame:
    """Backward as-of, inclusive."""
    return _as_of(snapshots, targets, key, at, target)


def at_or_after(snapshots: DataFrame, targets: DataFrame, key: str, at: str, target: str) -> DataFrame:
    return _as_of(snapshots, targets, key, at, target, forward=True)


def previous_of(snapshots: DataFrame, targets: DataFrame, key: str, at: str, target: str) -> DataFrame:
    """Backward as-of, exclusive."""
    return _as_of(snapshots, targets, key, at, target, inclusive=False)


def nearest_to(snapshots: DataFrame, targets: DataFrame, key: str, at: str, target: str) -> DataFrame:
    """On either side; of two as near, the older."""
    both = _as_of(snapshots, at_or_before(snapshots, targets, key, at, target).withColumnRenamed("found", "__before"), key, at, target, forward=True)
    gap = lambda x: F.abs(F.unix_micros(F.col(f"{x}.{at}")) - F.unix_micros(target))
    older = F.col("found").isNull() | (gap("__before") <= gap("found"))
    return both.withColumn("found", F.when(F.col("__before").isNotNull() & older, F.col("__before")).otherwise(F.col("found"))).drop("__before")


def series_windows(snapshots: DataFrame, key: str, at: str, fields: list[str], windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Per series: n, first_at, newest_at, latest, and per window its base.

    A window reaches back from the series' own newest observation; its base is the
    newest one, other than that itself, at or before the window's start, else the
    first of all (``fallback``). One window function finds the newest instant and one
    aggregate all else, over the same partitioning.
    """
    row = F.struct(*fields)
    rows = snapshots.withColumn("__newest", F.max(at).over(Window.partitionBy(key)))
    aggs = [F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("newest_at"), F.max_by(row, at).alias("latest"), F.min_by(row, at).alias("__first")]
    for d in windows:
        in_time = F.when((F.col(at) <= F.col("__newest") - F.make_dt_interval(F.lit(d))) & (F.col(at) < F.col("__newest")), F.col(at))
        aggs += [F.max(in_time).alias(f"__at{d}"), F.max_by(F.when(in_time.isNotNull(), row), in_time).alias(f"__base{d}")]
    out = rows.groupBy(key).agg(*aggs)
    for d in windows:
        fallback = F.col(f"__at{d}").isNull()
        at_d = F.when(fallback, F.col("first_at")).otherwise(F.col(f"__at{d}"))
        base = F.when(fallback, F.col("__first")).otherwise(F.col(f"__base{d}"))
        out = out.withColumn(f"w{d}", F.struct(at_d.alias("at"), base.alias("base"), fallback.alias("fallback")))
    return out.select(key, "n", "first_at", "newest_at", "latest", *(f"w{d}" for d in windows))


def field_delta(field: str, d: int) -> Column:
    """A struct (base, current, delta, span_days, per_day, growth_pct, complete) over ``series_windows``; null without two usable ends."""
    w = F.col(f"w{d}")
    current, base = F.col(f"latest.{field}"), w["base"][field]
    span = F.greatest(days(F.col("newest_at"), w["at"]) * 24, F.lit(1e-9)) / 24
    gap = F.greatest((d - days(F.col("newest_at"), w["at"])) * -24, F.lit(0.0))
    delta = current - base
    made = F.struct(
        base.alias("base"), current.alias("current"), delta.alias("delta"), span.alias("span_days"), (delta / span).alias("per_day"),
        F.try_divide(delta * 100.0, base).alias("growth_pct"), (~w["fallback"] & (gap <= d * 24 * GAP_SHARE)).alias("complete"),
    )
    return F.when((F.col("n") >= 2) & current.isNotNull() & base.isNotNull(), made)


def window_deltas(snapshots: DataFrame, key: str, at: str, fields: list[str], windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Long form: one row per series, field and window that has a delta."""
    entries = [F.struct(F.lit(f).alias("field"), F.lit(d).alias("window_days"), field_delta(f, d).alias("x")) for f in fields for d in windows]
    rows = series_windows(snapshots, key, at, fields, windows).select(key, F.explode(F.array(*entries)).alias("e"))
    return rows.where("e.x is not null").select(key, "e.field", "e.window_days", "e.x.*")


def anchored_deltas(snapshots: DataFrame, keys: list[str], at: str, value: str, ref: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Per series and window, anchored at one instant for all: what changed up to ``ref``.

    The current observation is the last at or before ``ref`` (else the first), the
    base the last at or before ``ref`` less the window. Without a base, or one that
    is the current observation itself, delta is null and complete false; there is no
    fallback to the first observation.
    """
    row = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    upto = F.when(F.col(at) <= ref, F.col(at))
    aggs = [F.count("*").alias("observations"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max_by(F.when(upto.isNotNull(), row), upto).alias("__cur"), F.min_by(row, at).alias("__first")]
    for d in windows:
        before = F.when(F.col(at) <= ref - F.make_dt_interval(F.lit(d)), F.col(at))
        aggs.append(F.max_by(F.when(before.isNotNull(), row), before).alias(f"__base{d}"))
    out = snapshots.groupBy(*keys).agg(*aggs).withColumn("cur", F.coalesce("__cur", "__first"))
    entries = [F.struct(F.lit(d).alias("window_days"), F.col(f"__base{d}").alias("base")) for d in windows]
    out = out.select(*keys, "observations", "first_at", "last_at", "cur", F.explode(F.array(*entries)).alias("e"))
    usable = F.col("e.base").isNotNull() & (F.col("e.base.at") != F.col("cur.at"))
    delta = F.when(usable, F.col("cur.value") - F.col("e.base.value"))
    gap = days(ref, F.col("e.base.at")) - F.col("e.window_days")
    complete = F.coalesce(delta.isNotNull() & (gap <= F.col("e.window_days") * GAP_SHARE), F.lit(False))
    return out.select(*keys, "e.window_days", "observations", "first_at", "last_at", F.col("cur.value").alias("current"), F.when(usable, F.col("e.base.value")).alias("base"), delta.alias("delta"), complete.alias("complete"))


def field_deltas(snapshots: DataFrame, keys: list[str], at: str, fields: list[str], ref: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """``anchored_deltas`` of several fields, with the column field: one pass over the snapshots for all of them."""
    long = snapshots.select(*keys, at, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("value")) for f in fields))).alias("__pair")).select(*keys, at, "__pair.*")
    return anchored_deltas(long, [*keys, "field"], at, "value", ref, windows)


def missing_days(snapshots: DataFrame, key: str, at: str, until: Column, complete_days: int = 7) -> DataFrame:
    """(key, day) for each of the last complete UTC days before ``until``, since the series began, without an observation."""
    last = F.date_sub(F.to_date(until), 1)
    born = snapshots.groupBy(key).agg(F.to_date(F.min(at)).alias("born"))
    begin = F.greatest(F.date_sub(last, complete_days - 1), F.col("born"))
    wanted = born.select(key, F.explode(F.when(begin <= last, F.sequence(begin, last)).otherwise(F.array().cast("array<date>"))).alias("day"))
    seen = snapshots.select(key, F.to_date(at).alias("day")).distinct()
    return wanted.join(seen, [key, "day"], "left_anti")
