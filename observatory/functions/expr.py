"""Column expressions in which missing stays missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scores.
HIGH_FROM = 0.75
MEDIUM_FROM = 0.45
RECENCY_DAYS = 90.0
DAMPING = 10.0
DAY_US = 86_400_000_000


def bounded(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; null if x is (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def days(later: Column, earlier: Column) -> Column:
    """Signed fractional days between two timestamps."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(DAY_US))


def days_between(later: Column, earlier: Column) -> Column:
    d = days(later, earlier)
    return F.when(d.isNotNull(), F.greatest(F.lit(0.0), d))


def whole_days_since(since: Column, now: Column) -> Column:
    """Floor of the days since, 0 at least; null if unknown."""
    return F.floor(days_between(now, since)).cast("int")


def level(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "HIGH").when(score >= MEDIUM_FROM, "MEDIUM").when(score.isNotNull(), "LOW")


def damped(total: Column) -> Column:
    return bounded(F.sqrt(F.greatest(F.lit(0.0), total)) / DAMPING)


def recency(pushed_at: Column, now: Column) -> Column:
    """Linear decay to 0 over RECENCY_DAYS; 0 where there never was a push."""
    return F.coalesce(bounded(1 - days_between(now, pushed_at) / RECENCY_DAYS), F.lit(0.0))


def mean_or_zero(x: Column) -> Column:
    """An aggregate: the mean, 0.0 over nothing."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def share_of(condition: Column) -> Column:
    """An aggregate: the share of rows that satisfy it, 0.0 over nothing."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def log_share(x: Column, full: int) -> Column:
    """log1p(x) over log1p(full), bounded."""
    return bounded(F.log1p(x.cast("double")) / F.log1p(F.lit(float(full))))


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    """From counts; 0 if both sides are empty."""
    return F.coalesce(F.try_divide(shared.cast("double"), left + right - shared), F.lit(0.0))


def star_band(stars: Column) -> Column:
    return F.when(stars.isNull(), "unknown").when(stars < 10, "0-9").when(stars < 100, "10-99").when(stars < 1000, "100-999").when(stars < 10000, "1000-9999").otherwise("10000+")


def age_band(age: Column) -> Column:
    """age in signed days."""
    return F.when(age.isNull(), "unknown").when(age < 0, "future_created_at").when(age < 30, "under-30d").when(age < 365, "30-364d").when(age < 1095, "365-1094d").otherwise("1095d+")


def format_confidence(score: Column) -> Column:
    return F.format_string("%s (%.2f)", level(score), score)


def strongest(levels: Column) -> Column:
    """An aggregate: the highest of levels, LOW over nothing."""
    order = F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH")))
    return F.element_at(order, F.greatest(F.coalesce(F.max(F.array_position(order, levels)), F.lit(1)), F.lit(1)).cast("int"))
