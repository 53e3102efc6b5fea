"""Repository scores and labels over series windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.functions.expr import bounded, days, days_between, level, mean_or_zero, recency, share_of
from observatory.operators.temporal import field_delta

# Fixed values of the scores.
STARS_WEIGHT, FORKS_WEIGHT, RECENCY_WEIGHT, MOST_GROWTH = 0.05, 0.03, 1.0, 100.0
RISING_PCT, DECLINING_PCT, INACTIVE_BELOW = 5.0, -5.0, 0.05
COUNT_WEIGHT, SPAN_WEIGHT, GAP_WEIGHT, ENOUGH_OBSERVATIONS = 0.34, 0.33, 0.33, 5.0
TOPIC_SIZE, TOPIC_SIZE_WEIGHT, TOPIC_MOMENTUM_WEIGHT, TOPIC_COMPLETE_WEIGHT = 10.0, 0.5, 0.3, 0.2


def with_momentum(series: DataFrame, anchor: Column | None = None) -> DataFrame:
    """Adds stars7, forks7, recency and momentum to ``series_windows`` of stars, forks and pushed_at.

    anchor: the instant pushes are aged at; none for each series' newest observation.
    Momentum is null unless both 7-day deltas have a base above zero; a decline adds
    nothing; partial windows count.
    """
    at = F.col("newest_at") if anchor is None else anchor
    out = series.withColumn("stars7", field_delta("stars", 7)).withColumn("forks7", field_delta("forks", 7)).withColumn("recency", recency(F.col("latest.pushed_at"), at))
    growth = lambda c: bounded(F.col(f"{c}.growth_pct"), 0.0, MOST_GROWTH)
    known = (F.col("stars7.base") > 0) & (F.col("forks7.base") > 0)
    return out.withColumn("momentum", F.when(known, STARS_WEIGHT * growth("stars7") + FORKS_WEIGHT * growth("forks7") + RECENCY_WEIGHT * F.col("recency")))


def trend(anchor: Column | None = None) -> Column:
    """new, rising, declining, inactive or steady, over ``with_momentum``; ``anchor`` ages pushes where momentum is null."""
    at = F.col("newest_at") if anchor is None else anchor
    age = F.when(F.col("momentum").isNotNull(), F.col("recency")).otherwise(recency(F.col("latest.pushed_at"), at))
    growth = F.col("stars7.growth_pct")
    return F.when(F.col("n") < 2, "new").when(growth >= RISING_PCT, "rising").when(growth <= DECLINING_PCT, "declining").when(age < INACTIVE_BELOW, "inactive").otherwise("steady")


def window_confidence(d: int) -> Column:
    """A struct (score, level, count_term, span_term, gap_term) over ``series_windows``: how well observations cover the window.

    Without an observation at or before the window's start the score is 0.
    """
    w = F.col(f"w{d}")
    count_term = bounded(F.col("n") / ENOUGH_OBSERVATIONS)
    covered = (F.col("n") >= 2) & ~w["fallback"]
    span_term = F.when(covered, bounded(days(F.col("newest_at"), w["at"]) / d)).otherwise(0.0)
    gap_term = F.when(covered, bounded(1 - F.abs(days(F.col("newest_at"), w["at"]) - d) / (d / 2))).otherwise(0.0)
    score = F.when(covered, bounded(COUNT_WEIGHT * count_term + SPAN_WEIGHT * span_term + GAP_WEIGHT * gap_term)).otherwise(0.0)
    return F.struct(score.alias("score"), level(score).alias("level"), count_term.alias("count_term"), span_term.alias("span_term"), gap_term.alias("gap_term"))


def window_status(field: str, d: int) -> Column:
    x = field_delta(field, d)
    return F.when(x.isNull(), "unavailable").when(x["complete"], "complete").otherwise("partial")


def recency_metrics(created: Column, updated: Column, pushed: Column, latest_pushed: Column, now: Column) -> Column:
    """A struct (age_days, days_since_push, days_since_update, recency); the newest observation's push goes first."""
    push = F.coalesce(latest_pushed, pushed)
    return F.struct(days_between(now, created).alias("age_days"), days_between(now, push).alias("days_since_push"), days_between(now, updated).alias("days_since_update"), recency(push, now).alias("recency"))


def topic_aggregates(scored: DataFrame, topics: DataFrame, key: str = "repository_id") -> DataFrame:
    """Per topic: repositories, total and mean momentum (missing counts as 0), shares and confidence."""
    complete = F.coalesce(F.col("stars7.complete"), F.lit(False))
    rows = topics.select(key, "topic").distinct().join(scored.select(key, "momentum", complete.alias("complete")), key)
    out = rows.groupBy("topic").agg(
        F.count("*").alias("repositories"), F.sum(F.coalesce("momentum", F.lit(0.0))).alias("total_momentum"),
        share_of(F.col("momentum").isNotNull()).alias("share_with_momentum"), share_of(F.col("complete")).alias("share_complete"),
    )
    score = bounded(TOPIC_SIZE_WEIGHT * bounded(F.col("repositories") / TOPIC_SIZE) + TOPIC_MOMENTUM_WEIGHT * F.col("share_with_momentum") + TOPIC_COMPLETE_WEIGHT * F.col("share_complete"))
    out = out.withColumn("mean_momentum", F.col("total_momentum") / F.col("repositories")).withColumn("confidence", score)
    return out.withColumn("confidence_level", F.when((F.col("repositories") < TOPIC_SIZE) & (level(F.col("confidence")) == "HIGH"), "MEDIUM").otherwise(level(F.col("confidence"))))


def summary(scored: DataFrame) -> DataFrame:
    """One row: mean stars and forks a day where both 7-day deltas exist, counts of trends and of HIGH confidence; needs ``trend`` and ``confidence``."""
    both = F.col("stars7").isNotNull() & F.col("forks7").isNotNull()
    return scored.agg(
        F.count("*").alias("repositories"), F.avg(F.when(both, F.col("stars7.per_day"))).alias("stars_per_day"), F.avg(F.when(both, F.col("forks7.per_day"))).alias("forks_per_day"),
        *(F.count_if(F.col("trend") == t).alias(t) for t in ("rising", "steady", "declining", "new", "inactive")), F.count_if(F.col("confidence.level") == "HIGH").alias("high_confidence"),
        mean_or_zero(F.col("momentum")).alias("mean_momentum"),
    )
