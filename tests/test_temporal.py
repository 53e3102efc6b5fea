"""Hand-computed series."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from observatory.operators import scoring, temporal

T0 = datetime(2024, 1, 1)
SCHEMA = "repository_id long, captured_at timestamp, stars int, forks int, pushed_at timestamp"


def series(spark, points, push_ago=0.0):
    """points: key to [(day, stars, forks)]."""
    rows = [(k, T0 + timedelta(days=d), s, f, T0 + timedelta(days=d - push_ago)) for k, xs in points.items() for d, s, f in xs]
    return spark.createDataFrame(rows, SCHEMA)


def delta(spark, points, days=7, field="stars"):
    rows = temporal.window_deltas(series(spark, {1: points}), "repository_id", "captured_at", ["stars", "forks"]).where((F.col("field") == field) & (F.col("window_days") == days)).collect()
    return rows[0] if rows else None


def test_complete_window_takes_the_newest_base_before_it(spark):
    x = delta(spark, [(0, 100, 10), (2, 110, 12), (8, 130, 15)])
    assert (x.base, x.delta, x.span_days, x.per_day, x.complete) == (100, 30, 8.0, 3.75, True)


def test_without_an_old_enough_base_the_first_is_partial(spark):
    x = delta(spark, [(0, 100, 1), (1, 105, 1)])
    assert (x.delta, x.span_days, x.complete) == (5, 1.0, False)


def test_one_observation_has_no_delta(spark):
    assert delta(spark, [(0, 100, 1)]) is None


def test_missing_is_not_zero(spark):
    assert delta(spark, [(0, 100, 1), (8, None, 2)]) is None
    assert delta(spark, [(0, 100, 1), (8, None, 2)], field="forks").delta == 1


def test_measured_zero_and_growth_from_zero(spark):
    x = delta(spark, [(0, 100, 10), (7, 100, 10)])
    assert (x.delta, x.growth_pct, x.complete) == (0, 0.0, True)
    assert delta(spark, [(0, 0, 0), (2, 1, 0)]).growth_pct is None


def test_gap_of_half_the_window_is_complete_and_more_is_not(spark):
    assert delta(spark, [(0, 1, 1), (10.5, 2, 1)]).complete
    assert not delta(spark, [(0, 1, 1), (10.6, 2, 1)]).complete


def test_momentum_and_trends(spark):
    points = {1: [(0, 100, 10), (8, 150, 15)], 2: [(0, 100, 10), (7, 93, 10)], 3: [(0, 100, 10)], 4: [(0, 100, 10), (7, 102, 10)]}
    rows = scoring.with_momentum(temporal.series_windows(series(spark, points, 2.0), "repository_id", "captured_at", ["stars", "forks", "pushed_at"]))
    got = {r.repository_id: r for r in rows.withColumn("trend", scoring.trend()).withColumn("c", scoring.window_confidence(7)).collect()}
    assert got[1].momentum == pytest.approx(4.977778, abs=1e-6)
    assert [got[i].trend for i in (1, 2, 3, 4)] == ["rising", "declining", "new", "steady"]
    assert got[3].momentum is None and got[3].c.score == 0
    assert got[2].c.score == pytest.approx(0.796) and got[2].c.level == "HIGH"


def test_anchored_delta_has_no_fallback(spark):
    rows = [(1, T0 + timedelta(days=d), v) for d, v in ((90, 10), (95, 40), (100, 100))] + [(2, T0 + timedelta(days=100), 100)]
    df = spark.createDataFrame(rows, "k long, captured_at timestamp, v int")
    got = {r.k: r for r in temporal.anchored_deltas(df, ["k"], "captured_at", "v", F.lit(T0 + timedelta(days=100)), (7,)).collect()}
    assert (got[1].base, got[1].delta, got[1].complete) == (10, 90, True)
    assert (got[2].current, got[2].delta, got[2].complete) == (100, None, False)


def test_nearest_of_two_as_near_is_the_older(spark):
    snaps = series(spark, {1: [(0, 1, 1), (2, 2, 2)]})
    target = spark.createDataFrame([(1, T0 + timedelta(days=1))], "repository_id long, target timestamp")
    assert temporal.nearest_to(snaps, target, "repository_id", "captured_at", "target").first().found.stars == 1


def test_order_of_rows_does_not_matter(spark):
    snaps = series(spark, {k: [(d, 100 + d * k, 10) for d in range(12)] for k in range(20)})
    run = lambda df: sorted(map(tuple, temporal.window_deltas(df, "repository_id", "captured_at", ["stars"]).collect()))
    assert run(snaps) == run(snaps.orderBy(F.rand(3)).repartition(7))
