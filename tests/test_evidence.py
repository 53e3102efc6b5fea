"""Figures in texts are rounded as SQL's printf rounds them."""

from pyspark.sql import functions as F

from observatory.operators import evidence, temporal


def test_halves_go_to_the_even_digit(spark):
    values = [31.25, 56.25, 3.625, 1.005, 0.35, -0.04, -2.25, 0.0, 1234567.25, 116.25, 2.675]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", evidence.fixed(F.col("x"), 1).alias("one"), evidence.fraction(F.col("x")).alias("two")).collect()
    assert [(r.one, r.two) for r in got] == [(f"{v:.1f}", f"{v:.2f}") for v in values]
    assert spark.range(1).select(evidence.fraction(F.lit(None).cast("double")).alias("x")).first().x == "unknown"


def test_growth_is_rounded_once(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", 320), (1, "2024-01-09", 692)], "k long, at string, stars long").withColumn("at", F.col("at").cast("timestamp"))
    got = temporal.window_deltas(rows, "k", "at", ["stars"], (7,)).first()
    assert got.growth_pct == 116.25  # 372 / 320 * 100 is a little more
