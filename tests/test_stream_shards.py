"""Streams keep state by shards of keys, whatever the number of keys; each equals its batch twin."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from observatory.operators import ingest, runs, temporal
from observatory.plans import streams
from observatory.streaming import observations, state

T0 = datetime(2024, 1, 1)


def stream_of(spark, tmp_path, rows, schema, files=3):
    n = -(-len(rows) // files)
    for i in range(0, len(rows), n):
        spark.createDataFrame(rows[i : i + n], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return observations.replay(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)


def same(left, right):
    plain = lambda rows: sorted(str(tuple(r)) for r in rows.collect())
    return plain(left) == plain(right)


def test_answers_of_many_keys_in_two_shards(spark, tmp_path):
    rnd = random.Random(7)
    schema = "k string, at timestamp, seq long, document boolean, value string"
    rows = [(f"k{rnd.randrange(40)}", T0 + timedelta(minutes=rnd.randrange(4000)), i, rnd.random() < 0.4, f"v{i}") for i in range(300)]
    source = stream_of(spark, tmp_path, [*rows, (None, T0 + timedelta(days=9), 999, None, None)], schema)
    ttl, keep = timedelta(hours=3), timedelta(hours=20)
    got = observations.run(state.answers(source, "k", "at", "seq", "document", "value", ttl, keep, "4 days", shards=2), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert same(got, ingest.cached_answers(spark.createDataFrame(rows, schema), "k", "at", "seq", "document", "value", ttl, keep))


def test_an_entry_stays_until_its_last_day_is_closed(spark, tmp_path):
    schema = "k long, at timestamp, seq long, document boolean, value string"
    hour = lambda h: T0 + timedelta(hours=h)
    rows = [(1, hour(12), 1, True, "v"), (1, hour(54), 2, False, None), (2, hour(90), 3, False, None), (None, hour(900), 4, None, None)]
    source = stream_of(spark, tmp_path, rows, schema, files=4)  # the third file's watermark is within the entry's last day
    got = observations.run(state.answers(source, "k", "at", "seq", "document", "value", timedelta(hours=3), timedelta(hours=48), "1 day"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted((r.seq, r.answer, r.value) for r in got.collect()) == [(2, "stale", "v"), (3, "miss", None)]


def test_changes_of_many_keys_in_one_shard(spark, tmp_path):
    rnd = random.Random(8)
    schema = "k double, at timestamp, seq long, v int, w string"
    keys = [0.0, -0.0, float("nan"), 1.5, 2.5]
    rows = [(rnd.choice(keys), T0 + timedelta(minutes=37 * i), i, rnd.choice([None, 1, 2]), rnd.choice(["x", None])) for i in range(200)]
    shuffled = rnd.sample(rows, len(rows))
    source = stream_of(spark, tmp_path, [*shuffled, (None, T0 + timedelta(days=20), None, None, None)], schema)
    got = observations.run(state.changes_only(source, "k", "at", "seq", ["v", "w"], "9 days", shards=1), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert same(got.select("seq", "at", "v", "w"), temporal.changed_only(spark.createDataFrame(rows, schema), "k", "at", ["v", "w"]).select("seq", "at", "v", "w"))


def test_gaps_of_many_keys_in_one_shard(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(f"k{rnd.randrange(20)}", T0 + timedelta(hours=rnd.randrange(24 * 9))) for _ in range(90)]
    source = stream_of(spark, tmp_path, [*rows, (None, T0 + timedelta(days=20))], "k string, at timestamp")
    got = observations.run(state.gap_days(source, "k", "at", "10 days", shards=1), f"{tmp_path}/out", f"{tmp_path}/cp")
    want = temporal.missing_days(spark.createDataFrame(rows, "k string, at timestamp"), "k", "at", F.lit(T0 + timedelta(days=10)), 30)
    assert same(got, want)


def test_anchors_are_joined_and_outlive_a_restart(spark, tmp_path):
    schema = "k long, at timestamp, seq long"
    newest = spark.createDataFrame([(1, T0 + timedelta(days=2), 0), (None, T0 + timedelta(days=2), 0)], schema)
    rows = [(1, T0, 1), (1, T0 + timedelta(days=2), 2), (None, T0, 3), (2, T0, 4)]
    source = stream_of(spark, tmp_path, rows, schema)
    run = lambda anchors: observations.quarantined(source, anchors, "k", "at", "seq", f"{tmp_path}/yes", f"{tmp_path}/no", f"{tmp_path}/cp").awaitTermination()
    run(newest)
    stream_of(spark, tmp_path, [(1, T0, 5), (1, T0 + timedelta(days=3), 6)], schema)
    run(newest.limit(0))  # what is stored later isn't asked
    rows += [(1, T0, 5), (1, T0 + timedelta(days=3), 6)]
    told = lambda name, ok: spark.read.schema(schema).parquet(f"{tmp_path}/{name}").select("k", "at", "seq", F.lit(ok).alias("accepted"))
    got = told("yes", True).union(told("no", False))
    assert same(got, runs.refuse_older(newest, spark.createDataFrame(rows, schema), "k", "at"))


def test_a_wave_is_not_cut_into_small_files(spark):
    rows = spark.range(6000).repartition(5).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("at"))
    source = streams.arrivals(rows, "at", "id % 10 = 3", "small", tick=False)
    to = streams.scratch(spark, "small_out")
    with state.state_store(spark):
        done = source.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/cp").trigger(availableNow=True).start()
        done.awaitTermination()
    assert len([p for p in done.recentProgress if p.numInputRows]) == streams.WAVES
    assert spark.read.parquet(f"{to}/out").count() == 6000
