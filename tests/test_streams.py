"""The log's merges touch their days only; streams agree with their batch twins after restarts and in any order."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from observatory.operators import ingest, runs, temporal
from observatory.sources.store import ObservationLog
from observatory.streaming import observations, state

T0 = datetime(2024, 1, 1)
SCHEMA = "k long, at timestamp, v int, seq long"


def log_of(spark, tmp_path, schema=SCHEMA):
    return ObservationLog(spark, f"file://{tmp_path}/log", spark.createDataFrame([], schema).schema, ["k"], "at")


def files(tmp_path):
    return {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in Path(tmp_path, "log/data").rglob("*.parquet")}


def at(day, hour=0):
    return T0 + timedelta(days=day, hours=hour)


def values(log, version=None):
    return sorted((r.k, (r["at"] - T0).days, r.v) for r in log.read(version).collect())


def test_a_merge_writes_its_days_only(spark, tmp_path):
    log = log_of(spark, tmp_path)
    assert log.version() == 0 and log.read().count() == 0
    first = log.merge(spark.createDataFrame([(1, at(0), 1, 1), (1, at(1), 2, 2), (2, at(2), 3, 3)], SCHEMA), "seq", "s", 0)
    before = files(tmp_path)
    done = log.merge(spark.createDataFrame([(1, at(1), 9, 4), (3, at(1, 5), 4, 5)], SCHEMA), "seq", "s", 1)
    new = {p for p in files(tmp_path) if p not in before}
    assert first["days"] == ["2024-01-01", "2024-01-02", "2024-01-03"] and done["days"] == ["2024-01-02"]
    assert {p.parent.name for p in new} == {"__day=2024-01-02"} and all(files(tmp_path)[p] == t for p, t in before.items())
    assert values(log) == [(1, 0, 1), (1, 1, 9), (2, 2, 3), (3, 1, 4)] and values(log, 1) == [(1, 0, 1), (1, 1, 2), (2, 2, 3)]
    assert log.read(days=("2024-01-02", "2024-01-02")).count() == 2
    assert log.vacuum() == 1 and values(log) == [(1, 0, 1), (1, 1, 9), (2, 2, 3), (3, 1, 4)]


def test_a_repeated_batch_and_an_older_correction_change_nothing(spark, tmp_path):
    log = log_of(spark, tmp_path)
    batch = spark.createDataFrame([(1, at(0), 1, 5)], SCHEMA)
    log.merge(batch, "seq", "s", 0)
    kept = files(tmp_path)
    assert log.merge(spark.createDataFrame([(1, at(0), 7, 6)], SCHEMA), "seq", "s", 0)["days"] == [] and files(tmp_path) == kept
    log.merge(spark.createDataFrame([(1, at(0), 2, 4)], SCHEMA), "seq", "s", 1)
    assert values(log) == [(1, 0, 1)]
    assert log.merge(batch.limit(0), "seq", "s", 2)["days"] == [] and log.version() == 3
    with pytest.raises(Exception, match="without an instant"):
        log.merge(spark.createDataFrame([(1, None, 2, 4)], SCHEMA), "seq", "s", 3)


def test_two_writers_of_one_version(spark, tmp_path):
    log = log_of(spark, tmp_path)
    log.merge(spark.createDataFrame([(1, at(0), 1, 5)], SCHEMA), "seq")
    with pytest.raises(RuntimeError, match="another merge"):
        log._commit(1, {"parts": {}, "batches": {}})
    assert values(log) == [(1, 0, 1)]


def test_unknown_values_keep_what_is_stored(spark, tmp_path):
    log = log_of(spark, tmp_path, "k long, at timestamp, v int")
    log.merge(spark.createDataFrame([(1, at(0), 1, 5)], SCHEMA), "seq")
    log.merge(spark.createDataFrame([(1, at(0), None, 6)], SCHEMA), "seq", keep_if_null=("v",))
    assert values(log) == [(1, 0, 1)]


def landed(spark, tmp_path, rows, schema, per_file, name="in"):
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i : i + per_file], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.createDataFrame([], schema).schema


def test_cached_answers_after_a_restart_and_in_any_order(spark, tmp_path):
    rnd = random.Random(3)
    schema = "k long, at timestamp, seq long, document boolean, value string"
    rows = [(rnd.randrange(3), T0 + timedelta(minutes=rnd.randrange(3000)), i, rnd.random() < 0.3, f"v{i}") for i in range(120)]
    ttl, keep = timedelta(hours=3), timedelta(hours=9)
    want = sorted(map(tuple, ingest.cached_answers(spark.createDataFrame(rows, schema), "k", "at", "seq", "document", "value", ttl, keep).collect()))
    assert {w[2] for w in want} == {"hit", "stale", "miss"}
    tick = (None, T0 + timedelta(days=9), 999, None, None)
    made = lambda: state.answers(observations.replay(spark, f"{tmp_path}/in", typed), "k", "at", "seq", "document", "value", ttl, keep, "3 days")
    typed = landed(spark, tmp_path, rows[:70], schema, 40)
    half = observations.run(made(), f"{tmp_path}/out", f"{tmp_path}/cp").count()
    landed(spark, tmp_path, rows[70:] + [tick], schema, 30)
    got = observations.run(made(), f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    assert half < len(got) and sorted(map(tuple, got)) == want
    # all that was due is done: a third run adds nothing
    assert observations.run(made(), f"{tmp_path}/out", f"{tmp_path}/cp").count() == len(want)


def test_gap_days_are_told_once(spark, tmp_path):
    rows = [(k, at(d, h)) for k, days in {1: [0, 1, 4], 2: [2, 3]}.items() for d in days for h in (1, 20)]
    random.Random(1).shuffle(rows)
    typed = landed(spark, tmp_path, rows, "k long, at timestamp", 3)
    landed(spark, tmp_path, [(None, at(16))], "k long, at timestamp", 1)
    made = lambda: state.gap_days(observations.replay(spark, f"{tmp_path}/in", typed), "k", "at", "10 days")
    observations.run(made(), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r.key, r.day.day - 1) for r in observations.run(made(), f"{tmp_path}/out", f"{tmp_path}/cp").collect())
    assert got == [(1, 2), (1, 3), (1, 5), (2, 4), (2, 5)]
    batch = temporal.missing_days(spark.createDataFrame(rows, "k long, at timestamp"), "k", "at", F.lit(at(6)), 30)
    assert sorted((r.k, r.day.day - 1) for r in batch.collect()) == got


def test_quarantine_has_two_sinks(spark, tmp_path):
    newest = spark.createDataFrame([(1, at(5)), (1, at(3)), (2, at(1))], "k long, at timestamp")
    rows = [(1, at(4), 0, 1), (1, at(5), 0, 2), (2, at(0), 0, 3), (3, at(0), 0, 4), (1, at(9), 0, 5), (1, at(4, 1), 0, 6)]
    want = {r.seq: r.accepted for r in runs.refuse_older(newest, spark.createDataFrame(rows, SCHEMA), "k", "at").collect()}
    for turn in range(2):
        random.Random(turn).shuffle(rows)
        typed = landed(spark, tmp_path, rows, SCHEMA, 2, f"in{turn}")
        to = [f"{tmp_path}/{n}{turn}" for n in ("accepted", "refused", "cp")]
        observations.quarantined(observations.replay(spark, f"{tmp_path}/in{turn}", typed), newest, "k", "at", "seq", *to).awaitTermination()
        got = {r.seq: ok for path, ok in zip(to, (True, False)) for r in spark.read.schema(typed).parquet(path).collect()}
        assert got == want and set(want.values()) == {True, False}


def test_changes_wait_for_their_turn(spark, tmp_path):
    rows = [(1, at(d), v, d) for d, v in enumerate([1, 1, None, None, 2, 1])] + [(2, at(0), 5, 0)]
    want = sorted(r.seq + 100 * r.k for r in temporal.changed_only(spark.createDataFrame(rows, SCHEMA), "k", "at", ["v"]).collect())
    random.Random(5).shuffle(rows)
    typed = landed(spark, tmp_path, [*rows, (None, at(30), None, None)], SCHEMA, 2)
    got = observations.run(state.changes_only(observations.replay(spark, f"{tmp_path}/in", typed), "k", "at", "seq", ["v"], "20 days"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.seq + 100 * r.k for r in got.collect()) == want == [100, 102, 104, 105, 200]
