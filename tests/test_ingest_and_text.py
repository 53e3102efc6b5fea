from datetime import datetime, timedelta

from pyspark.sql import functions as F

from observatory.functions import expr, text
from observatory.operators import ingest, quality
from observatory.sources import landing
from observatory.sources.store import ObservationLog
from observatory.streaming import observations

T0 = datetime(2024, 1, 1)


def test_same_instant_replaces_and_new_one_appends(spark):
    stored = spark.createDataFrame([(1, T0, 5)], "k long, at timestamp, v int")
    new = spark.createDataFrame([(1, T0, 6, 1), (1, T0, 7, 2), (1, T0 + timedelta(days=1), 8, 3)], "k long, at timestamp, v int, seq long")
    assert sorted(r.v for r in ingest.record(stored, new, ["k"], "at", "seq").collect()) == [7, 8]


def test_known_owner_outlives_an_unknown_one(spark):
    stored = spark.createDataFrame([(1, 9, "a")], "id long, owner_id long, name string")
    new = spark.createDataFrame([(1, None, "b", 1), (2, None, "c", 1)], "id long, owner_id long, name string, seq long")
    assert sorted(map(tuple, ingest.upsert(stored, new, ["id"], "seq", ("owner_id",)).collect())) == [(1, 9, "b"), (2, None, "c")]


def test_unchanged_observation_is_left_out(spark):
    stored = spark.createDataFrame([(1, T0, 5, None)], "k long, at timestamp, v int, w int")
    new = spark.createDataFrame([(1, T0 + timedelta(days=1), 5, None), (1, T0 + timedelta(days=2), 6, None), (2, T0, 5, None)], "k long, at timestamp, v int, w int")
    assert sorted((r.k, r.v) for r in ingest.record_if_changed(stored, new, "k", "at", ["v", "w"]).collect()) == [(1, 5), (1, 6), (2, 5)]


def test_topics_are_replaced_and_normalised(spark):
    stored = spark.createDataFrame([(1, "old"), (1, "ai"), (2, "x")], "repository_id long, topic string")
    new = spark.createDataFrame([(1, " AI\t"), (1, ""), (1, "New")], "repository_id long, topic string")
    assert sorted(map(tuple, ingest.replace_topics(stored, new).collect())) == [(1, "ai"), (1, "new"), (2, "x")]
    assert ingest.topic_changes(stored, new).first()[1:] == (["new"], ["old"])


def test_first_candidate_and_versions(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "id long, name string, seq long")
    assert sorted((r.id, r.name, r.duplicates) for r in ingest.first_of(df, "id", "seq").collect()) == [(1, "a", 1), (2, "c", 0)]
    stored = spark.createDataFrame([(1, "v1")], "id long, version string")
    edits = spark.createDataFrame([(1, "v0"), (2, None)], "id long, version string")
    assert sorted(map(tuple, ingest.compare_and_swap(stored, edits, "id").collect())) == [(1, False), (2, True)]


def test_stream_equals_batch(spark, tmp_path):
    schema = "k long, at timestamp, v int, seq long"
    rows = [(1, T0, 1, 1), (1, T0 + timedelta(days=2), 2, 2), (1, T0, 9, 3), (2, T0, 4, 4)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = ObservationLog(spark, f"file://{tmp_path}/log", spark.createDataFrame([], schema).schema, ["k"], "at")
    q = observations.record_stream(observations.replay(spark, str(tmp_path / "in"), schema), log, "seq", str(tmp_path / "cp"))
    q.awaitTermination()
    assert q.exception() is None
    got = sorted((r.k, r["at"], r.v) for r in log.read().collect())
    assert [(k, v) for k, _, v in got] == [(1, 9), (1, 2), (2, 4)]


def test_text(spark):
    one = spark.createDataFrame([("\x07 a \r\nb  \n ",), ("  ",), ("x" * 9,)], "t string")
    assert [r[0] for r in one.select(text.normalize_excerpt(F.col("t"), 5)).collect()] == ["a\nb", "—", "xxxxx …[truncated]"]
    row = spark.range(1).select(text.redact(F.lit("k=abcdefgh s=short"), ["abcdefgh", "short"]).alias("r"), text.evidence_ids(F.lit("E10 E2 xE3 E2")).alias("e"), text.secrets_present(F.lit("abcdefgh"), ["abcdefgh", "zz"]).alias("s")).first()
    assert row.r == "k=[REDACTED] s=short" and row.e == ["E10", "E2"] and row.s == ["abcdefgh"]
    assert spark.range(1).select(expr.bounded(F.lit(None).cast("double"))).first()[0] is None


def test_receipts_and_scaling(spark):
    runs = spark.createDataFrame([("done", '{"candidates_examined":6,"new_repositories_saved":5,"existing_repositories_reused":1,"partial":false}', '{"search":2,"profiles":5}')], "status string, report_json string, requests_json string")
    stats = quality.collection_stats(runs)
    assert stats.first().requests == 7
    assert [tuple(r) for r in quality.scaling(stats).collect()] == [(50, 70), (100, 140), (300, 420), (500, 700)]


def test_landed_documents(spark):
    raw = spark.createDataFrame([(1, '[{"id":5,"login":"a","contributions":1},{"id":5,"login":"a","contributions":2},{"id":6,"login":"b"}]', '{"id":3,"full_name":"o/r","owner":{"id":1,"login":"o"},"subscribers_count":4,"watchers_count":9,"topics":["x"]}')], "repository_id long, body string, repo string")
    assert [(r.developer_id, r.contributions) for r in landing.contributors(raw, 2).collect()] == [(5, 2)]
    assert landing.repositories(raw, "repo").first().watchers == 4
    assert spark.range(1).select(landing.readme_text(F.lit("aGk=")), landing.commit_line(F.lit("0123456789abcdef"), F.lit(" \nx"))).first()[:] == ("hi", "0123456789ab —")
