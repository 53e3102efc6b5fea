from datetime import datetime, timedelta

from pyspark.sql import functions as F

from observatory.operators import quality, temporal
from observatory.plans.queries import QUERIES

NOW = datetime(2024, 3, 1)


def test_links_are_counted_in_each_window(spark):
    ago = lambda n: NOW - timedelta(days=n)
    seen = [(1, 1, ago(0), 9), (1, 1, ago(1), 8), (1, 1, ago(40), 1), (2, 1, ago(0), 5), (3, 2, ago(0), 5), (3, 2, ago(90), 4)]
    snapshots = spark.createDataFrame(seen, "repository_id long, developer_id long, at timestamp, n long")
    links = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "repository_id long, developer_id long")
    deltas = temporal.anchored_deltas(snapshots, ["repository_id", "developer_id"], "at", "n", F.lit(NOW))
    got = {r.window_days: tuple(r)[1:] for r in quality.link_windows(links, deltas, temporal.WINDOWS).collect()}
    # base of repository 1: a day ago, else 40 days ago, which is complete for 30 days alone; of repository 3: 90 days ago
    assert got == {1: (4, 2, 1, 3, 2, 1), 7: (4, 2, 0, 3, 2, 0), 30: (4, 2, 1, 3, 2, 1)}


def test_flags(spark):
    repos = spark.createDataFrame([(1, True, False), (2, False, True), (3, False, False)], "id long, is_archived boolean, is_fork boolean")
    newest = spark.createDataFrame([(1, NOW), (2, NOW - timedelta(hours=24))], "id long, seen timestamp")
    assert tuple(quality.repository_flags(repos, newest, F.lit(NOW)).first()) == (3, 1, 1, 1, 1)


def test_quality_queries_have_all_windows(spark, sf_dir):
    rows = QUERIES["developer_quality_windows"](spark, sf_dir).collect()
    assert {r.window_days for r in rows} == {1, 7, 30}
    assert QUERIES["quality_flags"](spark, sf_dir).first().repositories > 0


def test_cut_folders_can_be_cleared(spark):
    from pathlib import Path

    from observatory import shared

    rows = shared.cut(spark.range(5).toDF("x"), "clear")
    folder = Path(rows.inputFiles()[0].removeprefix("file://")).parent
    assert rows.count() == 5 and folder.exists()
    assert shared.clear(spark) >= 1 and not folder.exists() and shared.clear(spark) == 0


def test_json_has_the_bytes_of_json_dumps(spark):
    import json as plain
    import random

    from observatory.functions import json

    rnd = random.Random(2)
    kinds = ['"\\\n\r\t\f\b/', "\x00\x01\x1f\x7f", "aé~ß", " ퟿￿", "\U00010000\U0001d11e\U0010ffff", "plain text"]
    texts = [None, "", *kinds, *("".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randrange(40))) for _ in range(300)), 'x"' * 50_000]
    df = spark.createDataFrame([(i, t, [t, "b"]) for i, t in enumerate(texts)], "i long, t string, a array<string>")
    got = df.select("i", json.string(F.col("t")).alias("x"), json.string(F.col("t"), False).alias("y"), json.obj({"b": json.array(F.col("a"), json.string), "a": json.number(F.col("i"))}, True).alias("o")).collect()
    for r in got:
        t = texts[r.i]
        assert r.x == plain.dumps(t) and r.y == plain.dumps(t, ensure_ascii=False) and r.o == plain.dumps({"a": r.i, "b": [t, "b"]})


def test_fingerprint_is_that_of_canonical_json(spark):
    import hashlib
    import json

    rows = [(1, "k", "s", f"p{i % 7}é", {"b": "2", "a": str(i)} if i % 2 else None) for i in range(12)]
    items = spark.createDataFrame(rows, "entity long, kind string, source string, payload string, meta map<string,string>")
    ordered = sorted(((k, s, p, sorted((m or {}).items())) for _, k, s, p, m in rows))
    whole = sorted(({"id": f"E{i}", "kind": k, "source": s, "payload": p, "meta": m} for i, (k, s, p, m) in enumerate(ordered, 1)), key=lambda x: x["id"])
    got = quality.bundle_fingerprints(items, "entity", ["kind", "source", "payload"]).first()
    assert (got["items"], got.fingerprint) == (12, hashlib.sha256(json.dumps(whole).encode()).hexdigest())
