"""Pages, references, windows and run decisions on rows made for them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from observatory.operators import evidence, lists, runs


def test_windows_are_one_of_three():
    assert [lists.window_days(x) for x in (None, "1d", " 7D ", "30")] == [7, 1, 7, 30]
    for bad in ("2d", "d", "", "-7", "7dd", "\u0667"):
        with pytest.raises(ValueError):
            lists.window_days(bad)


def test_pages_have_bounds(spark):
    rows = spark.createDataFrame([(i,) for i in range(7)], "x int")
    got = lists.page(rows, [F.desc("x")], 3, 3).collect()
    assert [(r.place, r.x, r.total, r.has_more) for r in got] == [(4, 3, 7, True), (5, 2, 7, True), (6, 1, 7, True)]
    assert not lists.page(rows, [F.desc("x")], 3, 6).first().has_more and lists.page(rows.limit(0), [F.desc("x")]).count() == 0
    for limit, offset in ((0, 0), (101, 0), (5, -1)):
        with pytest.raises(ValueError):
            lists.page(rows, [F.desc("x")], limit, offset)


def test_missing_values_stand_last_or_first(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", 2.0, "rising"), ("c", 2.0, "new"), ("d", 1.0, "inactive")], "full_name string, momentum double, trend string")
    names = lambda *order: [r.full_name for r in rows.orderBy(*lists.repository_order(*order)).collect()]
    assert names("momentum") == ["c", "b", "d", "a"] and names("momentum", False) == ["a", "d", "b", "c"] and names("trend") == ["b", "c", "d", "a"]


def test_references(spark):
    refs = spark.createDataFrame([(x,) for x in ("7", "/o/r/", "O/R", "", None)], "ref string")
    repos = spark.createDataFrame([(7, "o/r"), (8, "7")], "id long, full_name string")
    assert {r.ref: r.id for r in lists.resolve(refs, repos).collect()} == {"7": 7, "/o/r/": 7, "O/R": None, "": None, None: None}


def test_artifacts_of_any_window_where_none_has_the_one_asked_for(spark):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "x", "k", "t", 7, at), (2, "x", "k", "t", 1, at)], "id long, entity_type string, entity_key string, artifact_type string, window_days int, generated_at timestamp")
    ids = lambda w: [r.id for r in lists.filter_artifacts(rows, "x", window=w).collect()]
    assert ids(7) == [1] and ids(30) == [2, 1] and ids(None) == [2, 1]


def test_scheduled_runs_wait_and_skip(spark):
    run = lambda i, kind, status, at, end: (i, kind, status, at, end)
    schema = "run_id long, kind string, status string, started_at timestamp, finished_at timestamp"
    monday = datetime(2024, 3, 4, 9)
    kinds = spark.createDataFrame([("refresh", datetime(2024, 3, 6, 1)), ("discover", datetime(2024, 3, 6, 1))], "kind string, now timestamp")
    done = [run(1, "refresh", "completed", monday, monday), run(2, "discover", "failed", monday, monday)]
    decide = lambda rows: {r.kind: (r.decision, r.prior_run) for r in runs.scheduled(spark.createDataFrame(rows, schema), kinds).collect()}
    assert decide(done) == {"refresh": ("run", None), "discover": ("skipped", 2)}
    assert decide([*done, run(3, "other", "running", monday, None)])["refresh"][0] == "blocked"


def test_plans_do_not_ask_twice(spark):
    recipes = spark.createDataFrame([("r", 1, 2, None, None, "stars")], "recipe string, min_stars int, max_stars int, created_within_days int, pushed_within_days int, sort string")
    twice = spark.createDataFrame([("a", "topic:x"), ("b", "topic:x")], "category string, query string")
    caps = dict.fromkeys(("search", "repository_details", "contributors", "profiles", "total"), 10)
    plan = runs.discovery_plan(twice, recipes, F.lit("2024-03-01").cast("date"), 10, 100)
    with pytest.raises(Exception, match="two cohorts"):
        runs.discovery_demand(plan, 5, caps).collect()
    got = {r.scope: (r.required, r.exceeded) for r in runs.discovery_demand(plan.where("category = 'a'"), 5, caps).collect()}
    assert got["profiles"] == (50, True) and got["search"] == (1, False) and got["total"] == (71, True)


def test_prompts_stay_within_their_budget(spark):
    items = spark.createDataFrame([("a", "E1", "k", "12345"), ("a", "E10", "k", "123456"), ("a", "E2", "k", "x"), ("b", "E1", "k", "1")], "entity string, evidence_id string, kind string, payload string")
    got = {r.entity: r for r in evidence.prompt(items, "entity", 8).collect()}
    assert got["a"].text == "[E1] kind=k\n12345\n\n[E10] kind=k\n123\n\n" + evidence.OMITTED and got["a"].chars == 8 and got["a"].omitted
    assert got["b"].text == "[E1] kind=k\n1" and not got["b"].omitted


def test_levels(spark):
    row = spark.range(1).select(lists.strongest([F.lit(None).cast("string"), F.lit("MEDIUM"), F.lit("LOW")]).alias("a"), lists.strongest([F.lit(None).cast("string")]).alias("b"), lists.developer_level(F.lit(False), F.lit(0.9), F.lit(0.5)).alias("c")).first()
    assert tuple(row) == ("MEDIUM", "LOW", "MEDIUM")
