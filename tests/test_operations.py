"""Budgets against a loop, runs in parts, fingerprints that find one row, and one node's view."""

import random

import pytest
from pyspark.sql import functions as F

from observatory.operators import admission, graph, ingest, quality, runs, verify
from observatory.plans import operations


@pytest.mark.parametrize("seed", range(4))
def test_admission_is_that_of_a_loop(spark, seed):
    rnd = random.Random(seed)
    caps, total, used = {"a": rnd.randrange(30), "b": rnd.randrange(30)}, rnd.randrange(60), {"a": rnd.randrange(4), "total": rnd.randrange(8)}
    rows = [(i, rnd.choice(["a", "a", "a", "b", "other", None])) for i in range(150)]
    left, room, want = {k: v - used.get(k, 0) for k, v in caps.items()}, total - used["total"], {}
    for i, scope in rows:
        if room <= 0:
            want[i] = "total"
        elif scope in left and left[scope] <= 0:
            want[i] = scope
        else:
            room -= 1
            want[i] = None
            if scope in left:
                left[scope] -= 1
    df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "i long, scope string")
    got = admission.admit(df, ["i"], "scope", caps, total, used, parts=5).collect()
    assert {r.i: r.refused_by for r in got} == want and all(r.admitted == (r.refused_by is None) for r in got)


def test_admission_of_nothing(spark):
    assert admission.admit(spark.createDataFrame([], "i long, scope string"), ["i"], "scope", {"a": 1}, 1).count() == 0


CANDIDATE = "seq long, id long, category string, recipe string, query string"


@pytest.mark.parametrize(("most", "new"), [(25, 100), (100, 5), (100, 100), (12, 0)])
def test_a_run_in_parts_is_one_run(spark, most, new):
    rnd = random.Random(most)
    rows = [(i, rnd.randrange(20), rnd.choice("xy"), "r", "q") for i in range(40)]
    df, known = spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame([(i,) for i in range(0, 20, 3)], "id long")
    # the loop that it stands for
    have, staged, saved, examined, unique, stopped = set(), [], 0, 0, 0, None
    for seq, i, *_ in rows:
        if examined >= most:
            stopped = "max_candidates"
            break
        examined += 1
        if i in have:
            staged.append((seq, i, "duplicate"))
            continue
        unique += 1
        if i % 3 and saved >= new:
            stopped = "max_new_repositories"
            break
        have.add(i)
        saved += bool(i % 3)
        staged.append((seq, i, "saved" if i % 3 else "reused"))
    for parts in ([40], [11, 40], [5, 6, 30, 40]):
        prior = None
        for end in parts:
            prior = runs.discover(df.where(F.col("seq") < end), known, most, new, "r", prior)
        receipt = prior[2].first()
        assert sorted(map(tuple, prior[0].collect())) == staged and prior[1].count() == len(staged)
        assert (receipt.examined, receipt.unique, receipt.saved, receipt.stopped) == (examined, unique, saved, stopped)


def test_one_changed_row_is_found(spark):
    left = spark.range(500).select("id", (F.col("id") * 3).alias("v"), F.lit(None).cast("string").alias("w"))
    right = left.where("id <> 7").withColumn("v", F.when(F.col("id") == 99, 1).otherwise(F.col("v"))).union(spark.createDataFrame([(900, 1, "")], "id long, v long, w string"))
    assert sorted(map(tuple, verify.changes(left, right, ["id"]).collect())) == [(7, "removed"), (99, "changed"), (900, "added")]
    assert verify.changes(left, left.repartition(7).orderBy(F.desc("id")), ["id"]).count() == 0
    assert verify.differing_buckets(verify.fingerprint(left, ["id"]), verify.fingerprint(right, ["id"])).count() == 3
    twice = verify.fingerprint(left.union(left.where("id = 3")), ["id"]).orderBy(F.desc("level")).first()
    assert (twice["level"], twice.rows, twice.keys, twice.repeated_keys) == (3, 501, 500, 1)
    # null isn't empty, and columns don't run into each other
    pair = lambda v, w: spark.createDataFrame([(1, v, w)], "id long, v string, w string")
    for a, b in ((pair("", "x"), pair(None, "x")), (pair("a|1:b", "c"), pair("a", "1:b|c"))):
        assert [r.change for r in verify.changes(a, b, ["id"]).collect()] == ["changed"]
    empty = left.limit(0)
    assert verify.fingerprint(empty, ["id"]).count() == 0 and verify.changes(empty, left, ["id"]).count() == 500


@pytest.mark.parametrize(("dense", "group"), [(10_000, 256), (0, 0), (0, 3), (5, 2)])
def test_neighbours_by_pairs_or_bitmaps(spark, dense, group):
    rnd = random.Random(9)
    rows = list({(rnd.randrange(8), rnd.choice([1, 5, 40_000, -3, 10**12]) + rnd.randrange(4)) for _ in range(60)}) + [(99, 77)]
    want = {n: len({m for g, m in rows if (g, n) in rows} - {n}) for _, n in rows}
    df = spark.createDataFrame(rows + rows[:5], "g long, n long")
    assert {r.n: r.neighbours for r in graph.neighbours(df, "g", "n", dense, group).collect()} == want


def test_view_of_one_node(spark):
    kinds = {"D": "DEVELOPER", "R": "REPOSITORY", "T": "TOPIC"}
    names = [f"D:{i}" for i in range(9)] + [f"R:{i}" for i in range(9)] + ["T:a"]
    ranked = spark.createDataFrame([(kinds[n[0]], n, n, 100 - i, 1) for i, n in enumerate(names)], "node_type string, node string, label string, weight int, degree int")
    edges = spark.createDataFrame([("CONTRIBUTES_TO", f"D:{i}", "R:8") for i in range(9)] + [("TAGGED_WITH", "R:8", "T:a"), ("OWNS", "D:0", "R:0"), ("OWNS", "D:7", "R:7")], "edge_type string, source string, target string")
    nodes, shown = graph.focused(ranked, edges, "R:8", most=3, near=4)
    got = {r.node: r.near for r in nodes.collect()}
    assert got == {**{f"D:{i}": True for i in range(4)}, "R:8": True, "R:0": False, "R:1": False, "R:2": False, "T:a": False}
    assert sorted((r.source, r.target) for r in shown.collect()) == [("D:0", "R:0"), *((f"D:{i}", "R:8") for i in range(4)), ("R:8", "T:a")]
    # 3 * most at most, and a node that isn't there leaves the weightiest
    assert graph.focused(ranked, edges, "R:8", most=2, near=30)[0].count() == 6
    assert {r.node for r in graph.focused(ranked, edges, "R:x", most=1)[0].collect()} == {"D:0", "R:0", "T:a"}


def test_composition_of_the_first(spark):
    rows = spark.createDataFrame([(1, 3.0, "a"), (2, 3.0, None), (3, 2.0, "a"), (4, None, "b")], "id long, score double, band string")
    got = quality.ranking_composition(rows, "id", "score", ["band"], 1)
    assert sorted(map(tuple, got.collect())) == [("band", "a", 1, 2), ("band", "unknown", 0, 1)]


def test_runs_have_queries_over_all_events(spark, sf_dir):
    assert operations.discovery_run(spark, sf_dir).count() == 600


@pytest.mark.parametrize("seed", range(3))
def test_replays_are_those_of_a_loop(spark, seed):
    rnd = random.Random(seed)
    stored = {(k, None if k == 2 else "m") for k in range(5) if rnd.random() < 0.5}
    rows = [(i, rnd.randrange(8), rnd.choice(["m", None]), rnd.random() < 0.15) for i in range(60)]
    budget, have, want = rnd.randrange(12), set(stored), {}
    for i, k, m, force in rows:
        if (k, m) in have and not force:
            want[i] = "hit"
        elif budget > 0:
            budget -= 1
            have.add((k, m))
            want[i] = "call"
        else:
            want[i] = "refused"
    asked = spark.createDataFrame(rnd.sample(rows, len(rows)), "i long, k long, m string, force boolean")
    spent = sum(w == "call" for w in want.values()) + budget
    got = admission.replay(asked, spark.createDataFrame(sorted(stored, key=str), "k long, m string"), ["k", "m"], "i", "force", spent, parts=4)
    assert {r.i: r.outcome for r in got.collect()} == want


def test_edits_are_applied_by_version(spark):
    stored = spark.createDataFrame([(1, "v1", "a"), (2, "v1", "b"), (3, "v1", "c")], "id long, version string, status string")
    edits = [(1, "v1", "v2", False, "x"), (2, "v0", "v2", False, "x"), (3, "v1", "v2", True, None), (4, None, "v1", False, "new"), (5, None, "v1", True, None), (6, "v1", "v2", False, "x")]
    after, told = ingest.apply_edits(stored, spark.createDataFrame(edits, "id long, version string, new_version string, deleted boolean, status string"), "id")
    assert sorted(map(tuple, after.collect())) == [(1, "v2", "x"), (2, "v1", "b"), (4, "v1", "new")]
    assert dict(map(tuple, told.collect())) == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False}
