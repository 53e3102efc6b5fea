"""Pairs of developers summed in tiles equal those by joins."""

import random

import pytest

from observatory.operators import graph


@pytest.mark.parametrize("paired", [0, 6, 10**6])
def test_tiles_equal_joins(spark, paired):
    rnd = random.Random(4)
    people = [rnd.randrange(3000) for _ in range(60)] + [1023, 1024, -5]
    links = [(r, p, rnd.choice([0.0, 0.1, 0.2, 0.3, -1.0]), rnd.choice([None, -1, 0, 4]), rnd.choice([0, 2])) for r in range(12) for p in set(rnd.sample(people, rnd.choice([2, 5, 30])))]
    repos = {r: rnd.choice([None, 1.5, 12.0]) for r in range(11)}  # one isn't there
    frame = spark.createDataFrame(links, "repository_id long, developer_id long, share double, delta long, observations long")
    got = graph.co_contributors(frame, spark.createDataFrame(list(repos.items()), "id long, momentum double"), paired)
    want = {}
    for r, a, *x in links:
        for q, b, *y in links:
            if r == q and a < b and r in repos:
                want.setdefault((a, b), []).append((repos[r], x, y))
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    seen = {(r.a, r.b): r for r in got.collect()}
    assert seen.keys() == want.keys()
    for pair, rows in want.items():
        terms = []
        for _, (_, d, _), (_, e, _) in rows:
            positive = (d or 0) > 0, (e or 0) > 0
            if d is not None or e is not None:
                terms.append(sum(positive) / 2 if d is not None and e is not None else sum(positive) * 0.25)
        r = seen[pair]
        assert r.shared_repositories == len(rows)
        assert r.share_term == pytest.approx(mean([max(0.0, min(x[0], y[0], 0.25) / 0.25) for _, x, y in rows]))
        assert r.mean_momentum == pytest.approx(mean([m for m, *_ in rows if m is not None])) and r.recent == pytest.approx(mean(terms))
        assert r.history == pytest.approx(mean([float(x[2] > 0 and y[2] > 0) for _, x, y in rows])) and r.recent_share == pytest.approx(mean([float(x[1] is not None and y[1] is not None) for _, x, y in rows]))
