"""Neighbours of dense nodes equal those of pairs, whatever the groups."""

import random

import pytest

from observatory.operators import graph


def brute(rows):
    groups, out = {}, {}
    for by, node in rows:
        groups.setdefault(by, set()).add(node)
    for members in groups.values():
        for n in members:
            out.setdefault(n, set()).update(members)
    return {n: len(x) - 1 for n, x in out.items()}


@pytest.mark.parametrize("dense, group", [(4096, 256), (0, 3), (0, 0), (0, 10**9), (30, 8)])
def test_neighbours_by_tiles_and_pairs(spark, dense, group):
    rnd = random.Random(dense + group)
    ids = [rnd.randrange(120_000) for _ in range(150)] + [0, 8191, 8192, 32767, 32768, 5_000_000_000, -1, -40_000]
    rows = [(f"g{g}", n) for g in range(25) for n in rnd.sample(ids, rnd.choice([1, 2, 5, 20, 60]))]
    rows += [("all", n) for n in ids[:40]] + [("copy", n) for n in ids[:40]] + [("one", 77)] + rows[:9]
    got = graph.neighbours(spark.createDataFrame(rows, "g string, n long"), "g", "n", dense, group)
    assert {r.n: r.neighbours for r in got.collect()} == brute(rows) and got.columns == ["n", "neighbours"]


def test_large_groups_go_to_tiles_as_bits(spark):
    """What comes to the tiles grows with members, not with members times groups of bitmaps."""
    rows = spark.range(9000).selectExpr("id as n", "explode(sequence(1, 40)) as g").where("(n + g) % 50 <> 0")
    got = {r.neighbours for r in graph.neighbours(rows, "g", "n").collect()}
    assert got == {8999}
    batches = []

    def keep(row, col, own, places):
        import pyarrow as pa

        batches.append(pa.record_batch({"row": [row], "col": [col], "present": [3], "own": [own], "places": [places]}))

    two = lambda *x: b"".join(i.to_bytes(2, "little") for i in x)
    keep(0, 0, two(1, 2), two(0, 1)), keep(0, 0, two(2), two(2)), keep(1, 0, two(5), two(7))
    found = [(n, c) for b in graph._counted(iter(batches)) for n, c in zip(*(x.to_pylist() for x in b.columns))]
    assert found == [(1, 2), (2, 3), (8197, 1)]
