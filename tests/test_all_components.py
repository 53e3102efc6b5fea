"""The registered components over tables in which several components stand apart."""

from datetime import date

import pytest

from observatory.plans.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Repositories 1 (a, x), 2 (a, y), 3 (b, z), 4 (c, w) and 5 (d, v); 1 to 4 are owned by the developer of their number, 5 by none."""
    d = str(tmp_path_factory.mktemp("tables"))
    parts = [(i, b, t, 1) for i, (b, t) in enumerate([("A", "X"), ("A", "Y"), ("B", "Z"), ("C", "W"), ("D", "V")], 1)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i, f"S{i}", 1.0) for i in range(1, 9)], "s_suppkey long, s_name string, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    lines = [(1, 3, 6, date(2024, 1, 1), "N", "O"), (2, 4, 6, date(2024, 1, 2), "N", "O"), (3, 5, 7, date(2024, 1, 3), "N", "O")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_shipdate date, l_returnflag string, l_linestatus string").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_all_kinds_of_edges_join(spark, tables):
    got = {}
    for r in QUERIES["components"](spark, tables).collect():
        got.setdefault((r.component, r["size"]), set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [
        ["D:1", "D:2", "R:1", "R:2", "T:a", "T:x", "T:y"],  # a topic in common, owners
        ["D:3", "D:4", "D:6", "R:3", "R:4", "T:b", "T:c", "T:w", "T:z"],  # two single contributions of developer 6
        ["D:5"],
        ["D:7", "R:5", "T:d", "T:v"],
        ["D:8"],
    ]
    assert all((min(nodes), len(nodes)) == key for key, nodes in got.items())
