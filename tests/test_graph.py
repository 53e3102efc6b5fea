"""A graph of four developers, three repositories and two topics."""

import pytest
from pyspark.sql import functions as F

from observatory.operators import developers as dev
from observatory.operators import graph
from observatory.operators.components import connected_components


@pytest.fixture(scope="module")
def world(spark):
    people = spark.createDataFrame([(1, "alice"), (2, "bob"), (3, "carol"), (4, "dave")], "id long, login string")
    repos = spark.createDataFrame([(1, 1, "acme/core", 1.0), (2, 1, "acme/utils", 1.0), (3, 3, "web/app", 1.0)], "id long, owner_id long, full_name string, momentum double")
    topics = spark.createDataFrame([(1, "ai"), (2, "ai"), (2, "mcp"), (3, "mcp")], "repository_id long, topic string")
    links = spark.createDataFrame([(1, 1, 30), (2, 1, 20), (1, 2, 40), (2, 2, 10), (2, 3, 25), (3, 3, 35)], "developer_id long, repository_id long, contributions long")
    links = dev.shares(links).withColumn("delta", F.lit(None).cast("long")).withColumn("observations", F.lit(0).cast("long"))
    return people, repos, topics, links, dev.associated(links, repos)


def rows(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}


def test_reach(world):
    people, repos, topics, links, assoc = world
    d = rows(graph.developer_reach(people, assoc, topics), "developer_id", "contributed", "owned", "reached_developers", "reached_topics")
    assert d[1] == (2, 2, 1, 2) and d[2] == (3, 0, 2, 2) and d[4] == (0, 0, 0, 0)
    assert rows(graph.repository_reach(repos, links, assoc, topics), "repository_id", "contributors", "owner", "topics", "siblings")[1] == (2, 1, 1, 2)
    t = rows(graph.topic_reach(topics, assoc), "topic", "repositories", "contributing", "owning", "associated")
    assert t == {"ai": (2, 2, 1, 2), "mcp": (2, 3, 2, 3)}


def test_centrality(world):
    people, repos, topics, _, assoc = world
    assert rows(graph.developer_centrality(people, assoc), "developer_id", "degree", "weight") == {1: (1, 2), 2: (2, 3), 3: (1, 1), 4: (0, 0)}
    r = rows(graph.repository_centrality(repos, assoc), "repository_id", "degree", "weight")
    assert r[1] == (2, 4) and r[3] == (2, 2)
    assert rows(graph.topic_centrality(topics), "topic", "degree", "weight") == {"ai": (1, 1), "mcp": (1, 1)}


def test_components(world):
    people, repos, topics, links, _ = world
    got = rows(graph.components(graph.nodes(people, repos, topics), graph.edges(links, repos, topics)), "node", "component", "size")
    assert got["D:4"] == ("D:4", 1) and got["T:mcp"] == ("D:1", 8)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[501] == 500


def test_overlaps(world):
    _, _, topics, _, assoc = world
    got = {(r.a, r.b): r.score for r in graph.related_repositories(assoc, topics).collect()}
    assert got[1, 2] == pytest.approx(0.75) and got[1, 3] == pytest.approx(1 / 6)


def test_bridges(world):
    _, repos, topics, links, assoc = world
    got = {r.developer_id: r for r in graph.developer_bridges(assoc, links, topics, repos).collect()}
    assert got[2].memberships == 2 and not got[2].small_sample and got[2].bridge > 0.35
    assert got[2].contributions == 65  # a repository with two topics counts twice
    assert {r.developer_id for r in graph.cross_topic_bridges(assoc, links, topics, "ai", "mcp").collect()} == {1, 2}


def test_co_contributors_exclude_owners(world):
    _, repos, _, links, _ = world
    got = {(r.a, r.b): r.shared_repositories for r in graph.co_contributors(links, repos).collect()}
    assert got == {(1, 2): 2, (2, 3): 1}
