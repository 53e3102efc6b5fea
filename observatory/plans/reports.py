"""Queries of profiles, cached answers, workspaces, landed documents and the page that shows the newest of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from observatory.functions import expr
from observatory.operators import admission, graph, ingest, lists, temporal
from observatory.plans import oracle, queries as base
from observatory.plans.queries import query
from observatory.sources import landing
from observatory.sources.domain import view

PROFILE_FIELDS = ["followers", "following", "public_repos"]


@query
def profile_field_deltas(s: SparkSession, d: str) -> DataFrame:
    """Followers, following and public repositories over windows; a field that isn't known at an end has no delta."""
    out = temporal.field_deltas(view(s, d, "profile_snapshots"), ["developer_id"], "captured_at", PROFILE_FIELDS, base._ref(s, d))
    return out.select("developer_id", "field", "window_days", "current", "base", "delta", "complete")


KEYS = ["entity_type", "entity_key", "artifact_type", "window_days", "fingerprint", "prompt_version", "model"]


def _artifact_keys(s: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.col("id") % c
    rows = view(s, d, "artifacts").withColumn("fingerprint", F.md5(key(5).cast("string"))).withColumn("prompt_version", F.concat(F.lit("v"), key(2))).withColumn("model", F.when(key(3) > 0, F.concat(F.lit("m"), key(3))))
    return rows.withColumn("entity_key", (F.col("entity_key").cast("long") % 3).cast("string"))


@query
def artifact_replays(s: SparkSession, d: str) -> DataFrame:
    """Requests by all seven key columns: a third of the artifacts is stored, the rest is asked for within 200 calls."""
    rows = _artifact_keys(s, d)
    asked = rows.where("id % 3 <> 1").withColumn("force", F.col("id") % 50 == 0)
    out = admission.replay(asked, rows.where("id % 3 = 1 and id % 2 = 0"), KEYS, "id", "force", 200)
    return out.select("id", "outcome")


@query
def cached_contributors(s: SparkSession, d: str) -> DataFrame:
    """Of each repository the contributors that its last fetch saw, three at most."""
    links = view(s, d, "links")
    fetched = links.groupBy(F.col("repository_id").alias("id")).agg(F.max("last_seen_at").alias("fetched_at"))
    return ingest.cached_contributors(links, view(s, d, "developers"), fetched, 3)


@query
def workspace_edits(s: SparkSession, d: str) -> DataFrame:
    """A workspace after edits, additions and deletions, some by a version that is gone."""
    every = view(s, d, "supplier").select(F.col("s_suppkey").alias("developer_id"))
    status = F.element_at(F.array(*map(F.lit, ["interested", "contacted", "declined"])), F.col("developer_id").cast("int") % 3 + 1)
    stored = every.where("developer_id % 2 = 0").select("developer_id", F.lit("v1").alias("version"), status.alias("status"))
    edits = every.where("developer_id % 5 <> 0").select(
        "developer_id", F.when(F.col("developer_id") % 7 < 4, "v1").when(F.col("developer_id") % 7 < 6, "v0").alias("version"), F.lit("v2").alias("new_version"), (F.col("developer_id") % 3 == 0).alias("deleted"), F.lit("edited").alias("status")
    )
    return ingest.apply_edits(stored, edits, "developer_id")[0]


@query
def landed_repositories(s: SparkSession, d: str) -> DataFrame:
    """Repositories landed as documents, with watchers by subscribers where those are told, and what is read from them."""
    rows = view(s, d, "dense_repositories")
    doc = F.struct(
        F.col("id"), "full_name", F.struct((F.col("id") % 9).alias("id"), F.concat(F.lit("org"), F.col("id") % 9).alias("login")).alias("owner"), F.col("primary_language").alias("language"), F.col("is_fork").alias("fork"), F.col("is_archived").alias("archived"),
        (F.col("id") * 3).cast("int").alias("stargazers_count"), F.lit(9).alias("watchers_count"), F.when(F.col("id") % 2 == 0, F.col("id").cast("int")).alias("subscribers_count"), F.array(F.lit("a"), F.lit("b")).alias("topics"),
    )
    found = landing.repositories(rows.select(F.to_json(doc).alias("body")))
    return found.select("github_id", "full_name", "owner_login", "primary_language", "is_fork", "is_archived", "stars", "watchers", F.size("topics").alias("topics"))


@query
def landed_contributors(s: SparkSession, d: str) -> DataFrame:
    """Lists of contributors landed as documents, in which ids come twice: of the first eight entries the last of an id stands."""
    rows = view(s, d, "events").select(F.col("user_id").alias("repository_id"), "event_id", (F.col("event_id") % 5).alias("id"))
    entry = F.struct("event_id", F.struct(F.col("id"), F.concat(F.lit("dev"), "id").alias("login"), F.col("event_id").cast("int").alias("contributions")).alias("c"))
    lists = rows.groupBy("repository_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["c"])).alias("body"))
    return landing.contributors(lists, 8)


@query
def landed_users(s: SparkSession, d: str) -> DataFrame:
    """Profiles landed as documents; unknown fields stay unknown."""
    doc = F.struct(F.col("id"), "login", F.when(F.col("id") % 2 == 0, F.col("followers").cast("int")).alias("followers"), (F.col("id") % 4).cast("int").alias("public_repos"))
    return landing.users(view(s, d, "developers").select(F.to_json(doc).alias("body"))).select("id", "login", "followers", "following", "public_repos")


@query
def landed_texts(s: SparkSession, d: str) -> DataFrame:
    """Files and commits landed as base64 and messages: hash of the text, and the line of the commit."""
    rows = view(s, d, "documents").select("doc_id", "text")
    body = F.base64(F.encode("text", "UTF-8"))
    return rows.select("doc_id", F.sha2(landing.readme_text(body), 256).alias("readme_sha256"), landing.commit_line(F.md5(F.col("doc_id").cast("string")), F.col("text")).alias("commit"))


@query
def explore(s: SparkSession, d: str) -> DataFrame:
    """One page of the newest signals: the first five repositories, topics, emerging developers and bridges, and how many there are."""
    def first(rows: DataFrame, name: str, key: str, score: str, ties: str | None = None) -> DataFrame:
        top = rows.orderBy(F.desc(score), ties or key).limit(5)
        return top.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.col(score).cast("double").alias("value"))

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.count("*").cast("double").alias("value")).select(F.lit("counts").alias("section"), F.lit(name).alias("key"), "value")

    scored = base.dense_scored(s, d).where("momentum is not null").select("repository_id", F.round("momentum", 6).alias("momentum"))
    developers = base.emerging(s, d).where("label = 'EMERGING'")
    parts = [
        first(scored, "repositories", "repository_id", "momentum"), first(base.topic_aggregates(s, d), "topics", "topic", "total_momentum"), first(developers, "emerging", "developer_id", "emerging"),
        first(base.developer_bridges(s, d), "bridges", "developer_id", "bridge"), count(scored, "ranked"), count(view(s, d, "dense_repositories"), "tracked"), count(developers, "emerging"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query
def evidence_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges with contributions, shares and observations; a tenth of the developers isn't tracked."""
    links, repos, _, topics = base._graph(s, d)
    out = graph.evidence_edges(links, repos, topics, view(s, d, "developers").where("id % 10 <> 0"))
    return out.withColumn("share", F.round("share", 6))


PAIRS = [("size-1", "size-2"), ("brand#1", "large")]


@query
def cross_topic_repositories(s: SparkSession, d: str) -> DataFrame:
    """Repositories that bridge two topics, for some pairs."""
    _, _, assoc, topics = base._graph(s, d)
    found = [graph.shared_between(assoc, topics, a, b).select(F.lit(f"{a} and {b}").alias("pair"), "repository_id", "developers") for a, b in PAIRS]
    return found[0].union(found[1])


@query
def synthesis_levels(s: SparkSession, d: str) -> DataFrame:
    """Coverage of a text on the ecosystem, on a bridge of two topics, and on each topic."""
    nodes, edges = base.graph_nodes(s, d), base.graph_edges(s, d).where("edge_type = 'TAGGED_WITH'")
    there = nodes.select("node_type").distinct().union(edges.select("edge_type").distinct()).select(F.lit("MEDIUM").alias("level"))
    top = base.developer_bridges(s, d).orderBy(F.desc("bridge"), "developer_id").limit(5).select("level")
    ecosystem = there.union(top).agg(expr.strongest(F.col("level")).alias("level")).select(F.lit("ecosystem").alias("entity"), "level")
    bridge = base.cross_topic_bridges(s, d).orderBy(F.desc("bridge"), "developer_id").limit(10).agg(expr.strongest(F.col("level")).alias("level")).select(F.lit("size-1 and size-3").alias("entity"), "level")
    topics = base.topic_aggregates(s, d).select(F.col("topic").alias("entity"), F.col("confidence_level").alias("level"))
    return ecosystem.union(bridge).union(topics)


@query
def developers_with_contact(s: SparkSession, d: str) -> DataFrame:
    """Developers with a public address, site or name elsewhere; blank fields are none."""
    field = lambda n, text: F.when(F.col("id") % n == 0, text).when(F.col("id") % n == 1, "  ")
    rows = view(s, d, "developers").withColumn("public_email", field(3, "a@example.com")).withColumn("blog", field(5, "https://example.com")).withColumn("twitter_username", field(7, "x"))
    return rows.where(lists.has_contact("public_email", "blog", "twitter_username")).select("id", "login")


_FIELDS = " UNION ALL ".join(f"SELECT developer_id, captured_at, '{f}' AS field, CAST({f} AS BIGINT) AS v FROM {{profile_snapshots}}" for f in PROFILE_FIELDS)
_KEYED = "(SELECT id, entity_type || '|' || CAST(CAST(entity_key AS BIGINT) % 3 AS VARCHAR) || '|' || artifact_type || '|' || window_days || '|' || id % 5 || '|' || id % 2 || '|' || id % 3 AS k FROM {artifacts})"


def _five(rows: str, section: str, key: str, score: str) -> str:
    return f"SELECT * FROM (SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, CAST({score} AS DOUBLE) AS value FROM {rows} q ORDER BY {score} DESC, {key} LIMIT 5) z"


_MOMENTUM = "(SELECT repository_id, round(momentum, 6) AS momentum FROM {scored} WHERE momentum IS NOT NULL)"
_EMERGING = f"(SELECT * FROM ({oracle.QUERIES['emerging']}) e WHERE label = 'EMERGING')"
QUERIES_SQL = {
    "profile_field_deltas": f"WITH f AS MATERIALIZED ({_FIELDS}) SELECT c.developer_id, c.field, d.days AS window_days, u.v AS current, CASE WHEN b.captured_at < u.captured_at THEN b.v END AS base, CASE WHEN b.captured_at < u.captured_at THEN u.v - b.v END AS delta, coalesce(b.captured_at < u.captured_at AND u.v - b.v IS NOT NULL AND (epoch_us(c.ref) - epoch_us(b.captured_at)) / 86400e6 - d.days <= d.days * 0.5, false) AS complete FROM (SELECT DISTINCT developer_id, field, ref, ref - INTERVAL 1 DAY AS t1, ref - INTERVAL 7 DAY AS t7, ref - INTERVAL 30 DAY AS t30 FROM f, {{ref}}) c CROSS JOIN (VALUES (1), (7), (30)) d(days) ASOF JOIN f u ON u.developer_id = c.developer_id AND u.field = c.field AND u.captured_at <= c.ref ASOF LEFT JOIN f b ON b.developer_id = c.developer_id AND b.field = c.field AND b.captured_at <= CASE d.days WHEN 1 THEN t1 WHEN 7 THEN t7 ELSE t30 END",
    "artifact_replays": f"WITH a AS (SELECT *, id % 50 = 0 AS force, k IN (SELECT k FROM {_KEYED} s WHERE id % 3 = 1 AND id % 2 = 0) AS known FROM {_KEYED} x WHERE id % 3 <> 1), c AS (SELECT *, force OR (NOT known AND row_number() OVER (PARTITION BY k ORDER BY id) = 1) AS calls FROM a), n AS (SELECT *, sum(calls::INT) OVER (ORDER BY id) AS place FROM c), o AS (SELECT *, first_value(place) OVER (PARTITION BY k ORDER BY id) AS start FROM n) SELECT id, CASE WHEN calls THEN CASE WHEN place <= 200 THEN 'call' ELSE 'refused' END WHEN known OR start <= 200 THEN 'hit' ELSE 'refused' END AS outcome FROM o",
    "cached_contributors": "SELECT repository_id, CAST(place AS INTEGER) AS place, developer_id, login, contributions FROM (SELECT l.repository_id, l.developer_id, d.login, l.contributions, row_number() OVER (PARTITION BY l.repository_id ORDER BY l.contributions DESC, l.developer_id) AS place FROM {links} l JOIN {developers} d ON d.id = l.developer_id WHERE l.last_seen_at = (SELECT max(x.last_seen_at) FROM {links} x WHERE x.repository_id = l.repository_id)) y WHERE place <= 3",
    "workspace_edits": "WITH e AS (SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS stored, CASE WHEN s_suppkey % 5 <> 0 THEN CASE WHEN s_suppkey % 7 < 4 THEN 'v1' WHEN s_suppkey % 7 < 6 THEN 'v0' ELSE 'none' END END AS edit, s_suppkey % 3 = 0 AS deleted FROM {supplier}), r AS (SELECT *, coalesce((stored AND edit = 'v1') OR (NOT stored AND edit = 'none' AND NOT deleted), false) AS applied FROM e) SELECT id AS developer_id, CASE WHEN applied THEN 'v2' ELSE 'v1' END AS version, CASE WHEN applied THEN 'edited' ELSE CASE id % 3 WHEN 0 THEN 'interested' WHEN 1 THEN 'contacted' ELSE 'declined' END END AS status FROM r WHERE (stored AND NOT (applied AND deleted)) OR (NOT stored AND applied)",
    "landed_repositories": "SELECT id AS github_id, full_name, 'org' || id % 9 AS owner_login, primary_language, is_fork, is_archived, CAST(id * 3 AS INTEGER) AS stars, CAST(CASE WHEN id % 2 = 0 THEN id ELSE 9 END AS INTEGER) AS watchers, 2 AS topics FROM {dense_repositories}",
    "landed_contributors": "SELECT user_id AS repository_id, event_id % 5 AS developer_id, 'dev' || event_id % 5 AS login, CAST(max(event_id) AS INTEGER) AS contributions FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {events}) x WHERE n <= 8 GROUP BY ALL",
    "landed_users": "SELECT id, login, CASE WHEN id % 2 = 0 THEN CAST(followers AS INTEGER) END AS followers, CAST(NULL AS INTEGER) AS following, CAST(id % 4 AS INTEGER) AS public_repos FROM {developers}",
    "landed_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS readme_sha256, substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) || ' ' || CASE WHEN trim(split_part(coalesce(text, ''), chr(10), 1)) = '' THEN '—' ELSE trim(split_part(coalesce(text, ''), chr(10), 1)) END AS commit FROM {documents}",
    "evidence_edges": "SELECT g.edge_type, g.source, g.target, a.contributions, round(a.share, 6) AS share, a.observations FROM {graph_edges} g LEFT JOIN {act} a ON g.edge_type = 'CONTRIBUTES_TO' AND g.source = 'D:' || a.developer_id AND g.target = 'R:' || a.repository_id WHERE g.edge_type = 'TAGGED_WITH' OR g.source IN (SELECT 'D:' || id FROM {developers} WHERE id % 10 <> 0)",
    "cross_topic_repositories": " UNION ALL ".join(f"SELECT '{a} and {b}' AS pair, a.repository_id, count(DISTINCT a.developer_id) AS developers FROM {{assoc}} a WHERE a.repository_id IN (SELECT repository_id FROM {{repository_topics}} WHERE topic = '{a}') AND a.repository_id IN (SELECT repository_id FROM {{repository_topics}} WHERE topic = '{b}') GROUP BY 2" for a, b in PAIRS),
    "synthesis_levels": f"SELECT 'ecosystem' AS entity, CASE WHEN max(CASE WHEN level = 'HIGH' THEN 1 ELSE 0 END) = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM (SELECT level FROM ({oracle.QUERIES['developer_bridges']}) b ORDER BY bridge DESC, developer_id LIMIT 5) x UNION ALL SELECT 'size-1 and size-3', coalesce(max_by(level, CASE level WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END), 'LOW') FROM (SELECT level FROM ({oracle.QUERIES['cross_topic_bridges']}) c ORDER BY bridge DESC, developer_id LIMIT 10) y UNION ALL SELECT topic, confidence_level FROM ({oracle.QUERIES['topic_aggregates']}) t",
    "developers_with_contact": "SELECT id, login FROM {developers} WHERE id % 3 = 0 OR id % 5 = 0 OR id % 7 = 0",
    "explore": " UNION ALL ".join([_five(_MOMENTUM, "repositories", "repository_id", "momentum"), _five(f"({oracle.QUERIES['topic_aggregates']})", "topics", "topic", "total_momentum"), _five(_EMERGING, "emerging", "developer_id", "emerging"), _five(f"({oracle.QUERIES['developer_bridges']})", "bridges", "developer_id", "bridge"), f"SELECT 'counts', 'ranked', CAST(count(*) AS DOUBLE) FROM {_MOMENTUM} m", "SELECT 'counts', 'tracked', CAST(count(*) AS DOUBLE) FROM {dense_repositories} r", f"SELECT 'counts', 'emerging', CAST(count(*) AS DOUBLE) FROM {_EMERGING} e"]),
}
ORACLE_SQL = {k: oracle.sql(v) for k, v in QUERIES_SQL.items()}
