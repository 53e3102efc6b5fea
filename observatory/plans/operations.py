"""Queries of budgets, bounded runs, verification of tables, ranking diagnostics and the view of one node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from observatory.functions import expr
from observatory.operators import admission, graph, quality, runs, verify
from observatory.plans import oracle, queries as base
from observatory.plans.queries import query
from observatory.shared import cut
from observatory.sources import landing
from observatory.sources.domain import view

# ---- budgets and runs

CAPS, TOTAL = {"search": 120, "repository_details": 150, "contributors": 90, "profiles": 160}, 450
_SCOPES = {"purchase": "search", "click": "repository_details", "view": "contributors", "signup": "profiles"}


@query
def admitted_requests(s: SparkSession, d: str) -> DataFrame:
    """Requests in the order of time under a cap for each scope and one for all; errors have no scope."""
    scope = reduce(lambda w, kv: w.when(F.col("event_type") == kv[0], kv[1]), _SCOPES.items(), F.when(F.lit(False), "x"))
    rows = view(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), scope.alias("scope"))
    return admission.admit(rows, ["at", "event_id"], "scope", CAPS, TOTAL).select("event_id", "scope", "admitted", "refused_by")


#: Most candidates and most new repositories of the runs of ``discovery_receipts``.
LIMITS = [(600, 1000), (1000000, 50), (1000000, 1000), (40, 1000)]


def _candidates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as search results: many name a repository again, a third of the ids are known."""
    rows = view(s, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 301).alias("id"), F.col("event_type").alias("category"), F.concat(F.lit("r"), F.col("event_id") % 3).alias("recipe"), F.col("props").alias("query"))
    return rows, rows.where("id % 3 = 0").select("id").distinct()


@query
def discovery_run(s: SparkSession, d: str) -> DataFrame:
    """A run of 600 candidates in two parts, cut after seq 250."""
    rows, known = _candidates(s, d)
    half = runs.discover(rows.where("seq <= 250"), known, *LIMITS[0], "run-1")
    staged, _, _ = runs.discover(rows, known, *LIMITS[0], "run-1", half)
    return staged.select("seq", "id", "outcome")


@query
def discovery_provenance(s: SparkSession, d: str) -> DataFrame:
    """Where the candidates of the run come from."""
    rows, known = _candidates(s, d)
    _, noted, _ = runs.discover(rows, known, *LIMITS[0], "run-1")
    return quality.cohorts(noted)


@query
def discovery_receipts(s: SparkSession, d: str) -> DataFrame:
    """Receipts of runs with other limits."""
    rows, known = _candidates(s, d)
    receipts = [runs.discover(rows, known, *limits, "run")[2].select(F.lit(i).alias("run"), "examined", "unique", "saved", "reused", "duplicates", "stopped") for i, limits in enumerate(LIMITS)]
    return reduce(DataFrame.unionAll, receipts)


_RUN = """(SELECT *, sum(CASE WHEN outcome = 'saved' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS new FROM (SELECT seq, id, category, recipe, query, row_number() OVER (ORDER BY seq) AS place,
    CASE WHEN row_number() OVER (PARTITION BY id ORDER BY seq) > 1 THEN 'duplicate' WHEN id % 3 = 0 THEN 'reused' ELSE 'saved' END AS outcome
    FROM (SELECT event_id AS seq, event_id * 7919 % 301 AS id, event_type AS category, 'r' || event_id % 3 AS recipe, props AS query FROM {events}) x) y)"""

# ---- landed pages


@query
def followed_pages(s: SparkSession, d: str) -> DataFrame:
    """Events as pages of ten of their user's, as a listing would land them, followed up to 25 items.

    A fifth of the users has a page cut short after the first one, at which the listing ends.
    """
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = view(s, d, "events").select("user_id", "event_id", "event_type", place.alias("n")).withColumn("page", F.floor(F.col("n") / 10).cast("int") + 1)
    rows = rows.where(~((F.col("user_id") % 5 == 0) & (F.col("page") == 2) & (F.col("n") % 10 > 6)))
    item = F.struct("n", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("name"))).alias("j"))
    pages = rows.groupBy("user_id", "page").agg(F.array_sort(F.collect_list(item)).alias("x"))
    last = F.max("page").over(Window.partitionBy("user_id"))
    body = F.concat(F.lit('{"incomplete_results":false,"items":['), F.array_join(F.transform("x", lambda e: e["j"]), ","), F.lit("]}"))
    link = F.when(F.col("page") < last, F.concat(F.lit("<https://api.example.com/users/"), F.col("user_id"), F.lit("/events?page="), F.col("page") + 1, F.lit('>; rel="next"')))
    landed = pages.select(F.col("user_id").alias("chain"), "page", F.concat(F.lit("https://api.example.com/users/"), F.col("user_id"), F.lit("/events")).alias("url"), F.lit(200).alias("status"), link.alias("link"), body.alias("body"))
    return landing.follow(landed, 10, 25, "items").select("chain", "page", "position", F.get_json_object("item", "$.id").cast("long").alias("id"))


# ---- verification

_KEPT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _orders(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "orders").select(*_KEPT)


def _restored(s: SparkSession, d: str) -> DataFrame:
    """The orders again, but one is gone, one differs, and one is new."""
    rows = _orders(s, d)
    low, high = rows.agg(F.min("o_orderkey")).scalar(), rows.agg(F.max("o_orderkey")).scalar()
    edited = rows.where(F.col("o_orderkey") != low).withColumn("o_orderpriority", F.when(F.col("o_orderkey") == high, "0-NONE").otherwise(F.col("o_orderpriority")))
    return edited.union(rows.where(F.col("o_orderkey") == high).select(F.col("o_orderkey") + 1, *_KEPT[1:]))


@query
def table_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return verify.fingerprint(_orders(s, d), ["o_orderkey"])


@query
def changed_orders(s: SparkSession, d: str) -> DataFrame:
    """What differs between the orders and what was restored."""
    return verify.changes(_orders(s, d), _restored(s, d), ["o_orderkey"])


@query
def broken_references(s: SparkSession, d: str) -> DataFrame:
    """Suppliers that line items name and a partial restore doesn't have."""
    return verify.broken_references(view(s, d, "lineitem"), "l_suppkey", view(s, d, "supplier").where("s_suppkey % 3 <> 0"), "s_suppkey")


_LINE = " || '|' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in [_KEPT[0], *sorted(_KEPT[1:])])
_MD5 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
_LEAVES = f"""(SELECT {_MD5.format('k')} % 4096 AS bucket, sum(n) AS rows, count(*) AS keys, count(*) FILTER (n > 1) AS repeated_keys, sum(h) AS sum FROM
    (SELECT length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey AS k, count(*) AS n, sum(CAST({_MD5.format(_LINE)} AS HUGEINT)) AS h FROM {{orders}} GROUP BY 1) x GROUP BY 1)"""

# ---- ranking


def _provenance(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "events").where("event_type <> 'error' or event_id % 2 = 0").select(F.col("user_id").alias("repository_id"), F.col("event_type").alias("category"), F.concat(F.lit("r"), F.col("event_id") % 3).alias("recipe")).where("repository_id % 5 <> 0 and (category <> 'view' or repository_id % 2 = 0)")


@query
def cohort_counts(s: SparkSession, d: str) -> DataFrame:
    return quality.cohorts(_provenance(s, d))


@query
def provenance_coverage(s: SparkSession, d: str) -> DataFrame:
    return quality.provenance_coverage(view(s, d, "dense_repositories"), _provenance(s, d)).withColumn("largest_share", F.round("largest_share", 6))


@query
def ranking_composition(s: SparkSession, d: str) -> DataFrame:
    """How the ten repositories of most momentum are made up, against all ranked."""
    now = base.end_of(base.dense(s, d), "captured_at")
    repos = view(s, d, "dense_repositories").select(F.col("id").alias("repository_id"), F.col("primary_language").alias("language"))
    rows = base.dense_scored(s, d).join(repos, "repository_id").select("repository_id", F.round("momentum", 6).alias("momentum"), "language", "trend", expr.star_band(F.col("latest.stars")).alias("stars"), expr.age_band(expr.days(now, F.col("first_at"))).alias("age"))
    return quality.ranking_composition(rows, "repository_id", "momentum", ["stars", "age", "language", "trend"])


@query
def ranking_cautions(s: SparkSession, d: str) -> DataFrame:
    return quality.ranking_cautions(base.dense_scored(s, d), 30)


@query
def developer_cautions(s: SparkSession, d: str) -> DataFrame:
    """Fame and single-repository evidence of all developers and of the first ten."""
    links, repos, assoc, topics = base._graph(s, d)
    labelled = base._labelled(s, d, links, repos).select("developer_id", "label", F.round("emerging", 6).alias("score"), "repositories")
    bridges = graph.developer_bridges(assoc, links, topics, repos).select("developer_id", F.round("bridge", 6).alias("bridge"))
    people = view(s, d, "developers").select(F.col("id").alias("developer_id"), "followers")
    return quality.developer_cautions(labelled.join(people, "developer_id").join(bridges, "developer_id", "left"), 5_000)


# ---- one node's view

FOCUS = "T:size-1"


@query
def focused_projection(s: SparkSession, d: str) -> DataFrame:
    """What a view of one topic shows: nodes, and edges between them."""
    # scores are made once and read by each step
    nodes, edges = graph.focused(cut(base_ranked(s, d), "ranked"), cut(base.graph_edges(s, d), "edges"), FOCUS)
    return nodes.select(F.lit("node").alias("kind"), "node", F.col("near").cast("string").alias("other")).union(edges.select("edge_type", "source", "target"))


def base_ranked(s: SparkSession, d: str) -> DataFrame:
    """(node_type, node, label, weight, degree) of all nodes."""
    named = lambda rows, prefix, c: rows.select(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("node"), "weight", "degree")
    scores = named(base.centrality_developer(s, d), "D:", "developer_id").union(named(base.centrality_repository(s, d), "R:", "repository_id")).union(named(base.centrality_topic(s, d), "T:", "topic"))
    return base.graph_nodes(s, d).join(scores, "node").select("node_type", "node", "label", "weight", "degree")


_RANKED = f"""(SELECT n.node_type, n.node, n.label, c.weight, c.degree, CASE n.node_type WHEN 'DEVELOPER' THEN 1 WHEN 'REPOSITORY' THEN 2 ELSE 3 END AS kind, row_number() OVER (PARTITION BY n.node_type ORDER BY c.weight DESC, c.degree DESC, n.label, n.node) AS place
    FROM ({oracle.QUERIES['graph_nodes']}) n JOIN (SELECT 'D:' || developer_id AS node, degree, weight FROM ({oracle.QUERIES['centrality_developer']}) d
    UNION ALL SELECT 'R:' || repository_id, degree, weight FROM ({oracle.QUERIES['centrality_repository']}) r UNION ALL SELECT 'T:' || topic, degree, weight FROM ({oracle.QUERIES['centrality_topic']}) t) c ON c.node = n.node)"""
_BAND = "CASE WHEN s.stars < 10 THEN '0-9' WHEN s.stars < 100 THEN '10-99' WHEN s.stars < 1000 THEN '100-999' WHEN s.stars < 10000 THEN '1000-9999' ELSE '10000+' END"
_AGE = "CASE WHEN a < 0 THEN 'future_created_at' WHEN a < 30 THEN 'under-30d' WHEN a < 365 THEN '30-364d' WHEN a < 1095 THEN '365-1094d' ELSE '1095d+' END"

QUERIES_SQL = {
    "admitted_requests": "SELECT event_id, scope, refused_by IS NULL AS admitted, refused_by FROM (SELECT *, CASE WHEN before >= 450 THEN 'total' WHEN NOT fits THEN scope END AS refused_by FROM (SELECT *, coalesce(sum(fits::INT) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, coalesce(row_number() OVER (PARTITION BY scope ORDER BY ts, event_id) <= cap, true) AS fits FROM (SELECT e.event_id, e.ts, c.scope, c.cap FROM {events} e LEFT JOIN (VALUES ('purchase', 'search', 120), ('click', 'repository_details', 150), ('view', 'contributors', 90), ('signup', 'profiles', 160)) c(event_type, scope, cap) ON c.event_type = e.event_type) x) y) z) w",
    "discovery_run": f"SELECT seq, id, outcome FROM {_RUN} r WHERE place <= 600",
    "discovery_provenance": f"SELECT category, recipe, count(DISTINCT id) AS repositories FROM {_RUN} r WHERE place <= 600 GROUP BY GROUPING SETS ((category, recipe), (category))",
    "discovery_receipts": f"SELECT CAST(run AS INTEGER) AS run, count(*) + coalesce(max(over), 0) AS examined, count(*) FILTER (outcome <> 'duplicate') + coalesce(max(over), 0) AS unique, count(*) FILTER (outcome = 'saved') AS saved, count(*) FILTER (outcome = 'reused') AS reused, count(*) FILTER (outcome = 'duplicate') AS duplicates, CASE WHEN max(over) = 1 THEN 'max_new_repositories' WHEN count(*) < max(total) THEN 'max_candidates' END AS stopped FROM (SELECT l.run, r.*, (SELECT count(*) FROM {{events}}) AS total, (SELECT max(CASE WHEN q.new > l.news THEN 1 ELSE 0 END) FROM {_RUN} q WHERE q.place <= l.most) AS over FROM (VALUES (0, 600, 1000), (1, 1000000, 50), (2, 1000000, 1000), (3, 40, 1000)) l(run, most, news) JOIN {_RUN} r ON r.place <= l.most AND r.new <= l.news) x GROUP BY run",
    "followed_pages": "SELECT user_id AS chain, CAST(n // 10 + 1 AS INTEGER) AS page, CAST(n AS INTEGER) AS position, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM {events}) x WHERE n < CASE WHEN user_id % 5 = 0 THEN 17 ELSE 25 END",
    "table_fingerprint": "SELECT level, CAST(node AS INTEGER) AS node, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(keys) AS BIGINT) AS keys, CAST(sum(repeated_keys) AS BIGINT) AS repeated_keys, CAST(sum(sum) % 1000000000000000000 AS BIGINT) AS sum FROM (" + " UNION ALL ".join(f"SELECT {i} AS level, bucket // {16**i} AS node, rows, keys, repeated_keys, sum FROM {_LEAVES} l{i}" for i in range(4)) + ") x GROUP BY 1, 2",
    "changed_orders": "SELECT o_orderkey, 'removed' AS change FROM (SELECT min(o_orderkey) AS o_orderkey FROM {orders}) x UNION ALL SELECT max(o_orderkey), 'changed' FROM {orders} UNION ALL SELECT max(o_orderkey) + 1, 'added' FROM {orders}",
    "broken_references": "SELECT l_suppkey AS value, count(*) AS rows FROM {lineitem} WHERE l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_suppkey % 3 <> 0) GROUP BY 1",
    "cohort_counts": "SELECT event_type AS category, 'r' || event_id % 3 AS recipe, count(DISTINCT user_id) AS repositories FROM {events} WHERE (event_type <> 'error' OR event_id % 2 = 0) AND user_id % 5 <> 0 AND (event_type <> 'view' OR user_id % 2 = 0) GROUP BY GROUPING SETS ((category, recipe), (category))",
    "provenance_coverage": "WITH c AS (SELECT DISTINCT user_id, event_type FROM {events} WHERE (event_type <> 'error' OR event_id % 2 = 0) AND user_id % 5 <> 0 AND (event_type <> 'view' OR user_id % 2 = 0)), p AS (SELECT user_id, count(*) AS n FROM c GROUP BY 1) SELECT count(*) AS repositories, count(n) AS with_provenance, count(*) - count(n) AS without_provenance, count(*) FILTER (n > 1) AS multiple_categories, CAST(sum(n) AS BIGINT) AS memberships, round((SELECT max(k) FROM (SELECT count(*) AS k FROM c GROUP BY event_type) z) / count(*), 6) AS largest_share FROM {dense_repositories} r LEFT JOIN p ON p.user_id = r.id",
    "ranking_composition": f"WITH r AS (SELECT l.repository_id, round(l.momentum, 6) AS momentum, coalesce(primary_language, 'unknown') AS language, trend, {_BAND} AS stars, {_AGE} AS age, row_number() OVER (ORDER BY round(l.momentum, 6) DESC NULLS LAST, l.repository_id) <= 10 AS top FROM {{labelled}} l JOIN (SELECT repository_id, stars, ((SELECT epoch_us(max(captured_at)) FROM {{dense_snapshots}}) - epoch_us(first_at)) / 86400e6 AS a FROM {{scored}}) s ON s.repository_id = l.repository_id JOIN {{dense_repositories}} q ON q.id = l.repository_id WHERE l.momentum IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) FILTER (top) AS top, count(*) AS ranked FROM r GROUP BY 2" for c in ("stars", "age", "language", "trend")),
    "ranking_cautions": "SELECT count(*) FILTER (l.momentum IS NOT NULL) AS ranked, count(*) FILTER (l.momentum IS NOT NULL AND NOT coalesce(x.complete, false)) AS ranked_partial_7d, count(*) FILTER (c.score >= 0.75 AND l.n < 3) AS high_under_3, count(*) FILTER (l.momentum IS NOT NULL AND l.stars - x.delta < 30) AS ranked_small_base FROM {labelled} l JOIN {covered} c ON c.repository_id = l.repository_id LEFT JOIN {deltas} x ON x.repository_id = l.repository_id AND x.field = 'stars' AND x.window_days = 7",
    "developer_cautions": f"WITH r AS (SELECT e.developer_id, e.label, round(e.emerging, 6) AS score, d.followers, (SELECT count(*) FROM {{assoc}} a WHERE a.developer_id = e.developer_id) AS repositories, b.bridge FROM {{emerge}} e JOIN {{developers}} d ON d.id = e.developer_id LEFT JOIN ({oracle.QUERIES['developer_bridges']}) b ON b.developer_id = e.developer_id), t AS (SELECT * FROM r WHERE label <> 'INSUFFICIENT_HISTORY' ORDER BY score DESC, developer_id LIMIT 10) SELECT count(*) AS developers, count(*) FILTER (followers >= 5000) AS all_famous, count(*) FILTER (repositories = 1 AND label = 'EMERGING') AS single_emerging, max(bridge) FILTER (repositories = 1) AS single_bridge_max, (SELECT count(*) FROM t) AS top, (SELECT count(*) FILTER (followers >= 5000) FROM t) AS top_famous, (SELECT count(*) FILTER (repositories = 1) FROM t) AS top_single FROM r",
    "focused_projection": f"WITH ranked AS MATERIALIZED (SELECT * FROM {_RANKED} r), own AS (SELECT CASE WHEN source = '{FOCUS}' THEN target ELSE source END AS node, min((edge_type, source, target)) AS spot FROM {{graph_edges}} g WHERE (source = '{FOCUS}' OR target = '{FOCUS}') AND source <> target GROUP BY 1), wanted AS (SELECT node FROM (SELECT node FROM own ORDER BY spot LIMIT 30) o UNION SELECT '{FOCUS}'), chosen AS (SELECT * FROM ranked WHERE node IN (SELECT node FROM wanted)), filled AS (SELECT * FROM ranked WHERE place <= 18 AND node NOT IN (SELECT node FROM chosen) ORDER BY kind, place LIMIT (SELECT 54 - count(*) FROM chosen)), shown AS MATERIALIZED (SELECT node, true AS near FROM chosen UNION ALL SELECT node, false FROM filled) SELECT 'node' AS kind, node, CAST(near AS VARCHAR) AS other FROM shown UNION ALL SELECT edge_type, source, target FROM {{graph_edges}} g WHERE source IN (SELECT node FROM shown) AND target IN (SELECT node FROM shown)",
}
ORACLE_SQL = {k: oracle.sql(v) for k, v in QUERIES_SQL.items()}
