"""Queries of lookups, lists, reports, runs, evidence and the write path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from observatory.operators import developers as dev
from observatory.operators import evidence, graph, ingest, lists, quality, runs
from observatory.functions import expr, text
from observatory.plans import queries as base
from observatory.plans.queries import query, r6
from observatory.sources.domain import view

# ---- lookups and repository lists


@query
def lookup_references(s: SparkSession, d: str) -> DataFrame:
    """Ids and full names as users type them; names in another case find nothing."""
    refs = s.createDataFrame([(x,) for x in ("7", " /org1/repo1/ ", "ORG1/repo1", "12345678901", "nobody/x", "org2/repo2")], "ref string")
    return lists.resolve(refs, view(s, d, "dense_repositories"))


@query
def repository_history(s: SparkSession, d: str) -> DataFrame:
    """A repository's observations, oldest first."""
    rows = base.dense(s, d).where("repository_id = 5")
    return rows.orderBy("captured_at", "id").select("id", F.unix_micros("captured_at").alias("captured_at"), "stars", "forks", "watchers")


@query
def rows_by_ids(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "dense_repositories").where(F.col("id").isin(1, 5, 9, 100_000_000)).select("id", "full_name", "primary_language")


def listed(s: SparkSession, d: str) -> DataFrame:
    scored = base.dense_scored(s, d).select(F.col("repository_id").alias("id"), F.col("latest.stars").alias("stars"), F.col("latest.forks").alias("forks"), "momentum", F.col("stars7.delta").alias("stars_7d"), "trend")
    return view(s, d, "dense_repositories").join(scored, "id", "left")


def _page(rows: DataFrame, order: list[Column], *columns: Column | str, limit: int | None = None, offset: int = 0) -> DataFrame:
    return lists.page(rows, order, limit, offset).select("place", *columns, "total", "has_more")


@query
def repo_list_last_seen(s: SparkSession, d: str) -> DataFrame:
    return _page(listed(s, d), lists.repository_order("last_seen"), "id", "full_name")


@query
def repo_list_momentum(s: SparkSession, d: str) -> DataFrame:
    rows = lists.filter_repositories(listed(s, d), archived=False, fork=False)
    return _page(rows, lists.repository_order("momentum"), "id", *r6("momentum"), limit=100, offset=10)


@query
def repo_list_stars_7d_ascending(s: SparkSession, d: str) -> DataFrame:
    rows = lists.filter_repositories(listed(s, d), min_stars=20, max_stars=100_000)
    return _page(rows, lists.repository_order("stars_7d", False), "id", "stars_7d", limit=50)


@query
def repo_list_trend(s: SparkSession, d: str) -> DataFrame:
    rows = lists.filter_repositories(listed(s, d), language="RUST")
    return _page(rows, lists.repository_order("trend"), "id", "trend", limit=40)


@query
def repo_list_of_trend(s: SparkSession, d: str) -> DataFrame:
    rows = lists.filter_repositories(listed(s, d), trend="rising")
    return _page(rows, lists.repository_order("name", False), "full_name", "stars")


@query
def quality_ranking(s: SparkSession, d: str) -> DataFrame:
    """Most momentum first, then by id."""
    rows = base.dense_scored(s, d).where("momentum is not null")
    return rows.orderBy(F.desc(F.round("momentum", 6)), "repository_id").limit(10).select("repository_id", *r6("momentum"))


@query
def due_count(s: SparkSession, d: str) -> DataFrame:
    """Repositories without an observation in the last 12 hours."""
    seen = base.dense(s, d).groupBy(F.col("repository_id").alias("id")).agg(F.max("captured_at").alias("seen"))
    now = base.dense(s, d).agg(F.max("captured_at").alias("now"))
    rows = view(s, d, "repositories").select("id").join(seen, "id", "left").crossJoin(F.broadcast(now))
    return rows.agg(F.count_if(F.col("seen").isNull() | (F.unix_micros("now") - F.unix_micros("seen") >= 12 * 3_600_000_000)).alias("due"))


@query
def freshness(s: SparkSession, d: str) -> DataFrame:
    """Whole days from the newest observation to an instant that the caller names."""
    newest = base.dense(s, d).agg(F.max("captured_at").alias("newest"))
    return newest.select(F.unix_micros("newest").alias("newest"), expr.whole_days_since(F.col("newest"), F.lit("2024-06-01 12:00:00").cast("timestamp")).alias("stale_days"))


# ---- developers


def people(s: SparkSession, d: str, topic: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(one row per developer with links: scores, login, followers, relevance to the topic or the best one; assoc; repositories; relevance)."""
    act, repos = base.activity(s, d), base.repositories(s, d)
    topics = view(s, d, "repository_topics")
    relevance = dev.topic_relevance(act, repos, topics)
    one = relevance.where(F.col("topic") == topic).select("developer_id", "relevance") if topic else relevance.groupBy("developer_id").agg(F.max("relevance").alias("relevance"))
    rows = base._labelled(s, d, act, repos).withColumnRenamed("score", "activity").join(view(s, d, "developers").select(F.col("id").alias("developer_id"), "login", "followers"), "developer_id").join(one, "developer_id", "left")
    languages = view(s, d, "repositories").select("id", "full_name", "primary_language")
    return rows, dev.associated(act, repos), languages, relevance


@query
def developers_by_relevance(s: SparkSession, d: str) -> DataFrame:
    rows, *more = people(s, d, "size-1")
    return _page(lists.filter_developers(rows, *more, topic="size-1", min_followers=1000), lists.developer_order("relevance"), "login", "followers", *r6("relevance"))


@query
def developers_by_activity(s: SparkSession, d: str) -> DataFrame:
    rows, *more = people(s, d)
    return _page(lists.filter_developers(rows, *more, language="economy", min_confidence=0.5), lists.developer_order("activity"), "login", *r6("activity"), limit=50)


@query
def developers_by_followers(s: SparkSession, d: str) -> DataFrame:
    rows, *more = people(s, d)
    return _page(lists.filter_developers(rows, *more, repository="Brand#1/"), lists.developer_order("followers"), "login", "followers", limit=10, offset=5)


@query
def best_topic(s: SparkSession, d: str) -> DataFrame:
    act, repos = base.activity(s, d), base.repositories(s, d)
    rows = lists.best_topics(dev.topic_relevance(act, repos, view(s, d, "repository_topics")), 3)
    return rows.select("developer_id", "place", "topic", *r6("relevance"))


@query
def developer_levels(s: SparkSession, d: str) -> DataFrame:
    """The strongest of a developer's coverage levels, counted."""
    scores = dev.activity_scores(base.activity(s, d))
    found = lists.developer_level(F.col("available"), F.col("confidence"), F.coalesce("confidence", F.lit(0.0)))
    return scores.groupBy(found.alias("level")).agg(F.count("*").alias("developers"))


@query
def workspace_saved(s: SparkSession, d: str) -> DataFrame:
    rows, *more = people(s, d, "size-1")
    rows = lists.filter_workspace(rows, view(s, d, "workspace"), "saved", "interested", 0.3)
    return _page(rows, [F.desc(F.round("relevance", 6)), F.asc("developer_id")], "developer_id", *r6("relevance"))


@query
def workspace_unsaved(s: SparkSession, d: str) -> DataFrame:
    """Whoever has no state, or one that isn't saved."""
    rows = view(s, d, "developers").select(F.col("id").alias("developer_id"), "login")
    return lists.filter_workspace(rows, view(s, d, "workspace"), "unsaved").select("developer_id", "login", "status")


@query
def search_all(s: SparkSession, d: str) -> DataFrame:
    names = lambda v, i, n: view(s, d, v).select(F.col(i).alias("id"), F.col(n).alias("name")).distinct()
    kinds = {"repository": names("repositories", "id", "full_name"), "topic": names("repository_topics", "topic", "topic"), "developer": names("developers", "id", "login")}
    return lists.search(kinds, " BRAND#1 ", 10)


# ---- graph


@query
def nodes_in_order(s: SparkSession, d: str) -> DataFrame:
    """By type, then id."""
    return _page(base.graph_nodes(s, d), [F.asc("node_type"), F.asc("node")], "node_type", "node", limit=100, offset=50)


@query
def topics_by_centrality(s: SparkSession, d: str) -> DataFrame:
    rows = base.centrality_topic(s, d)
    return _page(rows, [F.desc("weight"), F.desc("degree"), F.lower("topic").asc()], "topic", "degree", "weight")


@query
def edges_of_type(s: SparkSession, d: str) -> DataFrame:
    return base.graph_edges(s, d).where("edge_type = 'OWNS'").select("source", "target")


@query
def node_lookup(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([(x,) for x in ("SUPPLIER#000000003", "size-1", "brand#1/economy", "nobody")], "name string")
    return lists.node_named(base.graph_nodes(s, d), names)


@query
def bridges_page(s: SparkSession, d: str) -> DataFrame:
    """Bridging developers of a topic with a confidence of 0.3 or more; the total is the true one."""
    links, repos, assoc, topics = base._graph(s, d)
    rows = graph.developer_bridges(assoc, links, topics, repos).where("confidence.score >= 0.3")
    rows = rows.join(assoc.join(topics.where("topic = 'size-2'").select("repository_id"), "repository_id", "left_semi").select("developer_id"), "developer_id", "left_semi")
    return _page(rows, [F.desc(F.round("bridge", 6)), F.asc("developer_id")], "developer_id", *r6("bridge"), limit=20)


@query
def shared_evidence(s: SparkSession, d: str) -> DataFrame:
    """Repositories that two developers both contribute to."""
    links = dev.shares(view(s, d, "links"))
    side = lambda who, n: links.where(F.col("developer_id") == who).select("repository_id", F.col("contributions").alias(f"{n}_contributions"), F.round("share", 6).alias(f"{n}_share"))
    names = view(s, d, "repositories").select(F.col("id").alias("repository_id"), "full_name")
    return side(1, "a").join(side(2, "b"), "repository_id").join(names, "repository_id")


@query
def ecosystem_report(s: SparkSession, d: str) -> DataFrame:
    """One row: nodes and edges by type, components and the largest one."""
    nodes, edges = base.graph_nodes(s, d), base.graph_edges(s, d)
    parts = graph.components(nodes, edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    by_node = nodes.agg(*(F.count_if(F.col("node_type") == t).alias(t.lower()) for t in ("DEVELOPER", "REPOSITORY", "TOPIC")))
    by_edge = edges.agg(*(F.count_if(F.col("edge_type") == t).alias(t.lower()) for t in ("OWNS", "CONTRIBUTES_TO", "TAGGED_WITH")))
    return by_node.crossJoin(by_edge).crossJoin(parts)


@query
def developer_report(s: SparkSession, d: str) -> DataFrame:
    """One developer's reach, centrality and bridge; a developer without links has zeros."""
    links, repos, assoc, topics = base._graph(s, d)
    who = view(s, d, "developers").where("id = 3")
    reach = graph.developer_reach(who, assoc.join(assoc.where("developer_id = 3").select("repository_id"), "repository_id", "left_semi"), topics)
    # centrality of one node asks for its own pairs only
    near = assoc.join(assoc.where("developer_id = 3").select("repository_id"), "repository_id", "left_semi").where("developer_id <> 3")
    central = near.groupBy("developer_id").agg(F.count("*").alias("w")).agg(F.count("*").alias("degree"), F.coalesce(F.sum("w"), F.lit(0)).alias("weight"))
    own = lambda x: x.where("developer_id = 3")
    bridge = graph.developer_bridges(own(assoc), own(links), topics, repos).select("developer_id", "memberships", *r6("bridge"))
    return reach.crossJoin(F.broadcast(central)).join(bridge, "developer_id", "left").join(who.select(F.col("id").alias("developer_id"), "login"), "developer_id").select("developer_id", "login", "contributed", "owned", "reached_repositories", "reached_developers", "reached_topics", "degree", "weight", "memberships", "bridge")


@query
def topic_report(s: SparkSession, d: str) -> DataFrame:
    """One topic's reach and its related topics."""
    _, _, assoc, topics = base._graph(s, d)
    reach = graph.topic_reach(topics.where("topic = 'size-1'"), assoc)
    rel = graph.topics_related_to(assoc, topics, "size-1").select(F.col("topic").alias("other"), F.col("developers").alias("shared_developers"), F.col("repositories").alias("shared_repositories"))
    top = rel.orderBy(F.desc("shared_developers"), F.desc("shared_repositories"), "other").limit(10)
    return reach.select("topic", "repositories", "contributing", "owning", "associated").crossJoin(top)


@query
def repository_report(s: SparkSession, d: str) -> DataFrame:
    """One repository's reach and the repositories most like it."""
    links, repos, assoc, topics = base._graph(s, d)
    own = lambda x: x.where("repository_id = 5")
    near = assoc.join(own(assoc).select("developer_id"), "developer_id", "left_semi")
    reach = graph.repository_reach(repos.where("id = 5"), own(links), near, own(topics))
    # only pairs with this repository
    shared = near.where("repository_id <> 5").groupBy("repository_id").agg(F.count_distinct("developer_id").alias("shared_developers"))
    top = shared.orderBy(F.desc("shared_developers"), "repository_id").limit(10).select(F.col("repository_id").alias("other"), "shared_developers")
    return reach.select("repository_id", "owner", "contributors", "topics", "siblings").crossJoin(top)


@query
def subgraph_of_momentum(s: SparkSession, d: str) -> DataFrame:
    """Edges whose repositories are in one of two topics and have a momentum of 0.5 or more."""
    _, repos, _, topics = base._graph(s, d)
    return graph.subgraph(base.graph_edges(s, d), repositories=graph.kept_repositories(repos, topics, ["size-1", "size-2"], min_momentum=0.5))


@query
def owner_changes(s: SparkSession, d: str) -> DataFrame:
    """Each event writes its repository anew, an error without an owner."""
    writes = view(s, d, "events").select(F.col("user_id").alias("repository_id"), F.when(F.col("event_type") != "error", F.col("event_id") % 7).alias("owner_id"), "event_id")
    return graph.owner_edges(writes, "event_id")


@query
def developer_memberships(s: SparkSession, d: str) -> DataFrame:
    _, _, assoc, topics = base._graph(s, d)
    return graph.memberships(assoc, topics).select("developer_id", F.array_join("topics", ",").alias("topics"))


@query
def graph_projection(s: SparkSession, d: str) -> DataFrame:
    """The 18 most central nodes of each type."""
    nodes = base.graph_nodes(s, d)
    named = lambda rows, prefix, c: rows.select(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("node"), "weight", "degree")
    ranked = named(base.centrality_developer(s, d), "D:", "developer_id").union(named(base.centrality_repository(s, d), "R:", "repository_id")).union(named(base.centrality_topic(s, d), "T:", "topic"))
    return graph.projection(nodes.join(ranked, "node")).select("node_type", "node", "place", "weight")


# ---- artifacts and runs


@query
def artifact_counts(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "artifacts").groupBy("artifact_type").agg(F.count("*").alias("artifacts"))


@query
def artifacts_newest(s: SparkSession, d: str) -> DataFrame:
    return lists.filter_artifacts(view(s, d, "artifacts"), "developer", artifact_type="2-HIGH", window=7).select("id", "entity_key", "window_days", F.unix_micros("generated_at").alias("generated_at"))


@query
def artifact_by_key(s: SparkSession, d: str) -> DataFrame:
    """The newest artifact of each of some keys; of any window where there is none of the one asked for."""
    rows = view(s, d, "artifacts")
    return lists.filter_artifacts(rows, "repository", "3", None, 30, 5).select("id", "artifact_type", "window_days")


@query
def run_receipts(s: SparkSession, d: str) -> DataFrame:
    rows = quality.receipts(view(s, d, "collection_runs")).orderBy(F.desc("started_at"), F.desc("run_id")).limit(100)
    return rows.select("run_id", "kind", "status", "partial", F.col("report.candidates_examined").alias("examined"), F.col("requests").getItem("search").alias("search_requests"))


@query
def run_stats(s: SparkSession, d: str) -> DataFrame:
    out = quality.collection_stats(view(s, d, "collection_runs"))
    return out.select("runs", "requests", "examined", "new", "reused", "partial", "exhausted", *r6("partial_share", "duplicate_rate", "requests_per_new"))


@query
def run_requests(s: SparkSession, d: str) -> DataFrame:
    return quality.requests_by_scope(view(s, d, "collection_runs"))


@query
def run_scaling(s: SparkSession, d: str) -> DataFrame:
    return quality.scaling(quality.collection_stats(view(s, d, "collection_runs")))


@query
def operator_report(s: SparkSession, d: str) -> DataFrame:
    return runs.operator_report(view(s, d, "collection_runs"))


@query
def problem_runs(s: SparkSession, d: str) -> DataFrame:
    return runs.problem_runs(view(s, d, "collection_runs")).select("run_id", "kind", "status")


@query
def scheduled_runs(s: SparkSession, d: str) -> DataFrame:
    """What a scheduler would do at an instant, were the running runs acknowledged."""
    kinds = s.createDataFrame([("refresh", "2001-07-31 10:00:00"), ("discover", "2001-08-09 10:00:00"), ("other", "2001-07-31 10:00:00")], "kind string, now string").select("kind", F.col("now").cast("timestamp").alias("now"))
    return runs.scheduled(view(s, d, "collection_runs").where("status <> 'running'"), kinds)


@query
def discovery_plan(s: SparkSession, d: str) -> DataFrame:
    categories = view(s, d, "region").select(F.lower("r_name").alias("category"), F.concat(F.lit("topic:"), F.lower("r_name")).alias("query"))
    return runs.discovery_plan(categories, _recipes(s), F.lit("2024-03-01").cast("date"), 150, 100)


def _recipes(s: SparkSession) -> DataFrame:
    rows = [("rising", 10, 500, 365, 30, "updated"), ("big", 1000, None, None, None, "stars"), ("new", None, None, 60, None, "stars")]
    return s.createDataFrame(rows, "recipe string, min_stars int, max_stars int, created_within_days int, pushed_within_days int, sort string")


@query
def discovery_demand(s: SparkSession, d: str) -> DataFrame:
    return runs.discovery_demand(discovery_plan(s, d), 30, {"search": 100, "repository_details": 1000, "contributors": 5000, "profiles": 10_000, "total": 20_000})


# ---- write path, with the view events as what is stored and the others as what comes in


def _events(s: SparkSession, d: str, stored: bool) -> DataFrame:
    return view(s, d, "events").where(F.col("event_type") == "view" if stored else F.col("event_type") != "view")


@query
def upsert_profiles(s: SparkSession, d: str) -> DataFrame:
    """The last write of a key stands; an unknown value keeps the stored one."""
    rows = lambda x: x.select(F.col("user_id").alias("developer_id"), F.when(F.col("value") >= 3, F.col("value")).alias("score"), F.col("event_type").alias("source"), "event_id")
    stored = rows(_events(s, d, True)).groupBy("developer_id").agg(F.max_by("score", "event_id").alias("score"), F.max_by("source", "event_id").alias("source"))
    return ingest.upsert(stored, rows(_events(s, d, False)), ["developer_id"], "event_id", ("score",))


@query
def replace_topics(s: SparkSession, d: str) -> DataFrame:
    rows = lambda x, t: x.select(F.col("user_id").alias("repository_id"), t.alias("topic")).distinct()
    stored = rows(view(s, d, "events"), F.concat(F.lit("old-"), F.col("user_id") % 5))
    incoming = rows(_events(s, d, False).where("value > 5"), F.concat(F.lit("  NEW-"), F.col("event_type"), F.lit(" ")))
    return ingest.replace_topics(stored, incoming)


@query
def note_provenance(s: SparkSession, d: str) -> DataFrame:
    empty = s.createDataFrame([], "repository_id long, category string, recipe string, query_hash string, query string, first_seen_at timestamp, last_seen_at timestamp, last_run_id long")
    rows = view(s, d, "events").select(F.col("user_id").alias("repository_id"), F.col("event_type").alias("category"), F.lit("r").alias("recipe"), F.concat(F.lit("topic:"), F.col("event_type")).alias("query"), F.col("ts").cast("timestamp").alias("seen_at"), F.col("event_id").alias("run_id"))
    out = ingest.note_provenance(empty, rows)
    return out.select("repository_id", "category", "query_hash", F.unix_micros("first_seen_at").alias("first_seen_at"), F.unix_micros("last_seen_at").alias("last_seen_at"), "last_run_id")


@query
def due_profiles(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("ts").cast("timestamp"))).alias("fetched_at"), F.count("*").alias("fetched_limit"))
    return ingest.due(rows, "fetched_at", F.lit("2024-02-05").cast("timestamp"), 7, "fetched_limit", 60).select("user_id", F.unix_micros("fetched_at").alias("fetched_at"), "fetched_limit")


@query
def candidates_once(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "events").select("user_id", "event_id", "event_type")
    return ingest.first_of(rows.withColumn("seq", F.col("event_id")), "user_id", "seq").select("user_id", "event_id", "event_type", "duplicates")


@query
def stage_candidates(s: SparkSession, d: str) -> DataFrame:
    known = _events(s, d, True).select("user_id").distinct()
    rows = _events(s, d, False).select((F.col("user_id") * 2).alias("user_id"), "event_id", "event_type")
    return runs.stage(known, rows, "user_id", "event_id", ["event_type"])


@query
def refused_observations(s: SparkSession, d: str) -> DataFrame:
    """Per repository, incoming observations older than its newest stored one."""
    at = lambda x: x.select("user_id", F.col("ts").cast("timestamp").alias("at"))
    rows = runs.refuse_older(at(_events(s, d, True)), at(_events(s, d, False)), "user_id", "at")
    return rows.groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


# ---- evidence


@query
def repository_evidence(s: SparkSession, d: str) -> DataFrame:
    return evidence.repository_evidence(base.dense_scored(s, d))


@query
def prompts(s: SparkSession, d: str) -> DataFrame:
    """One prompt per user of their events, 120 characters of payload at most."""
    rows = view(s, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("source"), F.col("props").alias("payload"))
    out = evidence.prompt(quality.bundle(rows, "entity", ["kind", "source", "payload"]), "entity", 120)
    return out.select("entity", "items", "chars", "omitted", F.sha2("text", 256).alias("text_sha256"))


@query
def safe_texts(s: SparkSession, d: str) -> DataFrame:
    """Topic names, secrets and wrapping."""
    rows = view(s, d, "events").select("event_id", "event_type", "props")
    return rows.select("event_id", text.normalize_topic(F.concat(F.lit(" \t"), F.upper("event_type"), F.lit("\n"))).alias("topic"), text.wrap_untrusted("props", text.redact(F.concat(F.lit("key=hunter2-hunter2 "), F.col("props")), ["hunter2-hunter2", "k"])).alias("wrapped"), F.array_join(text.secrets_present(F.col("event_type"), ["purchase", "k"]), ",").alias("secrets"))
