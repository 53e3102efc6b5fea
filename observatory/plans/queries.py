"""The library's queries over the views of ``sources.domain``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from observatory.functions import expr, text
from observatory.operators import developers as dev
from observatory.operators import graph, quality, scoring, temporal
from observatory.shared import cut
from observatory.sources.domain import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n.split(".")[-1]) for n in names]


FIELDS = ["stars", "forks", "watchers", "open_issues"]


def dense(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "dense_snapshots")


def dense_scored(s: SparkSession, d: str) -> DataFrame:
    series = temporal.series_windows(dense(s, d), "repository_id", "captured_at", [*FIELDS, "pushed_at"])
    out = scoring.with_momentum(series)
    return out.withColumn("trend", scoring.trend()).withColumn("confidence", scoring.window_confidence(7))


def end_of(df: DataFrame, at: str) -> Column:
    """The newest instant as a scalar subquery: it runs with the query, and once wherever it stands."""
    return df.agg(F.max(at)).scalar()


# ---- time


@query
def trending(s: SparkSession, d: str) -> DataFrame:
    """Top 20 by momentum; without momentum a repository isn't ranked."""
    names = view(s, d, "dense_repositories").select(F.col("id").alias("repository_id"), "full_name", "last_seen_at")
    rows = dense_scored(s, d).where("momentum is not null").join(names, "repository_id")
    top = rows.orderBy(F.desc(F.round("momentum", 6)), F.desc("last_seen_at"), "full_name").limit(20)
    return top.select("repository_id", "full_name", *r6("momentum"), "trend", *r6("stars7.growth_pct"))


@query
def window_deltas(s: SparkSession, d: str) -> DataFrame:
    out = temporal.window_deltas(dense(s, d), "repository_id", "captured_at", FIELDS)
    return out.select("repository_id", "field", "window_days", "base", "current", "delta", *r6("span_days", "per_day", "growth_pct"), "complete")


def _targets(s: SparkSession, d: str) -> DataFrame:
    return dense(s, d).groupBy("repository_id").agg((F.min("captured_at") + F.expr("INTERVAL 10 DAYS")).alias("target"))


def _found(df: DataFrame) -> DataFrame:
    return df.select("repository_id", F.col("found.id").alias("found_id"), F.col("found.stars").alias("stars"))


@query
def as_of_before(s: SparkSession, d: str) -> DataFrame:
    return _found(temporal.at_or_before(dense(s, d), _targets(s, d), "repository_id", "captured_at", "target"))


@query
def as_of_after(s: SparkSession, d: str) -> DataFrame:
    return _found(temporal.at_or_after(dense(s, d), _targets(s, d), "repository_id", "captured_at", "target"))


@query
def as_of_nearest(s: SparkSession, d: str) -> DataFrame:
    return _found(temporal.nearest_to(dense(s, d), _targets(s, d), "repository_id", "captured_at", "target"))


@query
def previous_of(s: SparkSession, d: str) -> DataFrame:
    newest = dense(s, d).groupBy("repository_id").agg(F.max("captured_at").alias("target"))
    return _found(temporal.previous_of(dense(s, d), newest, "repository_id", "captured_at", "target"))


@query
def snapshot_dedup(s: SparkSession, d: str) -> DataFrame:
    """The last write of each hour stands."""
    rows = view(s, d, "events").select("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "event_id", "event_type", "value")
    out = temporal.dedup_last(rows, ["user_id", "hour"], "event_id")
    return out.select("user_id", F.unix_seconds("hour").alias("hour"), "event_id", "event_type", "value")


@query
def snapshot_if_changed(s: SparkSession, d: str) -> DataFrame:
    return temporal.changed_only(dense(s, d), "repository_id", "captured_at", ["forks", "open_issues", "pushed_at"]).select("id", "repository_id", "forks", "open_issues")


@query
def recency(s: SparkSession, d: str) -> DataFrame:
    now = end_of(dense(s, d), "captured_at")
    out = dense_scored(s, d).withColumn("r", scoring.recency_metrics(F.col("first_at"), F.col("newest_at"), F.lit(None).cast("timestamp"), F.col("latest.pushed_at"), now))
    return out.select("repository_id", *r6("r.age_days", "r.days_since_push", "r.days_since_update", "r.recency"))


@query
def trend_class(s: SparkSession, d: str) -> DataFrame:
    return dense_scored(s, d).select("repository_id", "trend", *r6("momentum"))


@query
def trend_histogram(s: SparkSession, d: str) -> DataFrame:
    return dense_scored(s, d).groupBy("trend").agg(F.count("*").alias("repositories"))


@query
def window_confidence(s: SparkSession, d: str) -> DataFrame:
    return dense_scored(s, d).select("repository_id", *r6("confidence.score", "confidence.count_term", "confidence.span_term", "confidence.gap_term"), "confidence.level")


@query
def window_statuses(s: SparkSession, d: str) -> DataFrame:
    rows = dense_scored(s, d)
    return rows.groupBy(*(scoring.window_status("watchers", w).alias(f"w{w}") for w in (1, 7, 30))).agg(F.count("*").alias("repositories"))


@query
def observation_gaps(s: SparkSession, d: str) -> DataFrame:
    rows = dense(s, d)
    return temporal.missing_days(rows, "repository_id", "captured_at", end_of(rows, "captured_at"), 20).groupBy("repository_id").agg(F.count("*").alias("missing"), F.min(F.date_format("day", "yyyy-MM-dd")).alias("first_missing"))


# ---- topics and lists


def _topics(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "dense_topics")


@query
def topic_aggregates(s: SparkSession, d: str) -> DataFrame:
    out = scoring.topic_aggregates(dense_scored(s, d), _topics(s, d))
    return out.select("topic", "repositories", *r6("total_momentum", "mean_momentum", "share_with_momentum", "share_complete", "confidence"), "confidence_level")


@query
def topic_counts(s: SparkSession, d: str) -> DataFrame:
    """Topics without repositories are kept, with 0."""
    names = _topics(s, d).select("topic").union(s.createDataFrame([("unused",)], "topic string")).distinct()
    return names.join(_topics(s, d), "topic", "left").groupBy("topic").agg(F.count("repository_id").alias("repositories"))


@query
def topic_members(s: SparkSession, d: str) -> DataFrame:
    """Ranked members first, then the others by name; place from 1."""
    rows = _topics(s, d).where("topic = 'topic-1'").join(dense_scored(s, d), "repository_id").join(view(s, d, "dense_repositories").select(F.col("id").alias("repository_id"), "full_name"), "repository_id")
    order = [F.col("momentum").isNull(), F.desc(F.round("momentum", 6)), "full_name"]
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(*order))).select("topic", "full_name", "place", *r6("momentum"))


@query
def repo_list_filtered(s: SparkSession, d: str) -> DataFrame:
    """Language (any case), stars, not archived; page 2 of 10 by stars, descending."""
    rows = view(s, d, "dense_repositories").where((F.lower(F.coalesce("primary_language", F.lit(""))) == "go") & ~F.col("is_archived"))
    rows = rows.join(dense_scored(s, d).select(F.col("repository_id").alias("id"), F.col("latest.stars").alias("stars")), "id", "left").where("stars >= 20")
    return rows.orderBy(F.desc_nulls_last("stars"), F.desc("full_name")).offset(10).limit(10).select("id", "full_name", "stars")


@query
def repo_summary(s: SparkSession, d: str) -> DataFrame:
    out = scoring.summary(dense_scored(s, d))
    return out.select("repositories", *r6("stars_per_day", "forks_per_day"), "rising", "steady", "declining", "new", "inactive", "high_confidence", *r6("mean_momentum"))


@query
def dataset_stats(s: SparkSession, d: str) -> DataFrame:
    snaps = dense(s, d).agg(F.count("*").alias("snapshots"), F.unix_micros(F.min("captured_at")).alias("first_at"), F.unix_micros(F.max("captured_at")).alias("last_at"))
    counts = [view(s, d, v).select(F.count_distinct(c).alias(n)) for v, c, n in (("dense_repositories", "id", "repositories"), ("developers", "id", "developers"), ("dense_topics", "topic", "topics"))]
    for c in counts:  # single rows
        snaps = snaps.crossJoin(c)
    return snaps


@query
def newest_observation(s: SparkSession, d: str) -> DataFrame:
    """Over three facts; nulls don't count."""
    facts = [view(s, d, v).agg(F.max("captured_at").alias(v)) for v in ("dense_snapshots", "contributor_snapshots", "developer_snapshots")]
    return facts[0].crossJoin(facts[1]).crossJoin(facts[2]).select(F.unix_micros(F.greatest("dense_snapshots", "contributor_snapshots", "developer_snapshots")).alias("newest"))


@query
def latest_snapshot_by_id(s: SparkSession, d: str) -> DataFrame:
    return dense(s, d).groupBy("repository_id").agg(F.max_by(F.struct("id", "stars", "watchers"), "id").alias("x")).select("repository_id", "x.*")


@query
def latest_snapshot_by_time(s: SparkSession, d: str) -> DataFrame:
    return dense(s, d).groupBy("repository_id").agg(F.max_by(F.struct("stars", "watchers"), "captured_at").alias("x")).select("repository_id", "x.*")


@query
def repos_with_latest(s: SparkSession, d: str) -> DataFrame:
    repos = view(s, d, "repositories").select("id", "full_name")
    latest = dense(s, d).groupBy(F.col("repository_id").alias("id")).agg(F.max_by("stars", "id").alias("stars"))
    return repos.join(latest, "id", "left")


@query
def stale_queue(s: SparkSession, d: str) -> DataFrame:
    """Never observed first, then the longest unobserved."""
    cutoff = end_of(dense(s, d), "captured_at") - F.expr("INTERVAL 12 HOURS")
    seen = dense(s, d).groupBy(F.col("repository_id").alias("id")).agg(F.max("captured_at").alias("seen"))
    rows = view(s, d, "repositories").select("id").join(seen, "id", "left").where(F.col("seen").isNull() | (F.col("seen") <= cutoff))
    return rows.orderBy(F.asc_nulls_first("seen"), "id").limit(25).select("id", F.unix_micros("seen").alias("seen"))


@query
def search_names(s: SparkSession, d: str) -> DataFrame:
    q = F.lit("supplier#00000000")
    return view(s, d, "developers").where(F.contains(F.lower("login"), F.lower(F.trim(q)))).select("id", "login").orderBy("login").limit(20)


@query
def contributors_topn(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "links").where("repository_id = 7").join(view(s, d, "developers").select(F.col("id").alias("developer_id"), "login"), "developer_id")
    return rows.orderBy(F.desc("contributions"), "login").limit(10).select("login", "contributions")


@query
def repositories_for_developer(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "links").where("developer_id = 3").join(view(s, d, "repositories").select(F.col("id").alias("repository_id"), "full_name"), "repository_id")
    return rows.select("repository_id", "full_name", "contributions")


@query
def star_age_bands(s: SparkSession, d: str) -> DataFrame:
    now = end_of(dense(s, d), "captured_at")
    rows = dense_scored(s, d).select(expr.star_band(F.col("latest.stars")).alias("stars"), expr.age_band(expr.days(now, F.col("first_at"))).alias("age"))
    return rows.groupBy("stars", "age").agg(F.count("*").alias("repositories"))


@query
def set_ops_union(s: SparkSession, d: str) -> DataFrame:
    a, b = view(s, d, "links").select("developer_id"), view(s, d, "repositories").select("owner_id")
    return a.union(b).where("developer_id is not null").distinct()


@query
def set_ops_intersect(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "links").select("developer_id").intersect(view(s, d, "repositories").select("owner_id"))


@query
def set_ops_except(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "developers").select(F.col("id").alias("developer_id")).exceptAll(view(s, d, "links").select("developer_id").distinct())


# ---- developers


def _ref(s: SparkSession, d: str) -> Column:
    """The newest contribution: a two-column scan, not the joined lines."""
    parts = view(s, d, "part").select(F.col("p_partkey").alias("l_partkey"))
    rows = view(s, d, "lineitem").select("l_partkey", F.col("l_shipdate").cast("timestamp").alias("at")).join(parts, "l_partkey", "left_semi")
    return end_of(rows, "at")


def activity(s: SparkSession, d: str, window: int = 30) -> DataFrame:
    deltas = temporal.anchored_deltas(view(s, d, "contributor_snapshots"), ["repository_id", "developer_id"], "captured_at", "contributions", _ref(s, d), (window,))
    return cut(dev.link_activity(view(s, d, "links"), deltas), "activity")


def repositories(s: SparkSession, d: str) -> DataFrame:
    """With momentum and trend at the newest observation of all; like ``activity`` written once, as several branches of a query read it."""
    ref = _ref(s, d)
    series = scoring.with_momentum(temporal.series_windows(view(s, d, "repository_snapshots"), "repository_id", "captured_at", ["stars", "forks", "pushed_at"]), ref)
    scored = series.withColumn("trend", scoring.trend(ref)).select(F.col("repository_id").alias("id"), "momentum", "trend")
    return cut(view(s, d, "repositories").select("id", "owner_id", "full_name").join(scored, "id", "left"), "repositories")


@query
def contribution_share(s: SparkSession, d: str) -> DataFrame:
    return dev.shares(view(s, d, "links")).select("repository_id", "developer_id", "contributions", *r6("share"))


@query
def contribution_delta(s: SparkSession, d: str) -> DataFrame:
    out = temporal.anchored_deltas(view(s, d, "contributor_snapshots"), ["repository_id", "developer_id"], "captured_at", "contributions", _ref(s, d) - F.expr("INTERVAL 400 DAYS"))
    return out.select("repository_id", "developer_id", "window_days", "observations", "current", "base", "delta", "complete")


@query
def profile_deltas(s: SparkSession, d: str) -> DataFrame:
    out = temporal.anchored_deltas(view(s, d, "developer_snapshots"), ["developer_id"], "captured_at", "followers", _ref(s, d))
    return out.select("developer_id", "window_days", "current", "base", "delta", "complete")


@query
def activity_scores(s: SparkSession, d: str) -> DataFrame:
    return dev.activity_scores(activity(s, d)).select("developer_id", "available", *r6("score", "confidence"), "confidence_level", "active", "usable", "growth")


@query
def topic_relevance(s: SparkSession, d: str) -> DataFrame:
    out = dev.topic_relevance(activity(s, d), repositories(s, d), view(s, d, "repository_topics"))
    return out.select("developer_id", "topic", "repositories", "owned", *r6("relevance", "confidence"))


def _developers(s: SparkSession, d: str) -> DataFrame:
    return _labelled(s, d, activity(s, d), repositories(s, d))


def _labelled(s: SparkSession, d: str, act: DataFrame, repos: DataFrame) -> DataFrame:
    topics = view(s, d, "repository_topics")
    scores = cut(dev.activity_scores(act), "scores")
    eco = dev.ecosystem_scores(dev.topic_relevance(act, repos, topics), scores, repos, dev.associated(act, repos))
    followers = temporal.anchored_deltas(view(s, d, "developer_snapshots"), ["developer_id"], "captured_at", "followers", _ref(s, d), (30,))
    first = view(s, d, "links").groupBy("developer_id").agg(F.min("first_seen_at").alias("first_seen_at"))
    return dev.emerging(scores, eco, followers, first, _ref(s, d)).join(eco.select("developer_id", "ecosystem", "repositories", "owned", "missing"), "developer_id")


@query
def ecosystem_score(s: SparkSession, d: str) -> DataFrame:
    return _developers(s, d).select("developer_id", *r6("ecosystem"), "repositories", "owned", F.array_join("missing", ",").alias("missing"))


@query
def emerging(s: SparkSession, d: str) -> DataFrame:
    return _developers(s, d).select("developer_id", *r6("emerging", "follower_pct"), "evidence", "label")


@query
def emerging_list(s: SparkSession, d: str) -> DataFrame:
    rows = _developers(s, d).where("emerging >= 0.2").join(view(s, d, "developers").select(F.col("id").alias("developer_id"), "login"), "developer_id")
    return rows.orderBy(F.desc(F.round("emerging", 6)), "login").limit(15).select("login", *r6("emerging"), "label")


@query
def high_activity(s: SparkSession, d: str) -> DataFrame:
    rows = dev.activity_scores(activity(s, d)).where("confidence_level = 'HIGH'")
    return rows.orderBy(F.desc(F.round("score", 6)), "developer_id").limit(20).select("developer_id", *r6("score"))


@query
def developers_filtered(s: SparkSession, d: str) -> DataFrame:
    """In a topic, with a repository of a name, and at least so many followers."""
    people = view(s, d, "developers").where("followers >= 2000").select(F.col("id").alias("developer_id"), "login", "followers")
    repos = view(s, d, "repositories").where(F.contains(F.lower("full_name"), F.lit("#1")))
    rows = dev.associated(view(s, d, "links"), view(s, d, "repositories"))
    tagged = rows.join(view(s, d, "repository_topics").where("topic = 'size-1'").select("repository_id"), "repository_id", "left_semi").select("developer_id")
    named = rows.join(repos.select(F.col("id").alias("repository_id")), "repository_id", "left_semi").select("developer_id")
    return people.join(tagged, "developer_id", "left_semi").join(named, "developer_id", "left_semi")


@query
def topic_developer_rollup(s: SparkSession, d: str) -> DataFrame:
    act, repos = activity(s, d), repositories(s, d)
    out = dev.topic_rollup(dev.topic_relevance(act, repos, view(s, d, "repository_topics")), _labelled(s, d, act, repos))
    return out.select("topic", "developers", *r6("mean_relevance", "max_relevance"), "emerging", "active", "established", "quiet", "insufficient_history")


# ---- graph, over all links


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    links, repos = activity(s, d), repositories(s, d)
    return links, repos, dev.associated(links, repos), view(s, d, "repository_topics")


def _associated(s: SparkSession, d: str) -> DataFrame:
    """``developers.associated`` of all links, written once; a developer's rows lie together."""
    return cut(dev.associated(view(s, d, "links"), view(s, d, "repositories")).repartition("developer_id"), "associated")


@query
def graph_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.nodes(view(s, d, "developers"), view(s, d, "repositories"), view(s, d, "repository_topics"))


@query
def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.edges(view(s, d, "links"), view(s, d, "repositories"), view(s, d, "repository_topics"))


@query
def edge_counts(s: SparkSession, d: str) -> DataFrame:
    return graph_edges(s, d).groupBy("edge_type").agg(F.count("*").alias("edges"))


@query
def reach_developer(s: SparkSession, d: str) -> DataFrame:
    return graph.developer_reach(view(s, d, "developers"), _associated(s, d), view(s, d, "repository_topics"))


@query
def reach_repository(s: SparkSession, d: str) -> DataFrame:
    links, repos, assoc, topics = _graph(s, d)
    return graph.repository_reach(repos, links, assoc, topics)


@query
def reach_topic(s: SparkSession, d: str) -> DataFrame:
    _, _, assoc, topics = _graph(s, d)
    return graph.topic_reach(topics, assoc)


@query
def centrality_developer(s: SparkSession, d: str) -> DataFrame:
    return graph.developer_centrality(view(s, d, "developers"), _associated(s, d))


@query
def centrality_repository(s: SparkSession, d: str) -> DataFrame:
    return graph.repository_centrality(view(s, d, "repositories"), _associated(s, d))


@query
def centrality_topic(s: SparkSession, d: str) -> DataFrame:
    return graph.topic_centrality(view(s, d, "repository_topics"))


@query
def components(s: SparkSession, d: str) -> DataFrame:
    """Over all nodes and all three kinds of edges, even if they make one component."""
    return graph.components(graph_nodes(s, d), graph_edges(s, d))


@query
def co_contributors(s: SparkSession, d: str) -> DataFrame:
    links, repos, _, _ = _graph(s, d)
    out = graph.co_contributors(links, repos)
    return out.select("a", "b", "shared_repositories", *r6("strength", "confidence.score"), "confidence.level", F.array_join("missing", ",").alias("missing"))


@query
def related_repositories(s: SparkSession, d: str) -> DataFrame:
    _, _, assoc, topics = _graph(s, d)
    return graph.related_repositories(assoc, topics).select("a", "b", "developers", "topics", *r6("score"))


@query
def related_topics(s: SparkSession, d: str) -> DataFrame:
    _, _, assoc, topics = _graph(s, d)
    return graph.related_topics(assoc, topics).select("a", "b", "developers", "repositories", *r6("developer_overlap", "repository_overlap"))


@query
def developer_bridges(s: SparkSession, d: str) -> DataFrame:
    links, repos, assoc, topics = _graph(s, d)
    out = graph.developer_bridges(assoc, links, topics, repos)
    return out.select("developer_id", "memberships", "repositories", "contributions", "small_sample", *r6("bridge", "confidence.score"), "confidence.level")


@query
def cross_topic_bridges(s: SparkSession, d: str) -> DataFrame:
    links, _, assoc, topics = _graph(s, d)
    out = graph.cross_topic_bridges(assoc, links, topics, "size-1", "size-3")
    return out.select("developer_id", "contributions", "distinct_repositories", *r6("bridge", "confidence.score"), "confidence.level")


@query
def cross_topic_report(s: SparkSession, d: str) -> DataFrame:
    links, _, assoc, topics = _graph(s, d)
    out = graph.cross_topic_bridges(assoc, links, topics, "size-1", "size-3")
    return out.agg(F.count("*").alias("bridges"), F.count_distinct("developer_id").alias("developers"), F.round(expr.mean_or_zero(F.col("bridge")), 6).alias("mean_bridge"))


@query
def repository_bridges(s: SparkSession, d: str) -> DataFrame:
    links, repos, assoc, topics = _graph(s, d)
    out = graph.repository_bridges(assoc, links, topics, repos)
    return out.select("repository_id", "contributors", "topics", "cross_repository", "cross_topic", "connected", *r6("bridge", "confidence.score"), "confidence.level")


@query
def subgraph_filter(s: SparkSession, d: str) -> DataFrame:
    keep = view(s, d, "repository_topics").where("topic in ('size-1', 'size-2')").select(F.concat(F.lit("R:"), F.col("repository_id").cast("string")).alias("node"))
    return graph.subgraph(graph_edges(s, d), repositories=keep)


# ---- quality and evidence


@query
def quality_rollup(s: SparkSession, d: str) -> DataFrame:
    """Counts of repositories by observations, language and availability of momentum, in one pass."""
    repos = view(s, d, "dense_repositories").select(F.col("id").alias("repository_id"), "primary_language")
    return quality.repository_quality(dense_scored(s, d).join(repos, "repository_id"))


@query
def category_overlap(s: SparkSession, d: str) -> DataFrame:
    return quality.category_overlap(view(s, d, "dense_topics"), "repository_id", "topic")


@query
def developer_quality(s: SparkSession, d: str) -> DataFrame:
    act = activity(s, d)
    return quality.developer_quality(act, _labelled(s, d, act, repositories(s, d)))


@query
def developer_quality_windows(s: SparkSession, d: str) -> DataFrame:
    deltas = temporal.anchored_deltas(view(s, d, "contributor_snapshots"), ["repository_id", "developer_id"], "captured_at", "contributions", _ref(s, d))
    return quality.link_windows(view(s, d, "links"), deltas, temporal.WINDOWS)


@query
def quality_flags(s: SparkSession, d: str) -> DataFrame:
    newest = dense(s, d).groupBy(F.col("repository_id").alias("id")).agg(F.max("captured_at").alias("seen"))
    return quality.repository_flags(view(s, d, "dense_repositories"), newest, end_of(dense(s, d), "captured_at"))


@query
def evidence_ids(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "events").select("event_id", F.concat(F.lit("see E"), F.col("event_id") % 17, F.lit(" and E2, not xE3 or E"), F.col("user_id")).alias("t"))
    return rows.select("event_id", F.array_join(text.evidence_ids(F.col("t")), ",").alias("ids"))


@query
def text_normalize(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("\t \x01 "), F.replace("text", F.lit("\n"), F.lit(" \r\n")), F.lit("  "))
    return view(s, d, "documents").select("doc_id", text.normalize_payload(raw, 120).alias("payload"), F.md5(text.normalize_excerpt(raw, 10000)).alias("excerpt"))


def _evidence_items(s: SparkSession, d: str) -> DataFrame:
    """Events as evidence: payloads with quotes, accents, a clef beyond 16 bits and line ends, some with further pairs."""
    odd = F.element_at(F.array(*map(F.lit, ['"', "\u00e9\\", "\U0001d11e", "\n\t", "\u2028\x01"])), F.col("event_id").cast("int") % 5 + 1)
    meta = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("n"), F.col("event_id").cast("string"), F.lit("a"), odd))
    return view(s, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("source"), F.concat("props", odd).alias("payload"), meta.alias("meta"), F.col("ts").cast("timestamp").alias("observed_at"))


@query
def bundle_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """One evidence bundle per user, of their events."""
    return quality.bundle_fingerprints(_evidence_items(s, d), "entity", ["kind", "source", "payload"])


@query
def stored_bundles(s: SparkSession, d: str) -> DataFrame:
    """The bundles as they are stored: length and hash of their JSON."""
    items = _evidence_items(s, d)
    rows = quality.serialized_evidence(items, "entity", "developer", 7, end_of(items, "observed_at"), ["kind", "source", "payload"])
    return rows.select("entity", F.length("bundle_json").cast("long").alias("n"), F.sha2("bundle_json", 256).alias("bundle_sha256"))
