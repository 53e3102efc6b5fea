"""Lookups, filters and ordered pages over the library's results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from observatory.functions.expr import level

# Fixed values of the lists.
DEFAULT_LIMIT, MOST_LIMIT = 25, 100
WINDOWS = (1, 7, 30)
TREND_ORDER = {"rising": 4, "steady": 3, "declining": 2, "new": 1, "inactive": 0}
BEST_TOPICS = 20


def window_days(text: str | None) -> int:
    """1d, 7d, 30d or the bare number; 7 where none is given."""
    raw = "7" if text is None else text.strip().lower().removesuffix("d")
    if not raw.isascii() or not raw.isdigit() or int(raw) not in WINDOWS:
        raise ValueError(f"a window is one of 1d, 7d, 30d, not {text!r}")
    return int(raw)


def resolve(refs: DataFrame, repositories: DataFrame) -> DataFrame:
    """(ref, id): ``refs`` (ref) are ids in digits or full names, case-sensitive, with white space and slashes around; null if nothing fits."""
    clean = F.trim(F.trim("ref"), F.lit("/"))
    number = F.when(F.rlike(clean, F.lit("^[0-9]+$")), F.try_to_number(clean, F.lit("9" * 18)).cast("long"))
    asked = refs.select("ref", clean.alias("__name"), number.alias("__id"))
    by_id = asked.where("__id is not null").join(repositories.select(F.col("id").alias("__id"), "id"), "__id", "left").select("ref", "id")
    by_name = asked.where("__id is null").join(repositories.select(F.col("full_name").alias("__name"), "id"), "__name", "left")
    return by_id.union(by_name.groupBy("ref").agg(F.min("id").alias("id")))


def page(rows: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """The rows from ``offset`` on, ``limit`` at most, with place (from 1), total and has_more; more than MOST_LIMIT are refused.

    Only offset + limit rows are ever brought into order in one place.
    """
    limit = DEFAULT_LIMIT if limit is None else limit
    if not 1 <= limit <= MOST_LIMIT or offset < 0:
        raise ValueError(f"limit is 1 to {MOST_LIMIT} and offset 0 or more, not {limit} and {offset}")
    top = rows.orderBy(*order).limit(offset + limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    total = rows.agg(F.count("*").alias("total"))
    return top.where(F.col("place") > offset).crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def filter_repositories(rows: DataFrame, language: str | None = None, trend: str | None = None, min_stars: int | None = None, max_stars: int | None = None, archived: bool | None = None, fork: bool | None = None) -> DataFrame:
    """Languages in any case, a missing one being ''; missing stars satisfy no bound."""
    if language is not None:
        rows = rows.where(F.lower(F.coalesce("primary_language", F.lit(""))) == language.lower())
    if trend is not None:
        rows = rows.where(F.col("trend") == trend)
    if min_stars is not None:
        rows = rows.where(F.col("stars") >= min_stars)
    if max_stars is not None:
        rows = rows.where(F.col("stars") <= max_stars)
    for name, wanted in (("is_archived", archived), ("is_fork", fork)):
        if wanted is not None:
            rows = rows.where(F.col(name) == wanted)
    return rows


def repository_order(sort: str = "last_seen", descending: bool = True) -> list[Column]:
    """By last_seen, name, stars, forks, momentum, stars_7d or trend, then by name in the same direction; missing values last when descending, else first."""
    keys = {"last_seen": F.col("last_seen_at"), "name": F.col("full_name"), "stars": F.col("stars"), "forks": F.col("forks"), "momentum": F.round("momentum", 6), "stars_7d": F.col("stars_7d")}
    rank = F.lit(-1)
    for name, at in TREND_ORDER.items():
        rank = F.when(F.col("trend") == name, at).otherwise(rank)
    key = rank if sort == "trend" else keys[sort]
    return [key.desc_nulls_last(), F.desc("full_name")] if descending else [key.asc_nulls_first(), F.asc("full_name")]


def filter_developers(people: DataFrame, assoc: DataFrame, repositories: DataFrame, relevance: DataFrame, topic: str | None = None, language: str | None = None, repository: str | None = None, min_followers: int | None = None, min_confidence: float | None = None) -> DataFrame:
    """Those of ``people`` (developer_id, followers, confidence, ...) relevant to the topic, with a repository of the language (any case) and one of a name that holds the text; missing numbers satisfy no bound.

    ``confidence`` is that of the emerging label.
    """
    def having(wanted: Column) -> DataFrame:
        return assoc.join(repositories.where(wanted).select(F.col("id").alias("repository_id")), "repository_id", "left_semi").select("developer_id")

    if topic is not None:
        people = people.join(relevance.where(F.col("topic") == topic).select("developer_id"), "developer_id", "left_semi")
    if language is not None:
        people = people.join(having(F.lower("primary_language") == language.lower()), "developer_id", "left_semi")
    if repository is not None:
        people = people.join(having(F.contains(F.lower("full_name"), F.lit(repository.lower()))), "developer_id", "left_semi")
    if min_followers is not None:
        people = people.where(F.col("followers") >= min_followers)
    return people if min_confidence is None else people.where(F.col("confidence") >= min_confidence)


def developer_order(sort: str = "relevance") -> list[Column]:
    """By relevance (0 counts as missing), activity, ecosystem, emerging or followers, largest first, missing last, then by login."""
    keys = {"relevance": F.coalesce(F.nullif(F.round("relevance", 6), F.lit(0.0)), F.lit(-1.0)), "activity": F.coalesce(F.round("activity", 6), F.lit(-1.0)), "ecosystem": F.coalesce(F.round("ecosystem", 6), F.lit(-1.0)), "emerging": F.round("emerging", 6), "followers": F.col("followers")}
    return [keys[sort].desc_nulls_last(), F.asc("login")]


def best_topics(relevance: DataFrame, most: int = BEST_TOPICS) -> DataFrame:
    """``relevance`` with place: each developer's topics, most relevant first, then by name; ``most`` at most."""
    order = Window.partitionBy("developer_id").orderBy(F.desc(F.round("relevance", 6)), "topic")
    return relevance.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def search(kinds: dict[str, DataFrame], text: str, most: int) -> DataFrame:
    """(kind, id, name) of the names that hold the trimmed text, in any case; ``most`` of each kind, by name."""
    wanted, out = F.lit(text.strip().lower()), None
    for kind, names in kinds.items():
        found = names.where(F.contains(F.lower("name"), wanted)).orderBy("name", "id").limit(most).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "name")
        out = found if out is None else out.union(found)
    return out


def node_named(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, node): the first node, by type and id, of each name in any case; null where none has it."""
    first = nodes.select(F.lower("label").alias("__key"), "node_type", "node").groupBy("__key").agg(F.min(F.struct("node_type", "node")).alias("x"))
    return names.withColumn("__key", F.lower("name")).join(first, "__key", "left").select("name", F.col("x.node").alias("node"))


def filter_workspace(people: DataFrame, states: DataFrame, saved: str = "saved", status: str | None = None, min_relevance: float | None = None) -> DataFrame:
    """``people`` (developer_id, relevance, ...) with their state (saved, status): saved, unsaved (no state is unsaved) or all; those of the status; relevance at least so much."""
    rows = people.join(states.select("developer_id", "saved", "status"), "developer_id", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))
    if saved != "all":
        rows = rows.where(F.col("saved") == (saved == "saved"))
    if status is not None:
        rows = rows.where(F.col("status") == status)
    return rows if min_relevance is None else rows.where(F.col("relevance") >= min_relevance)


def filter_artifacts(rows: DataFrame, entity_type: str | None = None, entity_key: str | None = None, artifact_type: str | None = None, window: int | None = None, limit: int = 50) -> DataFrame:
    """The newest ``limit`` artifacts that fit; of any window where none has the one asked for."""
    for name, wanted in (("entity_type", entity_type), ("entity_key", entity_key), ("artifact_type", artifact_type)):
        if wanted is not None:
            rows = rows.where(F.col(name) == wanted)
    if window is not None:
        fits = rows.agg(F.coalesce(F.bool_or(F.col("window_days") == window), F.lit(False)).alias("__any"))
        rows = rows.crossJoin(F.broadcast(fits)).where(~F.col("__any") | (F.col("window_days") == window)).drop("__any")
    return rows.orderBy(F.desc("generated_at"), F.desc("id")).limit(limit)


def strongest(levels: list[Column]) -> Column:
    """The highest of levels, nulls aside; LOW over nothing."""
    has = lambda x: F.coalesce(F.array_contains(F.array(*levels), F.lit(x)), F.lit(False))
    return F.when(has("HIGH"), "HIGH").when(has("MEDIUM"), "MEDIUM").otherwise("LOW")


def developer_level(available: Column, activity_confidence: Column, emerging_confidence: Column) -> Column:
    return strongest([F.when(available, level(activity_confidence)), level(emerging_confidence)])


def has_contact(*fields: str) -> Column:
    """Whether any of the public fields holds more than white space."""
    filled = [F.coalesce(F.trim(F.col(f)) != "", F.lit(False)) for f in fields]
    out = filled[0]
    for f in filled[1:]:
        out = out | f
    return out
