"""Write-path operators as merges of batches.

Each takes what is stored and what came in, and returns what is stored next; the
caller writes it (or merges it, where the store can). Keys are unique in what is
stored; of several incoming rows of one key the order named here decides.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from observatory.functions.text import normalize_topic
from observatory.operators.temporal import dedup_last


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], seq: str, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """The last incoming row of a key replaces the stored one; ``keep_if_null`` columns only if they aren't null."""
    new = dedup_last(incoming, keys, seq).drop(seq)
    rest = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, F.struct(*rest).alias("__old"), F.lit(True).alias("__has_old"))
    both = old.join(new.select(*keys, F.struct(*rest).alias("__new"), F.lit(True).alias("__has_new")), keys, "full")
    value = lambda c: F.coalesce(F.col(f"__new.{c}"), F.col(f"__old.{c}")) if c in keep_if_null else F.when(F.col("__has_new"), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return both.select(*keys, *(value(c).alias(c) for c in rest)).select(*stored.columns)


def record(stored: DataFrame, incoming: DataFrame, keys: list[str], at: str, seq: str) -> DataFrame:
    """Observations: a new instant appends, the same instant replaces."""
    return upsert(stored, incoming, [*keys, at], seq)


def record_if_changed(stored: DataFrame, incoming: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """Appends an incoming observation unless its ``fields`` equal, null-safely, those before it in its series."""
    tagged = stored.withColumn("__new", F.lit(False)).unionByName(incoming.withColumn("__new", F.lit(True)))
    before = F.lag(F.struct(*fields)).over(Window.partitionBy(key).orderBy(at, "__new"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(at, "__new")) == 1
    rows = tagged.withColumn("__same", ~first & F.struct(*fields).eqNullSafe(before))
    return rows.where(~(F.col("__new") & F.col("__same"))).drop("__new", "__same")


def replace_topics(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(repository_id, topic): a repository that comes in has exactly its incoming topics, normalised, blank ones dropped."""
    new = incoming.select("repository_id", normalize_topic(F.col("topic")).alias("topic")).where("topic <> ''").distinct()
    return stored.join(incoming.select("repository_id").distinct(), "repository_id", "left_anti").select("repository_id", "topic").union(new)


def topic_changes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(repository_id, added, removed): sorted topics, of the repositories that come in."""
    gather = lambda df, n: df.groupBy("repository_id").agg(F.collect_set("topic").alias(n))
    new = incoming.select("repository_id", normalize_topic(F.col("topic")).alias("topic")).withColumn("topic", F.when(F.col("topic") != "", F.col("topic")))
    both = gather(new, "new").join(gather(stored, "old"), "repository_id", "left").withColumn("old", F.coalesce("old", F.array().cast("array<string>")))
    return both.select("repository_id", F.array_sort(F.array_except("new", "old")).alias("added"), F.array_sort(F.array_except("old", "new")).alias("removed"))


def note_provenance(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(repository_id, category, recipe, query_hash, query, first_seen_at, last_seen_at, last_run_id); the key's hash is the query's sha256."""
    keys = ["repository_id", "category", "recipe", "query_hash"]
    new = incoming.withColumn("query_hash", F.sha2("query", 256)).select(*keys, "query", F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"), F.col("run_id").alias("last_run_id"))
    return stored.unionByName(new).groupBy(*keys).agg(F.max("query").alias("query"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max_by("last_run_id", "last_seen_at").alias("last_run_id")).select(*stored.columns)


def due(rows: DataFrame, fetched: str, now: Column, days: int, fetched_limit: str | None = None, limit: int = 0) -> DataFrame:
    """Rows never fetched, fetched ``days`` or longer ago, or fetched with a smaller limit."""
    old = F.col(fetched).isNull() | (F.col(fetched) <= now - F.make_dt_interval(F.lit(days)))
    return rows.where(old | (F.coalesce(F.col(fetched_limit), F.lit(0)) < limit) if fetched_limit else old)


def cached_answers(events: DataFrame, key: str, at: str, seq: str, document: str, value: str, ttl: timedelta, keep: timedelta) -> DataFrame:
    """(key, seq, answer, value) of each request: hit where its key's last document is younger than ``ttl``, stale below ``keep``, else miss.

    ``document`` is true for documents; those of a request's own instant count.
    """
    span = lambda t: int(t.total_seconds() * 1e6)
    found = F.struct(F.unix_micros(at).alias("at"), F.col(value).cast("string").alias("value"))
    order = Window.partitionBy(key).orderBy(at, ~F.col(document), seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col(document), found), ignorenulls=True).over(order)
    rows = events.where(F.col(key).isNotNull()).withColumn("__last", last).where(~F.coalesce(document, F.lit(False)))
    age = F.unix_micros(at) - F.col("__last.at")
    answer = F.when(age < span(ttl), "hit").when(age < span(keep), "stale").otherwise("miss")
    return rows.select(F.col(key).alias("key"), F.col(seq).cast("bigint").alias("seq"), answer.alias("answer"), F.when(answer != "miss", F.col("__last.value")).alias("value"))


def first_of(incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """Candidates of a run: the first of each key, with ``duplicates`` counting the rest."""
    rest = [c for c in incoming.columns if c != key]
    out = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), seq).alias("x"), (F.count("*") - 1).alias("duplicates"))
    return out.select(key, "x.*", "duplicates")


def compare_and_swap(stored: DataFrame, edits: DataFrame, key: str, version: str = "version") -> DataFrame:
    """(key, applied): an edit applies if it names the stored version, or none where nothing is stored."""
    now = stored.select(key, F.col(version).alias("__now"))
    return edits.join(now, key, "left").select(key, F.col(version).eqNullSafe(F.col("__now")).alias("applied"))


def apply_edits(stored: DataFrame, edits: DataFrame, key: str, version: str = "version", new_version: str = "new_version", delete: str = "deleted") -> tuple[DataFrame, DataFrame]:
    """(what is stored next, (key, applied)): edits that name the stored version change or delete its row, or, naming none, add one.

    ``edits`` has the key, the version seen, the new one, whether it deletes, and the
    other columns of ``stored``; one edit a key. A deletion names a version. An edit
    that names another version than the stored one is a conflict and changes nothing.
    """
    rest = [c for c in stored.columns if c not in (key, version)]
    told = compare_and_swap(stored, edits, key, version)
    gone = F.coalesce(F.col(delete), F.lit(False))
    told = told.join(edits.select(key, (gone & F.col(version).isNull()).alias("__blind")), key).select(key, (F.col("applied") & ~F.col("__blind")).alias("applied"))
    good = edits.join(told.where("applied").select(key), key, "left_semi")
    kept = stored.join(good.select(key), key, "left_anti")
    made = good.where(~gone).select(key, F.col(new_version).alias(version), *rest).select(*stored.columns)
    return kept.unionByName(made), told


def cached_contributors(links: DataFrame, developers: DataFrame, repositories: DataFrame, limit: int) -> DataFrame:
    """(repository_id, place, developer_id, login, contributions): the first ``limit`` links of each repository that its last fetch saw, by contributions, then id.

    ``repositories`` is (id, fetched_at), ``links`` has last_seen_at.
    """
    fetched = repositories.select(F.col("id").alias("repository_id"), "fetched_at")
    rows = links.join(fetched, "repository_id").where(F.col("last_seen_at") == F.col("fetched_at")).join(developers.select(F.col("id").alias("developer_id"), "login"), "developer_id")
    order = Window.partitionBy("repository_id").orderBy(F.desc("contributions"), "developer_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("repository_id", "place", "developer_id", "login", "contributions")
