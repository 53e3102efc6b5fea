"""Reports on the data itself, evidence bundles and run receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from observatory.functions import json


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null over zero."""
    return F.try_divide(numerator.cast("double"), denominator)


def repository_quality(scored: DataFrame) -> DataFrame:
    """(dimension, value, repositories): grouping sets over observations (0, 1, 2, 3+), language and momentum."""
    rows = scored.select(
        F.when(F.col("n") >= 3, "3+").otherwise(F.col("n").cast("string")).alias("observations"), F.coalesce("primary_language", F.lit("unknown")).alias("language"),
        F.when(F.col("momentum").isNull(), "missing").otherwise("available").alias("momentum"), F.col("trend"),
    )
    names = ["observations", "language", "momentum", "trend"]
    sets = rows.groupingSets([[n] for n in names], *names).agg(F.count("*").alias("repositories"), F.grouping_id().alias("g"))
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, n in enumerate(names):
        here = F.col("g") == 15 - (1 << (3 - i))
        dimension, value = F.when(here, n).otherwise(dimension), F.when(here, F.col(n)).otherwise(value)
    return sets.select(dimension.alias("dimension"), value.alias("value"), "repositories")


def category_overlap(memberships: DataFrame, key: str, category: str) -> DataFrame:
    """(a, b, shared) for every two categories, a < b, 0 where they share nothing; the catalog is small, its members are not."""
    rows = memberships.select(key, F.col(category).alias("c")).distinct()
    names = rows.select("c").distinct()
    shared = rows.select(key, F.col("c").alias("a")).join(rows.select(key, F.col("c").alias("b")), key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = names.toDF("a").join(names.toDF("b"), F.col("a") < F.col("b"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def developer_quality(activity: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: links with usable and complete windows, developers by label."""
    links = activity.agg(F.count("*").alias("links"), F.count("delta").alias("usable"), F.count_if(F.col("delta").isNotNull() & F.col("complete")).alias("complete"))
    counts = [F.count_if(F.col("label") == x).alias(x.lower()) for x in ("EMERGING", "ACTIVE", "ESTABLISHED", "QUIET", "INSUFFICIENT_HISTORY")]
    return links.crossJoin(labelled.agg(F.count("*").alias("developers"), *counts))


def link_windows(links: DataFrame, deltas: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Per window: links, usable and complete ones, and developers with any such; ``deltas`` are ``anchored_deltas`` of contributions."""
    keys = ["repository_id", "developer_id", "window_days"]
    rows = links.select(*keys[:2], F.explode(F.array(*map(F.lit, windows))).alias("window_days")).join(deltas.select(*keys, "delta", "complete"), keys, "left")
    per = rows.groupBy("window_days", "developer_id").agg(F.count("*").alias("n"), F.count("delta").alias("u"), F.count_if("complete").alias("c"))
    return per.groupBy("window_days").agg(
        F.sum("n").alias("links"), F.sum("u").alias("usable"), F.sum("c").alias("complete"), F.count("*").alias("developers"),
        F.count_if(F.col("u") > 0).alias("developers_usable"), F.count_if(F.col("c") > 0).alias("developers_complete"),
    )


def repository_flags(repositories: DataFrame, newest: DataFrame, at: Column, stale_hours: int = 24) -> DataFrame:
    """One row: repositories that are archived, forks, last observed ``stale_hours`` before ``at`` or longer, never observed; ``newest`` is (id, seen)."""
    stale = F.unix_micros(at) - F.unix_micros("seen") >= stale_hours * 3_600_000_000
    return repositories.join(newest, "id", "left").agg(
        F.count("*").alias("repositories"), F.count_if("is_archived").alias("archived"), F.count_if("is_fork").alias("forked"), F.count_if(stale).alias("stale"), F.count_if(F.col("seen").isNull()).alias("never_observed"),
    )


def _meta(items: DataFrame) -> Column:
    """An item's further pairs, by key and value; without a ``meta`` column there are none."""
    if "meta" not in items.columns:
        return F.array().cast("array<struct<key:string,value:string>>")
    return F.array_sort(F.coalesce(F.map_entries("meta"), F.array().cast("array<struct<key:string,value:string>>")))


def cohorts(provenance: DataFrame) -> DataFrame:
    """(category, recipe, repositories): distinct repositories of each cohort, and of each category where recipe is null."""
    rows = provenance.select("category", "recipe", "repository_id").distinct()
    return rows.groupingSets([["category", "recipe"], ["category"]], "category", "recipe").agg(F.count_distinct("repository_id").alias("repositories"))


def provenance_coverage(repositories: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row: repositories with and without provenance, in several categories, memberships, and the largest category's share."""
    per = provenance.select("repository_id", "category").distinct().groupBy("repository_id").agg(F.count("*").alias("n"))
    rows = repositories.select(F.col("id").alias("repository_id")).join(per, "repository_id", "left")
    largest = provenance.select("repository_id", "category").distinct().groupBy("category").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    out = rows.agg(F.count("*").alias("repositories"), F.count("n").alias("with_provenance"), F.count_if(F.col("n").isNull()).alias("without_provenance"), F.count_if(F.col("n") > 1).alias("multiple_categories"), F.coalesce(F.sum("n"), F.lit(0)).alias("memberships"))
    return out.crossJoin(F.broadcast(largest)).select("*", ratio(F.col("largest"), F.col("repositories")).alias("largest_share")).drop("largest")


def ranking_composition(ranked: DataFrame, id_col: str, score: str, dimensions: list[str], most: int = 10) -> DataFrame:
    """(dimension, value, top, ranked): how the first ``most`` rows by score, then id, are made up against all that have a score.

    A null value is "unknown". The first rows are found by a bounded merge; one pass of
    grouping sets counts both.
    """
    scored = ranked.where(F.col(score).isNotNull())
    top = scored.orderBy(F.desc(score), id_col).limit(most).select(F.col(id_col).alias("__id"), F.lit(True).alias("__top"))
    rows = scored.join(F.broadcast(top), F.col(id_col) == F.col("__id"), "left").select("__top", *(F.coalesce(F.col(n).cast("string"), F.lit("unknown")).alias(n) for n in dimensions))
    sets = rows.groupingSets([[n] for n in dimensions], *dimensions).agg(F.count("__top").alias("top"), F.count("*").alias("ranked"), F.grouping_id().alias("g"))
    dimension, value, every = F.lit(None).cast("string"), F.lit(None).cast("string"), (1 << len(dimensions)) - 1
    for i, n in enumerate(dimensions):
        here = F.col("g") == every - (1 << (len(dimensions) - 1 - i))
        dimension, value = F.when(here, n).otherwise(dimension), F.when(here, F.col(n)).otherwise(value)
    return sets.select(dimension.alias("dimension"), value.alias("value"), "top", "ranked")


def ranking_cautions(scored: DataFrame, small_base: int = 10) -> DataFrame:
    """One row: ranked repositories, those with a 7-day window that isn't complete, HIGH confidence on fewer than three observations, a small base.

    ``scored`` is ``series_windows`` with momentum and confidence; the base is what the
    stars were a week before, and unknown without a window.
    """
    ranked = F.col("momentum").isNotNull()
    base = F.col("latest.stars") - F.col("stars7.delta")
    return scored.agg(
        F.count_if(ranked).alias("ranked"), F.count_if(ranked & ~F.coalesce("stars7.complete", F.lit(False))).alias("ranked_partial_7d"),
        F.count_if((F.col("confidence.level") == "HIGH") & (F.col("n") < 3)).alias("high_under_3"), F.count_if(ranked & (base < small_base)).alias("ranked_small_base"),
    )


def developer_cautions(developers: DataFrame, famous: int = 10_000, most: int = 10) -> DataFrame:
    """One row over (developer_id, followers, repositories, label, score, bridge): fame and single-repository evidence, of all and of the first ``most``.

    INSUFFICIENT_HISTORY isn't ranked.
    """
    top = developers.where("label <> 'INSUFFICIENT_HISTORY'").orderBy(F.desc("score"), "developer_id").limit(most)
    fame, single = F.col("followers") >= famous, F.col("repositories") == 1
    every = developers.agg(
        F.count("*").alias("developers"), F.count_if(fame).alias("all_famous"), F.count_if(single & (F.col("label") == "EMERGING")).alias("single_emerging"), F.max(F.when(single, F.col("bridge"))).alias("single_bridge_max")
    )
    return every.crossJoin(F.broadcast(top.agg(F.count("*").alias("top"), F.count_if(fame).alias("top_famous"), F.count_if(single).alias("top_single"))))


def bundle(items: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """``items`` with evidence_id E1, E2, ... by the columns of ``order``, then by their ``meta``, within each entity."""
    w = Window.partitionBy(entity).orderBy(*order, _meta(items))
    return items.withColumn("evidence_id", F.concat(F.lit("E"), F.row_number().over(w).cast("string")))


def bundle_fingerprints(items: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """(entity, items, fingerprint): sha256 of each entity's items as JSON, in the order of their ids as texts (E10 before E2).

    ``items`` has kind, source, payload and, if it likes, a map ``meta``; its JSON is
    that of ``json.dumps``: a list of objects id, kind, source, payload, meta, the last a
    list of pairs.
    """
    rows = bundle(items, entity, order)
    pair = lambda e: F.concat(F.lit("["), json.string(e["key"]), F.lit(", "), json.string(e["value"]), F.lit("]"))
    fields = {"id": json.string(F.col("evidence_id"))} | {n: json.string(F.col(n)) for n in ("kind", "source", "payload")} | {"meta": json.array(_meta(items), pair)}
    entry = F.struct("evidence_id", json.obj(fields).alias("j"))
    out = rows.groupBy(entity).agg(F.count("*").alias("items"), F.array_sort(F.collect_list(entry)).alias("x"))
    return out.select(entity, "items", F.sha2(json.array(F.col("x"), lambda e: e["j"]), 256).alias("fingerprint"))


def serialized_evidence(items: DataFrame, entity: str, entity_type: str, window_days: int, generated_at: Column, order: list[str]) -> DataFrame:
    """(entity, fingerprint, bundle_json): each entity's bundle as it is stored, keys by name and characters as they are.

    ``items`` has kind, source, payload and the instant ``observed_at``; instants are
    written in UTC to the second.
    """
    # an instant is a text of fixed form
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    plain = lambda c: json.string(c, False)
    # instants may be scalar subqueries, which lambdas can't hold
    rows = bundle(items, entity, order).withColumn("n", F.substring("evidence_id", 2, 19).cast("int"))
    item = {"id": plain(F.col("evidence_id")), "observed_at": plain(iso(F.col("observed_at")))} | {n: plain(F.col(n)) for n in ("kind", "source", "payload")}
    out = rows.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("n", json.obj(item, True).alias("j")))).alias("x"))
    out = out.join(bundle_fingerprints(items, entity, order).select(entity, "fingerprint"), entity).withColumn("made", iso(generated_at))
    whole = {"entity_type": plain(F.lit(entity_type)), "entity_key": plain(F.col(entity).cast("string")), "window_days": F.lit(str(window_days)), "fingerprint": plain(F.col("fingerprint")), "generated_at": plain(F.col("made")), "items": json.array(F.col("x"), lambda e: e["j"])}
    return out.select(entity, "fingerprint", json.obj(whole, True).alias("bundle_json"))


REPORT = "run_id string, kind string, status string, partial boolean, candidates_examined int, new_repositories_saved int, existing_repositories_reused int, budget_exhausted boolean, duration_seconds double"


def receipts(runs: DataFrame) -> DataFrame:
    """Runs with their report parsed; stored requests override it, and a running run is partial."""
    report = F.from_json("report_json", REPORT)
    partial = F.when(F.col("status") == "running", True).otherwise(report["partial"])
    return runs.withColumn("report", report).withColumn("requests", F.from_json("requests_json", "map<string,bigint>")).withColumn("partial", partial)


def collection_stats(runs: DataFrame) -> DataFrame:
    """One row over all receipts: sums, frequencies and requests per new repository."""
    rows = receipts(runs)
    spent = F.aggregate(F.map_values(F.coalesce("requests", F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = rows.agg(
        F.count("*").alias("runs"), F.sum(spent).alias("requests"), F.sum("report.candidates_examined").alias("examined"), F.sum("report.new_repositories_saved").alias("new"),
        F.sum("report.existing_repositories_reused").alias("reused"), F.count_if("partial").alias("partial"), F.count_if("report.budget_exhausted").alias("exhausted"),
    )
    return out.withColumn("partial_share", ratio(F.col("partial"), F.col("runs"))).withColumn("duplicate_rate", ratio(F.col("reused"), F.col("examined"))).withColumn("requests_per_new", ratio(F.col("requests"), F.col("new")))


def requests_by_scope(runs: DataFrame) -> DataFrame:
    return receipts(runs).select(F.explode("requests").alias("scope", "n")).groupBy("scope").agg(F.sum("n").alias("requests"))


def scaling(stats: DataFrame, targets: tuple[int, ...] = (50, 100, 300, 500)) -> DataFrame:
    """Requests that each target of repositories would take at the observed rate, and for new ones beside those saved."""
    rows = stats.select("requests", "new", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    return rows.select("target", F.ceil(ratio(F.col("target") * F.col("requests"), F.col("new"))).alias("requests"))
