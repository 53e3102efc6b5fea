"""Developer scores over contribution links and their observations.

Inputs: ``links`` (repository_id, developer_id, contributions), ``activity``
(``anchored_deltas`` of contributions for one window, keyed by repository and
developer), ``repositories`` (id, owner_id, momentum, trend), ``topics``
(repository_id, topic).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.functions.expr import bounded, damped, days, level, mean_or_zero

# Fixed values of the scores.
SHARE_CAP = 0.25
RELEVANCE = (0.25, 0.30, 0.20, 0.15, 0.10)
ACTIVITY = (0.5, 0.3, 0.2)
ECOSYSTEM = (0.25, 0.25, 0.20, 0.15, 0.15)
EMERGING = (0.35, 0.25, 0.20, 0.10, 0.10)
MOMENTUM_FULL = 9.0


def shares(links: DataFrame) -> DataFrame:
    """Adds share, of the repository's contributions; 0.0 where that total is not positive."""
    # an aggregate and a join: partial sums leave a repository of very many links to no single task
    totals = links.groupBy("repository_id").agg(F.sum("contributions").alias("__total"))
    share = F.when(F.col("__total") > 0, F.col("contributions") / F.col("__total")).otherwise(0.0)
    return links.join(totals, "repository_id").withColumn("share", share).select(*links.columns, "share")


def link_activity(links: DataFrame, deltas: DataFrame) -> DataFrame:
    """Links with share and, from their observations, delta (null if unusable), complete, observations (0 if none) and span in days (null under two)."""
    span = F.when(F.col("observations") >= 2, F.greatest(F.lit(0.0), days(F.col("last_at"), F.col("first_at"))))
    d = deltas.select("repository_id", "developer_id", "delta", "complete", "observations", span.alias("span"))
    joined = shares(links).join(d, ["repository_id", "developer_id"], "left")
    return joined.withColumn("observations", F.coalesce("observations", F.lit(0)))


def associated(links: DataFrame, repositories: DataFrame) -> DataFrame:
    """Distinct (developer_id, repository_id, contributed, owned): contributions and ownership together."""
    c = links.select("developer_id", "repository_id", F.lit(1).alias("c"), F.lit(0).alias("o"))
    o = repositories.where("owner_id is not null").select(F.col("owner_id").alias("developer_id"), F.col("id").alias("repository_id"), F.lit(0).alias("c"), F.lit(1).alias("o"))
    return c.union(o).groupBy("developer_id", "repository_id").agg((F.max("c") == 1).alias("contributed"), (F.max("o") == 1).alias("owned"))


def topic_relevance(activity: DataFrame, repositories: DataFrame, topics: DataFrame) -> DataFrame:
    """One row per developer and topic of a repository they contribute to or own: relevance and its confidence."""
    rows = associated(activity, repositories).join(topics.select("repository_id", "topic").distinct(), "repository_id")
    rows = rows.join(activity.select("repository_id", "developer_id", "share", "delta", "observations", "span"), ["repository_id", "developer_id"], "left")
    rows = rows.join(repositories.select(F.col("id").alias("repository_id"), "momentum"), "repository_id")
    contributed = F.col("contributed")
    out = rows.groupBy("developer_id", "topic").agg(
        F.count("*").alias("repositories"), F.count_if("owned").alias("owned"), F.count_if(contributed).alias("links"),
        mean_or_zero(F.when(contributed, F.least("share", F.lit(SHARE_CAP)))).alias("mean_share"), F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0)).alias("growth"),
        mean_or_zero(F.col("momentum")).alias("mean_momentum"), F.count_if(contributed & (F.col("observations") > 0)).alias("observed"), F.coalesce(F.max("span"), F.lit(0.0)).alias("span"),
    )
    a, b, c, d, e = RELEVANCE
    score = a * bounded(F.col("repositories") / 5.0) + b * F.col("mean_share") / SHARE_CAP + c * bounded(F.col("owned") / 3.0) + d * damped(F.col("growth")) + e * F.col("mean_momentum") / MOMENTUM_FULL
    confidence = 0.5 * bounded(F.col("repositories") / 10.0) + 0.3 * F.coalesce(F.try_divide("observed", "links"), F.lit(0.0)) + 0.2 * bounded(F.col("span") / 30.0)
    return out.withColumn("relevance", bounded(score)).withColumn("confidence", bounded(confidence))


def activity_scores(activity: DataFrame) -> DataFrame:
    """Per developer with links: available and score, or both null if no link was ever observed.

    available is false, and the score 0, if no link has a usable delta.
    """
    usable = F.col("delta").isNotNull()
    out = activity.groupBy("developer_id").agg(
        F.count("*").alias("links"), F.sum("observations").alias("observations"), F.count_if(usable).alias("usable"), F.count_if(F.col("delta") > 0).alias("active"),
        F.count_if(usable & F.col("complete")).alias("complete"), F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0)).alias("growth"),
        F.coalesce(F.max("span"), F.lit(0.0)).alias("span"), F.sum("contributions").alias("lifetime"),
    )
    a, b, c = ACTIVITY
    score = a * damped(F.col("growth")) + b * F.try_divide("active", "usable") + c * F.try_divide("complete", "usable")
    confidence = 0.4 * bounded(F.col("active") / 3.0) + 0.3 * bounded(F.col("span") / 30.0) + 0.3 * F.coalesce(F.try_divide("complete", "usable"), F.lit(0.0))
    seen = F.col("observations") > 0
    out = out.withColumn("available", F.when(seen, F.col("usable") > 0)).withColumn("score", F.when(seen, F.when(F.col("usable") > 0, bounded(score)).otherwise(0.0)))
    return out.withColumn("confidence", F.when(seen, bounded(confidence))).withColumn("confidence_level", level(F.col("confidence")))


def ecosystem_scores(relevance: DataFrame, scores: DataFrame, repositories: DataFrame, assoc: DataFrame) -> DataFrame:
    """Per developer: how much of the ecosystem around their repositories they carry."""
    r = relevance.groupBy("developer_id").agg(F.avg("relevance").alias("mean_relevance"))
    m = assoc.join(repositories.select(F.col("id").alias("repository_id"), "momentum", "trend"), "repository_id").groupBy("developer_id").agg(
        F.count("*").alias("repositories"), F.count_if("owned").alias("owned"), F.avg("momentum").alias("mean_momentum"),
        (F.count_if((F.coalesce(F.col("momentum"), F.lit(0.0)) >= 3) | (F.col("trend") == "rising")) / F.count("*")).alias("share_growing"),
    )
    out = m.join(r, "developer_id", "left").join(scores.select("developer_id", F.col("score").alias("activity"), "available"), "developer_id", "left")
    a, b, c, d, e = ECOSYSTEM
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    score = a * zero("mean_relevance") + b * zero("mean_momentum") / MOMENTUM_FULL + c * zero("activity") + d * bounded(F.col("owned") / 3.0) + e * bounded(F.col("repositories") / 5.0)
    missing = F.array_compact(F.array(F.when(F.col("mean_momentum").isNull(), "momentum"), F.when(~F.coalesce("available", F.lit(False)), "activity"), F.when(F.col("mean_relevance").isNull(), "topic_relevance")))
    return out.withColumn("ecosystem", bounded(score)).withColumn("missing", missing)


def emerging(scores: DataFrame, ecosystem: DataFrame, followers: DataFrame, first_seen: DataFrame, ref: Column) -> DataFrame:
    """Per developer with links: emerging score, evidence points, confidence and label.

    ``followers``: anchored follower deltas of the window (developer_id, base,
    delta); ``first_seen``: (developer_id, first_seen_at).
    """
    pct = F.when(F.col("f_base") > 0, F.col("f_delta") / F.col("f_base") * 100)
    rows = scores.join(ecosystem.select("developer_id", "share_growing"), "developer_id").join(followers.select("developer_id", F.col("base").alias("f_base"), F.col("delta").alias("f_delta")), "developer_id", "left")
    rows = rows.join(first_seen, "developer_id", "left").withColumn("follower_pct", pct)
    newcomer = F.coalesce(days(ref, F.col("first_seen_at")) <= 30, F.lit(False))
    grown = F.coalesce(F.col("follower_pct") > 0, F.lit(False))
    a, b, c, d, e = EMERGING
    score = a * damped(F.col("growth")) + b * F.col("share_growing") + c * newcomer.cast("double") + F.when(grown, d * F.sqrt(F.col("follower_pct") / 100)).otherwise(0.0) + e * bounded(F.col("active") / 2.0)
    evidence = F.col("active") + newcomer.cast("int") + grown.cast("int")
    seen = F.col("observations") > 0
    rows = rows.withColumn("emerging", F.when(seen, bounded(score)).otherwise(0.0)).withColumn("evidence", F.when(seen, evidence).otherwise(0))
    conf = F.coalesce("confidence", F.lit(0.0))
    label = (
        F.when(F.col("observations") == 0, "INSUFFICIENT_HISTORY").when(conf < 0.30, "INSUFFICIENT_HISTORY")
        .when((F.col("emerging") >= 0.30) & (F.col("evidence") >= 2), F.when(F.col("growth") > 0, "EMERGING").otherwise("ACTIVE"))
        .when(F.col("available") & (F.col("emerging") >= 0.15), "ACTIVE").when((F.col("span") >= 90) | (F.col("lifetime") >= 200), "ESTABLISHED").otherwise("QUIET")
    )
    return rows.withColumn("label", label)


def topic_rollup(relevance: DataFrame, labels: DataFrame) -> DataFrame:
    """Per topic: developers, mean and largest relevance, and how many bear each label."""
    rows = relevance.select("developer_id", "topic", "relevance").join(labels.select("developer_id", "label"), "developer_id", "left")
    counts = [F.count_if(F.col("label") == x).alias(x.lower()) for x in ("EMERGING", "ACTIVE", "ESTABLISHED", "QUIET", "INSUFFICIENT_HISTORY")]
    return rows.groupBy("topic").agg(F.count("*").alias("developers"), F.avg("relevance").alias("mean_relevance"), F.max("relevance").alias("max_relevance"), *counts)
