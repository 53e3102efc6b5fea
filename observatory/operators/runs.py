"""Collection runs: what was done, what is due, and what a plan would ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from observatory.operators.ingest import first_of
from observatory.operators.quality import receipts


def operator_report(runs: DataFrame) -> DataFrame:
    """One row: the newest completed, final refresh, the newest discovery, and how many runs are partial, unfinished or over budget."""
    rows = receipts(runs)
    partial, started = F.coalesce("partial", F.lit(False)), F.struct("started_at", "run_id")
    good = (F.col("kind") == "refresh") & (F.col("status") == "completed") & F.col("finished_at").isNotNull() & ~partial
    unfinished = (F.col("status") == "running") | F.col("finished_at").isNull()
    newest = rows.agg(
        F.count("*").alias("runs"), F.max(F.when(good, F.struct("started_at", "run_id", "finished_at"))).alias("refresh"), F.max(F.when(F.col("kind") == "discover", F.struct(*started_fields(), "status"))).alias("discovery"),
        F.count_if(partial).alias("problem_runs"), F.count_if(unfinished).alias("unfinished_runs"), F.count_if("report.budget_exhausted").alias("exhausted_runs"), F.max(started).alias("newest"),
    )
    return newest.select("runs", F.col("refresh.run_id").alias("refresh_run"), F.unix_micros("refresh.finished_at").alias("refreshed_at"), F.col("discovery.run_id").alias("discovery_run"), F.col("discovery.status").alias("discovery_status"), "problem_runs", "unfinished_runs", "exhausted_runs", F.col("newest.run_id").alias("newest_run"))


def started_fields() -> list[Column]:
    return [F.col("started_at"), F.col("run_id")]


def problem_runs(runs: DataFrame, most: int = 20) -> DataFrame:
    """The newest ``most`` runs whose receipt is partial."""
    return receipts(runs).where("partial").orderBy(F.desc("started_at"), F.desc("run_id")).limit(most)


def scheduled(runs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(kind, decision, prior_run): blocked while any run is unfinished, skipped if one of the kind began in the period, else run.

    ``kinds`` is (kind, now): a refresh has its UTC day, anything else its week from Monday.
    """
    period = F.when(F.col("kind") == "refresh", F.date_trunc("day", "now")).otherwise(F.date_trunc("week", "now"))
    open_runs = runs.agg(F.count_if((F.col("status") == "running") | F.col("finished_at").isNull()).alias("unfinished"))
    asked = kinds.select("kind", period.alias("since"))
    prior = runs.join(F.broadcast(asked), "kind").where("started_at >= since").groupBy("kind").agg(F.max(F.struct("started_at", "run_id")).alias("p")).select("kind", F.col("p.run_id").alias("prior_run"))
    decision = F.when(F.col("unfinished") > 0, "blocked").when(F.col("prior_run").isNotNull(), "skipped").otherwise("run")
    return asked.join(prior, "kind", "left").crossJoin(F.broadcast(open_runs)).select("kind", decision.alias("decision"), "prior_run")


def stage(known: DataFrame, candidates: DataFrame, key: str, seq: str, names: list[str]) -> DataFrame:
    """(key, *names, is_new): each candidate once; a known key only takes over the names, a new one is to be fetched in full."""
    once = first_of(candidates.select(key, seq, *names), key, seq).drop("duplicates", seq)
    return once.join(known.select(key, F.lit(False).alias("__new")), key, "left").select(key, *names, F.coalesce("__new", F.lit(True)).alias("is_new"))


def refuse_older(newest: DataFrame, incoming: DataFrame, key: str, at: str) -> DataFrame:
    """``incoming`` with accepted: false where its clock is before the key's newest observation."""
    last = newest.groupBy(key).agg(F.max(at).alias("__last"))
    return incoming.join(last, key, "left").withColumn("accepted", F.coalesce(F.col(at) >= F.col("__last"), F.lit(True))).drop("__last")


def discovery_plan(categories: DataFrame, recipes: DataFrame, as_of: Column, limit: int, per_page: int) -> DataFrame:
    """(category, recipe, query, sort, slots, pages): each category (category, query) with each recipe; both are configuration and small.

    Recipes are (recipe, min_stars, max_stars, created_within_days, pushed_within_days, sort).
    """
    day = lambda n: F.date_format(F.date_sub(as_of, F.col(n)), "yyyy-MM-dd")
    stars = F.when(F.col("max_stars").isNotNull(), F.concat(F.lit("stars:"), F.col("min_stars"), F.lit(".."), F.col("max_stars"))).when(F.col("min_stars").isNotNull(), F.concat(F.lit("stars:>="), F.col("min_stars")))
    made = F.concat(F.lit("created:>="), day("created_within_days"))
    pushed = F.concat(F.lit("pushed:>="), day("pushed_within_days"))
    query = F.concat_ws(" ", "query", F.lit("is:public archived:false fork:false"), stars, made, pushed)
    both = categories.crossJoin(F.broadcast(recipes))
    return both.select("category", "recipe", query.alias("query"), "sort", F.lit(limit).alias("slots"), F.ceil(F.lit(limit) / per_page).cast("int").alias("pages"))


def discovery_demand(plan: DataFrame, contributors: int, caps: dict[str, int]) -> DataFrame:
    """(scope, required, cap, exceeded): requests of a plan if every slot were new; twice the same query and order is an error."""
    twice = plan.groupBy("query", "sort").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    sums = plan.agg(F.sum("slots").alias("slots"), F.sum("pages").alias("search")).crossJoin(F.broadcast(twice))
    sums = sums.withColumn("slots", F.when(F.col("n") > 1, F.raise_error(F.lit("two cohorts ask the same"))).otherwise(F.col("slots")))
    needs = {"search": F.col("search"), "repository_details": F.col("slots"), "contributors": F.col("slots") * -(-contributors // 100), "profiles": F.col("slots") * contributors}
    needs["total"] = needs["search"] + needs["repository_details"] + needs["contributors"] + needs["profiles"]
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("scope"), v.cast("long").alias("required"), F.lit(caps[k]).cast("long").alias("cap")) for k, v in needs.items()))).alias("x")).select("x.*")
    return rows.withColumn("exceeded", F.col("required") > F.col("cap"))


COUNTERS = "examined long, unique long, saved long, reused long, duplicates long, last_seq long, stopped string"


def discover(candidates: DataFrame, known: DataFrame, most_candidates: int, most_new: int, run_id: str, prior: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A bounded discovery run as a fold: (staged, provenance, receipt) of candidates in the order of seq.

    ``candidates`` is (seq, id, category, recipe, query), ``known`` has the ids stored
    before the run. A run examines ``most_candidates`` at most and stops at the first
    new id after ``most_new`` are saved, which counts as examined and unique; all
    behind it is left. staged is (seq, id, outcome): saved, reused, or duplicate of an
    id the run has had; provenance is ``ingest.note_provenance``'s input, of every
    candidate that isn't left; the receipt is one row of COUNTERS.

    ``prior`` are the three of an earlier part of the same run: its candidates are
    behind it, its budget is spent, its ids are duplicates. Two parts give the rows of
    one.
    """
    spark = candidates.sparkSession
    if prior is None:
        prior = (
            spark.createDataFrame([], "seq long, id long, outcome string"), spark.createDataFrame([], "repository_id long, category string, recipe string, query string, seen_seq long, run_id string"),
            spark.createDataFrame([(0, 0, 0, 0, 0, -1, None)], COUNTERS),
        )
    staged, noted, receipt = prior
    was = receipt.first()
    # a run that has stopped stays so; the rest of its candidates is small only by its caps
    left = 0 if was.stopped else max(0, most_candidates - was.examined)
    rows = candidates.where(F.col("seq") > was.last_seq).select("seq", "id", "category", "recipe", "query").orderBy("seq").limit(left)
    more = candidates.where(F.col("seq") > was.last_seq)
    seen = staged.where("outcome <> 'duplicate'").select("id", F.lit(True).alias("__seen"))
    first = rows.groupBy("id").agg(F.min("seq").alias("__first"))
    marked = rows.join(first, "id").join(seen, "id", "left").join(known.select("id", F.lit(True).alias("__known")).distinct(), "id", "left")
    duplicate = F.col("__seen").isNotNull() | (F.col("seq") > F.col("__first"))
    outcome = F.when(duplicate, "duplicate").when(F.col("__known"), "reused").otherwise("saved")
    marked = marked.select("seq", "id", "category", "recipe", "query", outcome.alias("outcome"))
    room = most_new - was.saved
    beyond = marked.where("outcome = 'saved'").orderBy("seq").limit(room + 1).agg(F.when(F.count("*") > room, F.max("seq")).alias("stop")).first().stop
    kept = marked if beyond is None else marked.where(F.col("seq") < beyond)
    counts = kept.agg(F.count("*").alias("n"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("saved", "reused", "duplicate")), F.max("seq").alias("last")).first()
    over = int(beyond is not None)
    examined = was.examined + counts.n + over
    truncated = examined >= most_candidates and not over and more.count() > counts.n
    stopped = was.stopped or ("max_new_repositories" if over else "max_candidates" if truncated else None)
    last = beyond if over else counts.last if counts.last is not None else was.last_seq
    new = (examined, was.unique + counts.saved + counts.reused + over, was.saved + counts.saved, was.reused + counts.reused, was.duplicates + counts.duplicate, last, stopped)
    provenance = kept.select(F.col("id").alias("repository_id"), "category", "recipe", "query", F.col("seq").alias("seen_seq"), F.lit(run_id).alias("run_id"))
    return staged.unionByName(kept.select("seq", "id", "outcome")), noted.unionByName(provenance), spark.createDataFrame([new], COUNTERS)
