"""Landed API documents as rows: search results, details, contributors, users, files, releases and commits."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from observatory.functions.text import normalize_excerpt

REPOSITORY = (
    "id bigint, node_id string, name string, full_name string, owner struct<id: bigint, login: string>, description string, html_url string, homepage string, default_branch string, language string, "
    "visibility string, fork boolean, archived boolean, disabled boolean, is_template boolean, stargazers_count int, forks_count int, watchers_count int, subscribers_count int, open_issues_count int, "
    "size int, created_at timestamp, updated_at timestamp, pushed_at timestamp, topics array<string>"
)
CONTRIBUTOR = "id bigint, login string, avatar_url string, html_url string, contributions int"
USER = "id bigint, login string, name string, html_url string, blog string, email string, twitter_username string, followers int, following int, public_repos int"


def repositories(raw: DataFrame, body: str = "body") -> DataFrame:
    """One row per landed repository document; watchers are the subscribers where those are told."""
    x = F.from_json(body, REPOSITORY)
    rows = raw.select(x.alias("x")).where("x.id is not null")
    return rows.select(
        F.col("x.id").alias("github_id"), "x.full_name", F.col("x.owner.id").alias("owner_id"), F.col("x.owner.login").alias("owner_login"), F.col("x.language").alias("primary_language"), F.col("x.fork").alias("is_fork"),
        F.col("x.archived").alias("is_archived"), F.col("x.stargazers_count").alias("stars"), F.col("x.forks_count").alias("forks"), F.coalesce("x.subscribers_count", "x.watchers_count").alias("watchers"),
        F.col("x.open_issues_count").alias("open_issues"), F.col("x.size").alias("size_kb"), "x.created_at", "x.updated_at", "x.pushed_at", "x.topics",
    )


def search_results(raw: DataFrame, body: str = "body") -> DataFrame:
    """The items of landed search pages; pages marked incomplete are refused."""
    page = raw.select(F.from_json(body, "incomplete_results boolean, items array<string>").alias("p"))
    checked = page.select(F.when(F.col("p.incomplete_results"), F.raise_error(F.lit("incomplete search results"))).otherwise(F.col("p.items")).alias("items"))
    return repositories(checked.select(F.explode("items").alias("body")))


def contributors(raw: DataFrame, limit: int, key: str = "repository_id", body: str = "body") -> DataFrame:
    """The first ``limit`` contributors of each landed list, the last entry of an id standing."""
    rows = raw.select(key, F.posexplode(F.slice(F.from_json(body, f"array<struct<{_typed(CONTRIBUTOR)}>>"), 1, limit)).alias("pos", "c"))
    return rows.groupBy(key, F.col("c.id").alias("developer_id")).agg(F.max_by(F.struct("c.login", "c.contributions"), "pos").alias("x")).select(key, "developer_id", "x.*")


def users(raw: DataFrame, body: str = "body") -> DataFrame:
    return raw.select(F.from_json(body, USER).alias("u")).where("u.id is not null").select("u.*")


def _typed(ddl: str) -> str:
    return ", ".join(":".join(x.split(" ", 1)) for x in ddl.split(", "))


def readme_text(content: Column) -> Column:
    """A file's text from its base64 body; a missing file is empty."""
    return F.coalesce(F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8"), F.lit(""))


def commit_line(sha: Column, message: Column) -> Column:
    """Twelve digits of the hash and the message's first line; a blank one is a dash."""
    first = F.trim(F.element_at(F.split(F.coalesce(message, F.lit("")), "\n"), 1))
    return F.concat_ws(" ", F.substring(sha, 1, 12), F.when(first == "", "—").otherwise(first))


#: Releases of a repository that are read, and characters of a release's text.
RELEASES, RELEASE_CHARS = 5, 2000


def releases(raw: DataFrame, limit: int = RELEASES, key: str = "repository_id", body: str = "body") -> DataFrame:
    """(key, releases, text): the first ``limit`` releases of each landed list, and their text; none is the empty text."""
    typed = "array<struct<tag_name:string,name:string,published_at:string,body:string>>"
    found = F.slice(F.coalesce(F.from_json(body, typed), F.array().cast(typed)), 1, limit)
    or_else = lambda c, other: F.coalesce(F.when(c != "", c), other)
    line = lambda r: F.concat(F.lit("release "), or_else(r["tag_name"], or_else(r["name"], F.lit("?"))), F.lit(" (published "), or_else(r["published_at"], F.lit("unknown date")), F.lit("):\n"), normalize_excerpt(F.coalesce(r["body"], F.lit("")), RELEASE_CHARS))
    return raw.select(key, F.size(found).alias("releases"), F.array_join(F.transform(found, line), "\n\n").alias("text"))


def follow(pages: DataFrame, per_page: int, max_items: int | None = None, items_key: str | None = None, key: str = "chain") -> DataFrame:
    """(chain, page, position, item): the items of landed pages, each chain followed as its pages tell.

    ``pages`` is (chain, page, url, status, link, body), numbered from 1 within each chain. A chain ends
    at a page that is short, empty, of status 204 or names no next one in its link;
    what lies behind is ignored, as is what lies behind ``max_items``. Of pages that
    count it is an error to hold no list (under ``items_key``, if given), to say that
    results are incomplete, to lead to another endpoint, or not to be there though
    the page before names it.
    """
    path = lambda u: F.parse_url(u, F.lit("PATH"))
    following = F.nullif(F.regexp_extract(F.coalesce("link", F.lit("")), r'<([^>]*)>\s*;[^,]*rel="?next"?', 1), F.lit(""))
    whole = F.from_json("body", "incomplete_results boolean") if items_key else None
    items = F.from_json(F.get_json_object("body", f"$.{items_key}") if items_key else F.col("body"), "array<string>")
    rows = pages.select(key, "page", F.col("url"), F.coalesce("status", F.lit(200)).alias("status"), following.alias("next"), F.when(F.coalesce("status", F.lit(200)) != 204, items).alias("items"), (whole["incomplete_results"] if items_key else F.lit(False)).alias("partial"))
    size = F.coalesce(F.size("items"), F.lit(0))
    ends = (F.col("status") == 204) | F.col("next").isNull() | (size < per_page) | (size == 0)
    by = Window.partitionBy(key).orderBy("page")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", size).withColumn("ends", ends)
    rows = rows.withColumn("over", F.coalesce(F.max("ends").over(before), F.lit(False))).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("place", F.row_number().over(by)).withColumn("last", F.lead("page").over(by).isNull()).withColumn("first", F.first("url").over(by))
    counts = ~F.col("over") & (F.lit(True) if max_items is None else F.col("ahead") < max_items)
    wanted = F.lit(True) if max_items is None else F.col("ahead") + F.col("n") < max_items
    problem = (
        F.when(F.col("place") != F.col("page"), "a page isn't there").when((F.col("status") != 204) & F.col("items").isNull(), "a page has no list").when(F.col("partial"), "incomplete results")
        .when(~F.col("ends") & wanted & (path(F.col("next")) != path(F.coalesce("first", "next"))), "a page leads to another endpoint").when(~F.col("ends") & wanted & F.col("last"), "a page isn't there")
    )
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.lit(": "), F.col(key).cast("string"), F.lit("/"), F.col("page").cast("string")))).otherwise(F.col("items"))
    out = rows.where(counts).select(key, "page", "ahead", F.posexplode(checked).alias("at", "item"))
    out = out.select(key, "page", (F.col("ahead") + F.col("at")).cast("int").alias("position"), "item")
    return out if max_items is None else out.where(F.col("position") < max_items)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(category, topic) of a TOML catalog; the file is configuration and small."""
    with open(path, "rb") as f:
        found = tomllib.load(f).get("categories", {})
    rows = [(c, t) for c, body in found.items() for t in (body.get("topics", []) if isinstance(body, dict) else body)]
    return spark.createDataFrame(rows, "category string, topic string")
