"""The observation model as views over the star schema's tables.

Repositories are pairs of brand and type, developers suppliers, and a line item is
a contribution; the users of the event stream are repositories that are observed
densely. Each view is one SELECT in SQL that any engine reads; braces name tables
and other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from observatory.sources.tables import table

VIEWS = {
    "dense_snapshots": """
        SELECT event_id AS id, user_id AS repository_id, CAST(ts AS TIMESTAMP) AS captured_at,
          10 + count(*) OVER w AS stars, 1 + sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS forks,
          CASE WHEN value < 3 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS watchers,
          CAST(sum(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN -1 ELSE 0 END) OVER w AS BIGINT) AS open_issues,
          max(CASE WHEN event_type = 'purchase' THEN CAST(ts AS TIMESTAMP) END) OVER w AS pushed_at
        FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "dense_repositories": """
        SELECT user_id AS id, concat('org', CAST(user_id % 9 AS VARCHAR(9)), '/repo', CAST(user_id AS VARCHAR(20))) AS full_name,
          CASE user_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'Rust' WHEN 2 THEN 'go' END AS primary_language,
          user_id % 11 = 0 AS is_archived, user_id % 7 = 0 AS is_fork, min(CAST(ts AS TIMESTAMP)) AS first_seen_at, max(CAST(ts AS TIMESTAMP)) AS last_seen_at
        FROM {events} GROUP BY user_id""",
    "dense_topics": """
        SELECT user_id AS repository_id, concat('topic-', CAST(user_id % 6 AS VARCHAR(9))) AS topic FROM {events} GROUP BY user_id
        UNION SELECT user_id, concat('area_', CAST(user_id % 10 AS VARCHAR(9))) FROM {events} WHERE user_id % 3 <> 0 GROUP BY user_id""",
    "repositories": """
        SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE id % suppliers END AS owner_id, concat(p_brand, '/', p_type) AS full_name, p_brand, p_type, p_type AS primary_language
        FROM (SELECT CAST(dense_rank() OVER (ORDER BY p_brand, p_type) AS BIGINT) AS id, p_brand, p_type FROM (SELECT DISTINCT p_brand, p_type FROM {part}) x) y
          CROSS JOIN (SELECT count(*) AS suppliers FROM {supplier}) z""",
    "repository_topics": """
        SELECT id AS repository_id, lower(p_brand) AS topic FROM {repositories}
        UNION SELECT id, lower(p_type) FROM {repositories}
        UNION SELECT r.id, concat('size-', CAST(CAST(floor(p.p_size / 10) AS INT) AS VARCHAR(9))) FROM {part} p JOIN {repositories} r ON p.p_brand = r.p_brand AND p.p_type = r.p_type
          GROUP BY r.id, CAST(floor(p.p_size / 10) AS INT) HAVING count(*) >= 3""",
    "developers": """
        SELECT s_suppkey AS id, lower(s_name) AS login, CAST(floor(abs(s_acctbal)) AS BIGINT) AS followers FROM {supplier}""",
    "lines": """
        SELECT r.id AS repository_id, l.l_suppkey AS developer_id, CAST(l.l_shipdate AS TIMESTAMP) AS captured_at, l.l_orderkey, l.l_returnflag, l.l_linestatus
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {repositories} r ON p.p_brand = r.p_brand AND p.p_type = r.p_type""",
    "links": """
        SELECT repository_id, developer_id, count(*) AS contributions, min(captured_at) AS first_seen_at, max(captured_at) AS last_seen_at FROM {lines} GROUP BY repository_id, developer_id""",
    "contributor_snapshots": """
        SELECT repository_id, developer_id, captured_at, sum(n) OVER (PARTITION BY repository_id, developer_id ORDER BY captured_at ROWS UNBOUNDED PRECEDING) AS contributions
        FROM (SELECT repository_id, developer_id, captured_at, count(*) AS n FROM {lines} GROUP BY repository_id, developer_id, captured_at) x""",
    "repository_snapshots": """
        SELECT repository_id, captured_at, 10 + sum(n) OVER w AS stars, 1 + sum(r) OVER w AS forks, max(f) OVER w AS pushed_at
        FROM (SELECT repository_id, captured_at, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, max(CASE WHEN l_linestatus = 'F' THEN captured_at END) AS f
          FROM {lines} GROUP BY repository_id, captured_at) x WINDOW w AS (PARTITION BY repository_id ORDER BY captured_at ROWS UNBOUNDED PRECEDING)""",
    "developer_snapshots": """
        SELECT developer_id, captured_at, sum(n) OVER (PARTITION BY developer_id ORDER BY captured_at ROWS UNBOUNDED PRECEDING) AS followers
        FROM (SELECT developer_id, max(captured_at) AS captured_at, count(DISTINCT l_orderkey) AS n FROM {lines} GROUP BY developer_id, extract(year FROM captured_at), extract(month FROM captured_at)) x""",
    "profile_snapshots": """
        SELECT developer_id, captured_at, sum(n) OVER w AS followers, CASE WHEN sum(n) OVER w % 7 = 0 THEN NULL ELSE sum(f) OVER w END AS following, sum(r) OVER w AS public_repos
        FROM (SELECT developer_id, max(captured_at) AS captured_at, count(DISTINCT l_orderkey) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS f, count(DISTINCT repository_id) AS r
          FROM {lines} GROUP BY developer_id, extract(year FROM captured_at), extract(month FROM captured_at)) x WINDOW w AS (PARTITION BY developer_id ORDER BY captured_at ROWS UNBOUNDED PRECEDING)""",
    "collection_runs": """
        SELECT o_orderkey AS run_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'discover' ELSE 'refresh' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
          CAST(o_orderdate AS TIMESTAMP) AS started_at, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR END AS finished_at,
          concat(chr(123), '"partial":', CASE WHEN o_custkey % 10 = 0 THEN 'true' ELSE 'false' END, ',"candidates_examined":', CAST(o_custkey % 50 AS VARCHAR(20)), ',"new_repositories_saved":', CAST(o_custkey % 7 AS VARCHAR(20)),
            ',"existing_repositories_reused":', CAST(o_custkey % 11 AS VARCHAR(20)), ',"budget_exhausted":', CASE WHEN o_custkey % 13 = 0 THEN 'true' ELSE 'false' END, chr(125)) AS report_json,
          concat(chr(123), '"search":', CAST(o_custkey % 5 AS VARCHAR(20)), ',"contributors":', CAST(o_custkey % 9 AS VARCHAR(20)), chr(125)) AS requests_json
        FROM {orders}""",
    "artifacts": """
        SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'repository' WHEN 1 THEN 'developer' ELSE 'topic' END AS entity_type, CAST(o_custkey AS VARCHAR(20)) AS entity_key, o_orderpriority AS artifact_type,
          CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END AS window_days, CAST(o_orderdate AS TIMESTAMP) AS generated_at
        FROM {orders}""",
    "workspace": """
        SELECT s_suppkey AS developer_id, s_suppkey % 2 = 0 AS saved, CASE s_suppkey % 3 WHEN 0 THEN 'interested' WHEN 1 THEN 'contacted' ELSE 'declined' END AS status FROM {supplier} WHERE s_acctbal > 0""",
}


def needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def view(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The view's rows; a name that is no view is a table."""
    if name not in VIEWS:
        return table(spark, directory, name)
    text = VIEWS[name]
    return spark.sql(text, **{x: view(spark, directory, x) for x in needs(text)})
