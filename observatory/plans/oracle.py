"""The queries' results in SQL of another engine, formulated another way where there is one."""

from __future__ import annotations

from observatory.sources.domain import VIEWS, needs

#: Steps that several queries build on; like views, but for the oracle alone.
STEPS = {
    "last": "SELECT repository_id, count(*) AS n, min(captured_at) AS first_at, max(captured_at) AS newest_at FROM {dense_snapshots} GROUP BY repository_id",
    "bases": """
        SELECT t.repository_id, t.n, t.days, t.first_at, t.newest_at, coalesce(s.captured_at, t.first_at) AS base_at, s.captured_at IS NULL AS fallback
        FROM (SELECT l.*, d.days, newest_at - d.days * INTERVAL 1 DAY AS target FROM {last} l, (VALUES (1), (7), (30)) d(days)) t
        ASOF LEFT JOIN {dense_snapshots} s ON t.repository_id = s.repository_id AND t.target >= s.captured_at""",
    "fields": """
        SELECT repository_id, captured_at, 'stars' AS field, CAST(stars AS BIGINT) AS v FROM {dense_snapshots} UNION ALL SELECT repository_id, captured_at, 'forks', CAST(forks AS BIGINT) FROM {dense_snapshots}
        UNION ALL SELECT repository_id, captured_at, 'watchers', watchers FROM {dense_snapshots} UNION ALL SELECT repository_id, captured_at, 'open_issues', open_issues FROM {dense_snapshots}""",
    "deltas": """
        SELECT b.repository_id, x.field, b.days AS window_days, x.v AS base, y.v AS current, y.v - x.v AS delta,
          greatest(epoch_us(newest_at) - epoch_us(base_at), 3.6) / 86400e6 AS span_days,
          (y.v - x.v) / (greatest(epoch_us(newest_at) - epoch_us(base_at), 3.6) / 86400e6) AS per_day, CASE WHEN x.v <> 0 THEN 100.0 * (y.v - x.v) / x.v END AS growth_pct,
          NOT fallback AND (epoch_us(newest_at) - epoch_us(base_at)) / 86400e6 - b.days <= b.days * 0.5 AS complete
        FROM {bases} b JOIN {fields} x ON x.repository_id = b.repository_id AND x.captured_at = b.base_at
          JOIN {fields} y ON y.repository_id = b.repository_id AND y.captured_at = b.newest_at AND y.field = x.field
        WHERE b.n >= 2 AND x.v IS NOT NULL AND y.v IS NOT NULL""",
    "scored": """
        SELECT l.repository_id, l.n, l.first_at, l.newest_at, s.stars, s.pushed_at, r.recency, sd.growth_pct AS stars_pct, sd.per_day AS stars_day, fd.per_day AS forks_day, sd.complete,
          CASE WHEN sd.base > 0 AND fd.base > 0 THEN 0.05 * greatest(0, least(100, sd.growth_pct)) + 0.03 * greatest(0, least(100, fd.growth_pct)) + r.recency END AS momentum
        FROM {last} l JOIN {dense_snapshots} s ON s.repository_id = l.repository_id AND s.captured_at = l.newest_at
          JOIN (SELECT id, CASE WHEN pushed_at IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - (epoch_us(captured_at) - epoch_us(pushed_at)) / 86400e6 / 90)) END AS recency FROM {dense_snapshots}) r ON r.id = s.id
          LEFT JOIN {deltas} sd ON sd.repository_id = l.repository_id AND sd.field = 'stars' AND sd.window_days = 7
          LEFT JOIN {deltas} fd ON fd.repository_id = l.repository_id AND fd.field = 'forks' AND fd.window_days = 7""",
    "labelled": """
        SELECT *, CASE WHEN n < 2 THEN 'new' WHEN stars_pct >= 5 THEN 'rising' WHEN stars_pct <= -5 THEN 'declining' WHEN recency < 0.05 THEN 'inactive' ELSE 'steady' END AS trend FROM {scored}""",
    "covered": """
        SELECT repository_id, least(1, n / 5.0) AS count_term, CASE WHEN ok THEN least(1, g / 7) ELSE 0.0 END AS span_term, CASE WHEN ok THEN greatest(0, least(1, 1 - abs(g - 7) / 3.5)) ELSE 0.0 END AS gap_term,
          CASE WHEN ok THEN 0.34 * least(1, n / 5.0) + 0.33 * least(1, g / 7) + 0.33 * greatest(0, least(1, 1 - abs(g - 7) / 3.5)) ELSE 0.0 END AS score
        FROM (SELECT *, (epoch_us(newest_at) - epoch_us(base_at)) / 86400e6 AS g, n >= 2 AND NOT fallback AS ok FROM {bases} WHERE days = 7) x""",
    "ref": "SELECT max(captured_at) AS ref FROM {lines}",
    "anchored": """
        SELECT c.repository_id, c.developer_id, d.days AS window_days, c.observations, c.first_at, c.last_at, u.contributions AS current, u.captured_at AS cur_at, b.contributions AS base, b.captured_at AS base_at,
          CASE WHEN b.captured_at < u.captured_at THEN u.contributions - b.contributions END AS delta, d.days AS w, (epoch_us(c.ref) - epoch_us(b.captured_at)) / 86400e6 - d.days AS gap
        FROM (SELECT repository_id, developer_id, count(*) AS observations, min(captured_at) AS first_at, max(captured_at) AS last_at, any_value(ref) AS ref, any_value(ref) - INTERVAL 1 DAY AS t1, any_value(ref) - INTERVAL 7 DAY AS t7, any_value(ref) - INTERVAL 30 DAY AS t30
            FROM {contributor_snapshots}, {ref} GROUP BY ALL) c CROSS JOIN (VALUES (1), (7), (30)) d(days)
          ASOF JOIN {contributor_snapshots} u ON u.repository_id = c.repository_id AND u.developer_id = c.developer_id AND u.captured_at <= c.ref
          ASOF LEFT JOIN {contributor_snapshots} b ON b.repository_id = c.repository_id AND b.developer_id = c.developer_id AND b.captured_at <= CASE d.days WHEN 1 THEN t1 WHEN 7 THEN t7 ELSE t30 END""",
    "act": """
        SELECT l.*, l.contributions / sum(l.contributions) OVER (PARTITION BY l.repository_id) AS share, a.delta, coalesce(a.delta IS NOT NULL AND a.gap <= 15, false) AS complete, coalesce(a.observations, 0) AS observations,
          CASE WHEN a.observations >= 2 THEN (epoch_us(a.last_at) - epoch_us(a.first_at)) / 86400e6 END AS span
        FROM {links} l LEFT JOIN (SELECT * FROM {anchored} WHERE window_days = 30) a ON a.repository_id = l.repository_id AND a.developer_id = l.developer_id""",
    "repo_base": """
        SELECT x.*, s.captured_at AS before_at FROM (SELECT repository_id, count(*) AS n, min(captured_at) AS first_at, max(captured_at) AS newest_at, max(captured_at) - INTERVAL 7 DAY AS target FROM {repository_snapshots} GROUP BY repository_id) x
        ASOF LEFT JOIN {repository_snapshots} s ON s.repository_id = x.repository_id AND s.captured_at <= x.target""",
    "repos_scored": """
        SELECT r.id, r.owner_id, r.full_name, m.momentum, CASE WHEN m.n < 2 THEN 'new' WHEN m.pct >= 5 THEN 'rising' WHEN m.pct <= -5 THEN 'declining' WHEN m.recency < 0.05 THEN 'inactive' WHEN m.n IS NOT NULL THEN 'steady' END AS trend
        FROM {repositories} r LEFT JOIN (
          SELECT *, CASE WHEN n >= 2 AND s0 > 0 AND f0 > 0 THEN 0.05 * greatest(0, least(100, 100.0 * (s1 - s0) / s0)) + 0.03 * greatest(0, least(100, 100.0 * (f1 - f0) / f0)) + recency END AS momentum, CASE WHEN n >= 2 AND s0 <> 0 THEN 100.0 * (s1 - s0) / s0 END AS pct
          FROM (SELECT b.repository_id, b.n, x.stars AS s0, x.forks AS f0, y.stars AS s1, y.forks AS f1,
              CASE WHEN y.pushed_at IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - greatest(0, epoch_us(ref) - epoch_us(y.pushed_at)) / 86400e6 / 90)) END AS recency
            FROM {repo_base} b CROSS JOIN {ref} JOIN {repository_snapshots} x ON x.repository_id = b.repository_id AND x.captured_at = coalesce(b.before_at, b.first_at)
              JOIN {repository_snapshots} y ON y.repository_id = b.repository_id AND y.captured_at = b.newest_at) z) m ON m.repository_id = r.id""",
    "assoc": "SELECT developer_id, repository_id, bool_or(c) AS contributed, bool_or(NOT c) AS owned FROM (SELECT developer_id, repository_id, true AS c FROM {links} UNION ALL SELECT owner_id, id, false FROM {repositories} WHERE owner_id IS NOT NULL) x GROUP BY ALL",
    "relevance": """
        SELECT a.developer_id, t.topic, count(*) AS repositories, count(*) FILTER (a.owned) AS owned,
          least(1, 0.25 * least(1, count(*) / 5.0) + 0.30 * coalesce(avg(least(l.share, 0.25)) FILTER (a.contributed), 0) / 0.25 + 0.20 * least(1, count(*) FILTER (a.owned) / 3.0)
            + 0.15 * least(1, sqrt(coalesce(sum(l.delta) FILTER (l.delta > 0), 0)) / 10) + 0.10 * coalesce(avg(r.momentum), 0) / 9) AS relevance,
          least(1, 0.5 * least(1, count(*) / 10.0) + 0.3 * CASE WHEN count(*) FILTER (a.contributed) > 0 THEN count(*) FILTER (l.observations > 0) / count(*) FILTER (a.contributed) ELSE 0 END + 0.2 * least(1, coalesce(max(l.span), 0) / 30)) AS confidence
        FROM {assoc} a JOIN {repository_topics} t ON t.repository_id = a.repository_id JOIN {repos_scored} r ON r.id = a.repository_id
          LEFT JOIN {act} l ON l.repository_id = a.repository_id AND l.developer_id = a.developer_id GROUP BY a.developer_id, t.topic""",
    "activity": """
        SELECT *, CASE WHEN observations > 0 THEN usable > 0 END AS available,
          CASE WHEN observations > 0 THEN CASE WHEN usable > 0 THEN 0.5 * least(1, sqrt(growth) / 10) + 0.3 * active / usable + 0.2 * complete / usable ELSE 0 END END AS score,
          CASE WHEN observations > 0 THEN 0.4 * least(1, active / 3.0) + 0.3 * least(1, span / 30) + 0.3 * CASE WHEN usable > 0 THEN complete / usable ELSE 0 END END AS confidence
        FROM (SELECT developer_id, sum(observations) AS observations, count(delta) AS usable, count(*) FILTER (delta > 0) AS active, count(*) FILTER (delta IS NOT NULL AND complete) AS complete,
            coalesce(sum(delta) FILTER (delta > 0), 0) AS growth, coalesce(max(span), 0) AS span, sum(contributions) AS lifetime FROM {act} GROUP BY developer_id) x""",
    "ecosystem": """
        SELECT m.developer_id, m.repositories, m.owned, m.growing,
          least(1, 0.25 * coalesce(v.mean, 0) + 0.25 * coalesce(m.momentum, 0) / 9 + 0.20 * coalesce(a.score, 0) + 0.15 * least(1, m.owned / 3.0) + 0.15 * least(1, m.repositories / 5.0)) AS ecosystem,
          concat_ws(',', CASE WHEN m.momentum IS NULL THEN 'momentum' END, CASE WHEN NOT coalesce(a.available, false) THEN 'activity' END, CASE WHEN v.mean IS NULL THEN 'topic_relevance' END) AS missing
        FROM (SELECT a.developer_id, count(*) AS repositories, count(*) FILTER (a.owned) AS owned, avg(r.momentum) AS momentum, count(*) FILTER (r.momentum >= 3 OR r.trend = 'rising') / count(*) AS growing
            FROM {assoc} a JOIN {repos_scored} r ON r.id = a.repository_id GROUP BY a.developer_id) m
          LEFT JOIN (SELECT developer_id, avg(relevance) AS mean FROM {relevance} GROUP BY 1) v ON v.developer_id = m.developer_id LEFT JOIN {activity} a ON a.developer_id = m.developer_id""",
    "profile": """
        SELECT c.developer_id, d.days AS window_days, u.followers AS current, CASE WHEN b.captured_at < u.captured_at THEN b.followers END AS base, CASE WHEN b.captured_at < u.captured_at THEN u.followers - b.followers END AS delta,
          coalesce(b.captured_at < u.captured_at AND (epoch_us(c.ref) - epoch_us(b.captured_at)) / 86400e6 - d.days <= d.days * 0.5, false) AS complete
        FROM (SELECT DISTINCT developer_id, ref, ref - INTERVAL 1 DAY AS t1, ref - INTERVAL 7 DAY AS t7, ref - INTERVAL 30 DAY AS t30 FROM {developer_snapshots}, {ref}) c CROSS JOIN (VALUES (1), (7), (30)) d(days)
          ASOF JOIN {developer_snapshots} u ON u.developer_id = c.developer_id AND u.captured_at <= c.ref
          ASOF LEFT JOIN {developer_snapshots} b ON b.developer_id = c.developer_id AND b.captured_at <= CASE d.days WHEN 1 THEN t1 WHEN 7 THEN t7 ELSE t30 END""",
    "emerge": """
        SELECT *, CASE WHEN observations = 0 OR coalesce(confidence, 0) < 0.30 THEN 'INSUFFICIENT_HISTORY' WHEN emerging >= 0.30 AND evidence >= 2 THEN CASE WHEN growth > 0 THEN 'EMERGING' ELSE 'ACTIVE' END
            WHEN available AND emerging >= 0.15 THEN 'ACTIVE' WHEN span >= 90 OR lifetime >= 200 THEN 'ESTABLISHED' ELSE 'QUIET' END AS label
        FROM (SELECT *, CASE WHEN observations > 0 THEN least(1, 0.35 * least(1, sqrt(growth) / 10) + 0.25 * growing + 0.20 * newcomer + CASE WHEN pct > 0 THEN 0.10 * sqrt(pct / 100) ELSE 0 END + 0.10 * least(1, active / 2.0)) ELSE 0 END AS emerging,
            CASE WHEN observations > 0 THEN active + newcomer + CASE WHEN pct > 0 THEN 1 ELSE 0 END ELSE 0 END AS evidence
          FROM (SELECT a.*, e.growing, CASE WHEN p.base > 0 THEN 100.0 * p.delta / p.base END AS pct, CASE WHEN epoch_us(ref) - epoch_us(f.first_seen_at) <= 30 * 86400e6 THEN 1 ELSE 0 END AS newcomer
            FROM {activity} a JOIN {ecosystem} e ON e.developer_id = a.developer_id LEFT JOIN (SELECT * FROM {profile} WHERE window_days = 30) p ON p.developer_id = a.developer_id
              LEFT JOIN (SELECT developer_id, min(first_seen_at) AS first_seen_at FROM {links} GROUP BY 1) f ON f.developer_id = a.developer_id CROSS JOIN {ref}) x) y""",
    "evidence": """
        SELECT a.developer_id, t.topic, count(*) AS repositories, coalesce(sum(l.contributions), 0) AS contributions,
          CASE WHEN count(l.delta) > 0 THEN coalesce(sum(l.delta) FILTER (l.delta > 0), 0) END AS recent, CASE WHEN count(l.contributions) > 0 THEN count(*) FILTER (l.observations > 0) / count(l.contributions) ELSE 0 END AS history,
          least(1, 0.6 * least(1, count(*) / 2.0) + 0.4 * coalesce(avg(CASE WHEN l.share IS NOT NULL THEN least(l.share, 0.25) END), 0) / 0.25) AS strength
        FROM {assoc} a JOIN {repository_topics} t ON t.repository_id = a.repository_id LEFT JOIN {act} l ON l.repository_id = a.repository_id AND l.developer_id = a.developer_id GROUP BY a.developer_id, t.topic""",
    "crossing": """
        SELECT x.developer_id, x.contributions + y.contributions AS contributions, n.distinct_repositories,
          least(CASE WHEN x.contributions + y.contributions < 10 THEN 0.35 ELSE 1 END, 0.45 * (x.strength + y.strength) / 2 + 0.30 * least(1, least(x.repositories, y.repositories) / 2.0) + 0.25 * least(1, sqrt(coalesce(x.recent, 0) + coalesce(y.recent, 0)) / 10)) AS bridge,
          0.20 * least(1, n.distinct_repositories / 5.0) + 0.40 * (x.history + y.history) / 2 + 0.25 * ((x.recent IS NOT NULL)::INT + (y.recent IS NOT NULL)::INT) / 2 + 0.15 * 0.4 AS score
        FROM {evidence} x JOIN {evidence} y ON x.developer_id = y.developer_id AND x.topic = 'size-1' AND y.topic = 'size-3'
          JOIN (SELECT a.developer_id, count(DISTINCT a.repository_id) AS distinct_repositories FROM {assoc} a JOIN {repository_topics} t ON t.repository_id = a.repository_id WHERE t.topic IN ('size-1', 'size-3') GROUP BY 1) n ON n.developer_id = x.developer_id""",
    "graph_edges": """
        SELECT 'OWNS' AS edge_type, 'D:' || owner_id AS source, 'R:' || id AS target FROM {repositories} WHERE owner_id IS NOT NULL
        UNION ALL SELECT 'CONTRIBUTES_TO', 'D:' || developer_id, 'R:' || repository_id FROM {links} UNION ALL SELECT 'TAGGED_WITH', 'R:' || repository_id, 'T:' || topic FROM {repository_topics}""",
}

_LEVEL = "CASE WHEN {0} >= 0.75 THEN 'HIGH' WHEN {0} >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END"


def _level(x: str) -> str:
    return _LEVEL.replace("{0}", x)


def _graph_level(score: str, distinct: str) -> str:
    return f"CASE WHEN {score} >= 0.75 AND {distinct} >= 3 THEN 'HIGH' WHEN {score} >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END"


_TARGETS = "(SELECT repository_id, min(captured_at) + INTERVAL 10 DAY AS target FROM {dense_snapshots} GROUP BY 1)"

QUERIES = {
    "trending": "SELECT s.repository_id, r.full_name, round(s.momentum, 6) AS momentum, s.trend, round(s.stars_pct, 6) AS growth_pct FROM {labelled} s JOIN {dense_repositories} r ON r.id = s.repository_id WHERE s.momentum IS NOT NULL ORDER BY round(s.momentum, 6) DESC, r.last_seen_at DESC, r.full_name LIMIT 20",
    "window_deltas": "SELECT repository_id, field, window_days, base, current, delta, round(span_days, 6) AS span_days, round(per_day, 6) AS per_day, round(growth_pct, 6) AS growth_pct, complete FROM {deltas}",
    "as_of_before": f"SELECT t.repository_id, s.id AS found_id, s.stars FROM {_TARGETS} t ASOF LEFT JOIN {{dense_snapshots}} s ON s.repository_id = t.repository_id AND s.captured_at <= t.target",
    "as_of_after": f"SELECT t.repository_id, s.id AS found_id, s.stars FROM {_TARGETS} t ASOF LEFT JOIN {{dense_snapshots}} s ON s.repository_id = t.repository_id AND s.captured_at >= t.target",
    "as_of_nearest": f"SELECT repository_id, id AS found_id, stars FROM (SELECT t.repository_id, s.id, s.stars, row_number() OVER (PARTITION BY t.repository_id ORDER BY abs(epoch_us(s.captured_at) - epoch_us(t.target)), s.captured_at) AS k FROM {_TARGETS} t JOIN {{dense_snapshots}} s ON s.repository_id = t.repository_id) x WHERE k = 1",
    "previous_of": "SELECT t.repository_id, s.id AS found_id, s.stars FROM {last} t ASOF LEFT JOIN {dense_snapshots} s ON s.repository_id = t.repository_id AND s.captured_at < t.newest_at",
    "snapshot_dedup": "SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_id, event_type, value FROM {events} QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id DESC) = 1",
    "snapshot_if_changed": "SELECT id, repository_id, forks, open_issues FROM (SELECT *, row_number() OVER w AS k, lag(forks) OVER w AS f, lag(open_issues) OVER w AS o, lag(pushed_at) OVER w AS p FROM {dense_snapshots} WINDOW w AS (PARTITION BY repository_id ORDER BY captured_at)) x WHERE k = 1 OR f IS DISTINCT FROM forks OR o IS DISTINCT FROM open_issues OR p IS DISTINCT FROM pushed_at",
    "recency": "SELECT repository_id, round((now - epoch_us(first_at)) / 86400e6, 6) AS age_days, round((now - epoch_us(pushed_at)) / 86400e6, 6) AS days_since_push, round((now - epoch_us(newest_at)) / 86400e6, 6) AS days_since_update, round(CASE WHEN pushed_at IS NULL THEN 0 ELSE greatest(0, 1 - (now - epoch_us(pushed_at)) / 86400e6 / 90) END, 6) AS recency FROM {scored}, (SELECT max(epoch_us(captured_at)) AS now FROM {dense_snapshots}) x",
    "trend_class": "SELECT repository_id, trend, round(momentum, 6) AS momentum FROM {labelled}",
    "trend_histogram": "SELECT trend, count(*) AS repositories FROM {labelled} GROUP BY trend",
    "window_confidence": f"SELECT repository_id, round(score, 6) AS score, round(count_term, 6) AS count_term, round(span_term, 6) AS span_term, round(gap_term, 6) AS gap_term, {_level('score')} AS level FROM {{covered}}",
    "window_statuses": "SELECT w1, w7, w30, count(*) AS repositories FROM (SELECT l.repository_id, "
    + ", ".join(f"coalesce(max(CASE WHEN d.window_days = {w} THEN CASE WHEN d.complete THEN 'complete' ELSE 'partial' END END), 'unavailable') AS w{w}" for w in (1, 7, 30))
    + " FROM {last} l LEFT JOIN {deltas} d ON d.repository_id = l.repository_id AND d.field = 'watchers' GROUP BY 1) x GROUP BY ALL",
    "observation_gaps": "SELECT b.repository_id, count(*) AS missing, CAST(min(g.day) AS VARCHAR) AS first_missing FROM (SELECT DISTINCT repository_id, CAST(first_at AS DATE) AS born FROM {last}) b, (SELECT unnest(generate_series(1, 20)) AS k) n, (SELECT max(CAST(captured_at AS DATE)) AS today FROM {dense_snapshots}) t, LATERAL (SELECT CAST(today - CAST(k AS INT) AS DATE) AS day) g WHERE g.day >= b.born AND NOT EXISTS (SELECT 1 FROM {dense_snapshots} s WHERE s.repository_id = b.repository_id AND CAST(s.captured_at AS DATE) = g.day) GROUP BY 1",
    "topic_aggregates": f"SELECT topic, n AS repositories, round(total, 6) AS total_momentum, round(total / n, 6) AS mean_momentum, round(m / n, 6) AS share_with_momentum, round(c / n, 6) AS share_complete, round(0.5 * least(1, n / 10.0) + 0.3 * m / n + 0.2 * c / n, 6) AS confidence, CASE WHEN n < 10 AND {_level('(0.5 * least(1, n / 10.0) + 0.3 * m / n + 0.2 * c / n)')} = 'HIGH' THEN 'MEDIUM' ELSE {_level('(0.5 * least(1, n / 10.0) + 0.3 * m / n + 0.2 * c / n)')} END AS confidence_level FROM (SELECT t.topic, count(*) AS n, coalesce(sum(s.momentum), 0) AS total, count(s.momentum) AS m, count(*) FILTER (s.complete) AS c FROM {{dense_topics}} t JOIN {{scored}} s ON s.repository_id = t.repository_id GROUP BY 1) x",
    "topic_counts": "SELECT topic, count(*) AS repositories FROM {dense_topics} GROUP BY 1 UNION ALL SELECT 'unused', 0",
    "topic_members": "SELECT t.topic, r.full_name, row_number() OVER (ORDER BY round(s.momentum, 6) DESC NULLS LAST, r.full_name) AS place, round(s.momentum, 6) AS momentum FROM {dense_topics} t JOIN {scored} s ON s.repository_id = t.repository_id JOIN {dense_repositories} r ON r.id = t.repository_id WHERE t.topic = 'topic-1'",
    "repo_list_filtered": "SELECT r.id, r.full_name, s.stars FROM {dense_repositories} r JOIN {scored} s ON s.repository_id = r.id WHERE lower(primary_language) = 'go' AND NOT is_archived AND s.stars >= 20 ORDER BY s.stars DESC, r.full_name DESC LIMIT 10 OFFSET 10",
    "repo_summary": "SELECT count(*) AS repositories, round(avg(stars_day) FILTER (forks_day IS NOT NULL), 6) AS stars_per_day, round(avg(forks_day) FILTER (stars_day IS NOT NULL), 6) AS forks_per_day, "
    + ", ".join(f"count(*) FILTER (trend = '{t}') AS {t}" for t in ("rising", "steady", "declining", "new", "inactive"))
    + ", count(*) FILTER (c.score >= 0.75) AS high_confidence, round(coalesce(avg(momentum), 0), 6) AS mean_momentum FROM {labelled} l JOIN {covered} c ON c.repository_id = l.repository_id",
    "dataset_stats": "SELECT (SELECT count(*) FROM {events}) AS snapshots, (SELECT epoch_us(min(ts)) FROM {events}) AS first_at, (SELECT epoch_us(max(ts)) FROM {events}) AS last_at, (SELECT count(DISTINCT user_id) FROM {events}) AS repositories, (SELECT count(*) FROM {supplier}) AS developers, (SELECT count(DISTINCT topic) FROM {dense_topics}) AS topics",
    "newest_observation": "SELECT greatest((SELECT epoch_us(max(ts)) FROM {events}), (SELECT epoch_us(max(captured_at)) FROM {lines})) AS newest",
    "latest_snapshot_by_id": "SELECT repository_id, id, stars, watchers FROM {dense_snapshots} QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY id DESC) = 1",
    "latest_snapshot_by_time": "SELECT repository_id, stars, watchers FROM {dense_snapshots} s WHERE captured_at = (SELECT newest_at FROM {last} l WHERE l.repository_id = s.repository_id)",
    "repos_with_latest": "SELECT r.id, r.full_name, s.stars FROM {repositories} r LEFT JOIN (SELECT repository_id, stars FROM {dense_snapshots} WHERE id IN (SELECT max(id) FROM {dense_snapshots} GROUP BY repository_id)) s ON s.repository_id = r.id",
    "stale_queue": "SELECT r.id, epoch_us(l.newest_at) AS seen FROM {repositories} r LEFT JOIN {last} l ON l.repository_id = r.id WHERE l.newest_at IS NULL OR l.newest_at <= (SELECT max(captured_at) - INTERVAL 12 HOUR FROM {dense_snapshots}) ORDER BY l.newest_at ASC NULLS FIRST, r.id LIMIT 25",
    "search_names": "SELECT id, login FROM {developers} WHERE login LIKE '%supplier#00000000%' ORDER BY login LIMIT 20",
    "contributors_topn": "SELECT d.login, l.contributions FROM {links} l JOIN {developers} d ON d.id = l.developer_id WHERE l.repository_id = 7 ORDER BY l.contributions DESC, d.login LIMIT 10",
    "repositories_for_developer": "SELECT l.repository_id, r.full_name, l.contributions FROM {links} l JOIN {repositories} r ON r.id = l.repository_id WHERE l.developer_id = 3",
    "star_age_bands": "SELECT CASE WHEN s.stars < 10 THEN '0-9' WHEN s.stars < 100 THEN '10-99' WHEN s.stars < 1000 THEN '100-999' WHEN s.stars < 10000 THEN '1000-9999' ELSE '10000+' END AS stars, CASE WHEN a < 0 THEN 'future_created_at' WHEN a < 30 THEN 'under-30d' WHEN a < 365 THEN '30-364d' WHEN a < 1095 THEN '365-1094d' ELSE '1095d+' END AS age, count(*) AS repositories FROM (SELECT stars, ((SELECT epoch_us(max(captured_at)) FROM {dense_snapshots}) - epoch_us(first_at)) / 86400e6 AS a FROM {scored}) s GROUP BY ALL",
    "set_ops_union": "SELECT developer_id FROM {links} UNION SELECT owner_id FROM {repositories} WHERE owner_id IS NOT NULL",
    "set_ops_intersect": "SELECT DISTINCT developer_id FROM {links} WHERE developer_id IN (SELECT owner_id FROM {repositories} WHERE owner_id IS NOT NULL)",
    "set_ops_except": "SELECT id AS developer_id FROM {developers} WHERE id NOT IN (SELECT developer_id FROM {links})",
    "contribution_share": "SELECT l.repository_id, l.developer_id, l.contributions, round(l.contributions / t.n, 6) AS share FROM {links} l JOIN (SELECT repository_id, sum(contributions) AS n FROM {links} GROUP BY 1) t ON t.repository_id = l.repository_id",
    "profile_deltas": "SELECT developer_id, window_days, current, base, delta, complete FROM {profile}",
    "activity_scores": f"SELECT developer_id, available, round(score, 6) AS score, round(confidence, 6) AS confidence, {_level('confidence')} AS confidence_level, active, usable, growth FROM {{activity}}",
    "topic_relevance": "SELECT developer_id, topic, repositories, owned, round(relevance, 6) AS relevance, round(confidence, 6) AS confidence FROM {relevance}",
    "ecosystem_score": "SELECT e.developer_id, round(e.ecosystem, 6) AS ecosystem, e.repositories, e.owned, e.missing FROM {ecosystem} e JOIN {activity} a ON a.developer_id = e.developer_id",
    "emerging": "SELECT developer_id, round(emerging, 6) AS emerging, round(pct, 6) AS follower_pct, evidence, label FROM {emerge}",
    "emerging_list": "SELECT d.login, round(e.emerging, 6) AS emerging, e.label FROM {emerge} e JOIN {developers} d ON d.id = e.developer_id WHERE e.emerging >= 0.2 ORDER BY round(e.emerging, 6) DESC, d.login LIMIT 15",
    "high_activity": "SELECT developer_id, round(score, 6) AS score FROM {activity} WHERE confidence >= 0.75 ORDER BY round(score, 6) DESC, developer_id LIMIT 20",
    "developers_filtered": "SELECT d.id AS developer_id, d.login, d.followers FROM {developers} d WHERE d.followers >= 2000 AND EXISTS (SELECT 1 FROM {assoc} a JOIN {repository_topics} t ON t.repository_id = a.repository_id WHERE a.developer_id = d.id AND t.topic = 'size-1') AND EXISTS (SELECT 1 FROM {assoc} a JOIN {repositories} r ON r.id = a.repository_id WHERE a.developer_id = d.id AND lower(r.full_name) LIKE '%#1%')",
    "topic_developer_rollup": "SELECT v.topic, count(*) AS developers, round(avg(v.relevance), 6) AS mean_relevance, round(max(v.relevance), 6) AS max_relevance, "
    + ", ".join(f"count(*) FILTER (e.label = '{x}') AS {x.lower()}" for x in ("EMERGING", "ACTIVE", "ESTABLISHED", "QUIET", "INSUFFICIENT_HISTORY"))
    + " FROM {relevance} v LEFT JOIN {emerge} e ON e.developer_id = v.developer_id GROUP BY 1",
    "graph_nodes": "SELECT 'DEVELOPER' AS node_type, 'D:' || id AS node, login AS label FROM {developers} UNION ALL SELECT 'REPOSITORY', 'R:' || id, full_name FROM {repositories} UNION ALL SELECT DISTINCT 'TOPIC', 'T:' || topic, topic FROM {repository_topics}",
    "graph_edges": "SELECT * FROM {graph_edges}",
    "edge_counts": "SELECT edge_type, count(*) AS edges FROM {graph_edges} GROUP BY 1",
    "reach_developer": "SELECT d.id AS developer_id, count(DISTINCT a.repository_id) FILTER (a.contributed) AS contributed, count(DISTINCT a.repository_id) FILTER (a.owned) AS owned, count(DISTINCT a.repository_id) AS reached_repositories, count(DISTINCT b.developer_id) FILTER (b.developer_id <> d.id) AS reached_developers, count(DISTINCT t.topic) AS reached_topics FROM {developers} d LEFT JOIN {assoc} a ON a.developer_id = d.id LEFT JOIN {assoc} b ON b.repository_id = a.repository_id LEFT JOIN {repository_topics} t ON t.repository_id = a.repository_id GROUP BY d.id",
    "reach_repository": "SELECT r.id AS repository_id, CASE WHEN r.owner_id IS NULL THEN 0 ELSE 1 END AS owner, (SELECT count(DISTINCT developer_id) FROM {links} l WHERE l.repository_id = r.id) AS contributors, (SELECT count(DISTINCT topic) FROM {repository_topics} t WHERE t.repository_id = r.id) AS topics, (SELECT count(DISTINCT b.repository_id) FROM {assoc} a JOIN {assoc} b ON b.developer_id = a.developer_id AND b.repository_id <> a.repository_id WHERE a.repository_id = r.id) AS siblings FROM {repositories} r",
    "reach_topic": "SELECT t.topic, count(DISTINCT t.repository_id) AS repositories, count(DISTINCT a.developer_id) FILTER (a.contributed) AS contributing, count(DISTINCT a.developer_id) FILTER (a.owned) AS owning, count(DISTINCT a.developer_id) AS associated FROM {repository_topics} t LEFT JOIN {assoc} a ON a.repository_id = t.repository_id GROUP BY 1",
    "centrality_developer": "SELECT d.id AS developer_id, count(w) AS degree, coalesce(sum(w), 0) AS weight FROM {developers} d LEFT JOIN (SELECT a.developer_id, b.developer_id AS other, count(*) AS w FROM {assoc} a JOIN {assoc} b ON a.repository_id = b.repository_id AND a.developer_id <> b.developer_id GROUP BY ALL) p ON p.developer_id = d.id GROUP BY 1",
    "centrality_repository": "SELECT d.id AS repository_id, count(w) AS degree, coalesce(sum(w), 0) AS weight FROM {repositories} d LEFT JOIN (SELECT a.repository_id, b.repository_id AS other, count(*) + max(CASE WHEN x.owner_id = y.owner_id THEN 1 ELSE 0 END) AS w FROM {assoc} a JOIN {assoc} b ON a.developer_id = b.developer_id AND a.repository_id <> b.repository_id JOIN {repositories} x ON x.id = a.repository_id JOIN {repositories} y ON y.id = b.repository_id GROUP BY ALL) p ON p.repository_id = d.id GROUP BY 1",
    "centrality_topic": "SELECT d.topic, count(w) AS degree, coalesce(sum(w), 0) AS weight FROM (SELECT DISTINCT topic FROM {repository_topics}) d LEFT JOIN (SELECT a.topic, b.topic AS other, count(*) AS w FROM {repository_topics} a JOIN {repository_topics} b ON a.repository_id = b.repository_id AND a.topic <> b.topic GROUP BY ALL) p ON p.topic = d.topic GROUP BY 1",
    "co_contributors": "SELECT a, b, shared_repositories, round(least(1, 0.40 * least(1, ln(1 + shared_repositories) / ln(6)) + 0.30 * st + 0.20 * coalesce(mm / 9, 0) + 0.10 * coalesce(rc, 0)), 6) AS strength, round(score, 6) AS score, " + _graph_level("score", "shared_repositories") + " AS level, concat_ws(',', CASE WHEN mm IS NULL THEN 'momentum' END, CASE WHEN rc IS NULL THEN 'recent_activity' END) AS missing FROM (SELECT *, 0.20 * least(1, shared_repositories / 5.0) + 0.40 * h + 0.25 * rs AS score FROM (SELECT x.developer_id AS a, y.developer_id AS b, count(*) AS shared_repositories, avg(least(x.share, y.share, 0.25) / 0.25) AS st, avg(r.momentum) AS mm, avg(CASE WHEN x.delta IS NOT NULL AND y.delta IS NOT NULL THEN ((x.delta > 0)::INT + (y.delta > 0)::INT) / 2 WHEN coalesce(x.delta, y.delta) IS NOT NULL THEN (coalesce(x.delta, y.delta) > 0)::INT * 0.25 END) AS rc, avg((x.observations > 0 AND y.observations > 0)::INT) AS h, avg((x.delta IS NOT NULL AND y.delta IS NOT NULL)::INT) AS rs FROM {act} x JOIN {act} y ON x.repository_id = y.repository_id AND x.developer_id < y.developer_id JOIN {repos_scored} r ON r.id = x.repository_id GROUP BY ALL) z) q",
    "related_repositories": "SELECT a, b, developers, topics, round(0.5 * CASE WHEN da + db > 0 THEN developers / (da + db - developers) ELSE 0 END + 0.5 * CASE WHEN ta + tb > 0 THEN topics / (ta + tb - topics) ELSE 0 END, 6) AS score FROM (SELECT x.id AS a, y.id AS b, (SELECT count(*) FROM {assoc} p JOIN {assoc} q ON p.developer_id = q.developer_id WHERE p.repository_id = x.id AND q.repository_id = y.id) AS developers, (SELECT count(*) FROM {repository_topics} p JOIN {repository_topics} q ON p.topic = q.topic WHERE p.repository_id = x.id AND q.repository_id = y.id) AS topics, (SELECT count(*) FROM {assoc} p WHERE p.repository_id = x.id) AS da, (SELECT count(*) FROM {assoc} p WHERE p.repository_id = y.id) AS db, (SELECT count(*) FROM {repository_topics} p WHERE p.repository_id = x.id) AS ta, (SELECT count(*) FROM {repository_topics} p WHERE p.repository_id = y.id) AS tb FROM {repositories} x JOIN {repositories} y ON x.id < y.id) z WHERE developers > 0 OR topics > 0",
    "related_topics": "WITH people AS (SELECT DISTINCT a.developer_id, t.topic FROM {assoc} a JOIN {repository_topics} t ON t.repository_id = a.repository_id) SELECT a, b, developers, repositories, round(CASE WHEN da + db > 0 THEN developers / (da + db - developers) ELSE 0 END, 6) AS developer_overlap, round(repositories / (ra + rb - repositories), 6) AS repository_overlap FROM (SELECT x.topic AS a, y.topic AS b, (SELECT count(*) FROM people p JOIN people q ON p.developer_id = q.developer_id WHERE p.topic = x.topic AND q.topic = y.topic) AS developers, (SELECT count(*) FROM {repository_topics} p JOIN {repository_topics} q ON p.repository_id = q.repository_id WHERE p.topic = x.topic AND q.topic = y.topic) AS repositories, (SELECT count(*) FROM people p WHERE p.topic = x.topic) AS da, (SELECT count(*) FROM people p WHERE p.topic = y.topic) AS db, (SELECT count(*) FROM {repository_topics} p WHERE p.topic = x.topic) AS ra, (SELECT count(*) FROM {repository_topics} p WHERE p.topic = y.topic) AS rb FROM (SELECT DISTINCT topic FROM {repository_topics}) x JOIN (SELECT DISTINCT topic FROM {repository_topics}) y ON x.topic < y.topic) z WHERE developers > 0 OR repositories > 0",
    "developer_bridges": "SELECT developer_id, memberships, repositories, contributions, repositories < 2 OR contributions < 10 AS small_sample, round(CASE WHEN memberships < 2 THEN 0 ELSE least(CASE WHEN repositories < 2 OR contributions < 10 THEN 0.35 ELSE 1 END, raw) END, 6) AS bridge, round(score, 6) AS score, " + _graph_level("score", "repositories") + " AS level FROM (SELECT m.*, r.repositories, 0.30 * least(1, memberships / 4.0) + 0.25 * strength + 0.20 * least(1, (r.repositories - 1) / 2.0) + 0.10 * CASE WHEN memberships > 1 THEN least(1, h / ln(memberships)) ELSE 0 END + 0.10 * least(1, sqrt(coalesce(recent, 0)) / 10) + 0.05 * coalesce(mm / 9, 0) AS raw, 0.20 * least(1, r.repositories / 5.0) + 0.40 * hist + 0.25 * rs + 0.15 * least(1, memberships / 5.0) AS score FROM (SELECT e.developer_id, count(*) AS memberships, avg(strength) AS strength, sum(contributions) AS contributions, sum(recent) AS recent, sum(-e.repositories / t.n * ln(e.repositories / t.n)) AS h FROM {evidence} e JOIN (SELECT developer_id, sum(repositories) AS n FROM {evidence} GROUP BY 1) t ON t.developer_id = e.developer_id GROUP BY 1) m JOIN (SELECT a.developer_id, count(*) AS repositories, avg(s.momentum) AS mm, count(*) FILTER (l.observations > 0) / count(*) AS hist, count(l.delta) / count(*) AS rs FROM {assoc} a JOIN {repos_scored} s ON s.id = a.repository_id LEFT JOIN {act} l ON l.repository_id = a.repository_id AND l.developer_id = a.developer_id WHERE a.repository_id IN (SELECT repository_id FROM {repository_topics}) GROUP BY 1) r ON r.developer_id = m.developer_id) z",
    "cross_topic_bridges": "SELECT developer_id, contributions, distinct_repositories, round(bridge, 6) AS bridge, round(score, 6) AS score, " + _graph_level("score", "distinct_repositories") + " AS level FROM {crossing}",
    "cross_topic_report": "SELECT count(*) AS bridges, count(DISTINCT developer_id) AS developers, round(coalesce(avg(bridge), 0), 6) AS mean_bridge FROM {crossing}",
    "repository_bridges": "SELECT repository_id, contributors, topics, cross_repository, cross_topic, connected, round(least(CASE WHEN contributors < 2 THEN 0.35 ELSE 1 END, raw), 6) AS bridge, round(score, 6) AS score, " + _graph_level("score", "greatest(1, connected)") + " AS level FROM (SELECT *, 0.30 * least(1, ln(1 + contributors) / ln(21)) + 0.20 * least(1, ln(1 + topics) / ln(11)) + CASE WHEN contributors > 0 THEN 0.25 * cross_repository / contributors + 0.15 * cross_topic / contributors ELSE 0 END + 0.10 * coalesce(momentum / 9, 0) AS raw, 0.20 * least(1, greatest(1, connected) / 5.0) + CASE WHEN contributors > 0 THEN 0.40 * observed / contributors + 0.25 * recent / contributors ELSE 0 END + 0.15 * least(1, topics / 5.0) AS score FROM (SELECT r.id AS repository_id, r.momentum, (SELECT count(*) FROM {repository_topics} t WHERE t.repository_id = r.id) AS topics, count(a.developer_id) AS contributors, count(*) FILTER (b.n > 1) AS cross_repository, count(*) FILTER (b.t > 1) AS cross_topic, count(*) FILTER (l.observations > 0) AS observed, count(l.delta) AS recent, (SELECT count(DISTINCT y.repository_id) FROM {assoc} x JOIN {assoc} y ON y.developer_id = x.developer_id AND y.repository_id <> x.repository_id WHERE x.repository_id = r.id) AS connected FROM {repos_scored} r LEFT JOIN {assoc} a ON a.repository_id = r.id LEFT JOIN (SELECT p.developer_id, count(DISTINCT p.repository_id) AS n, count(DISTINCT t.topic) AS t FROM {assoc} p LEFT JOIN {repository_topics} t ON t.repository_id = p.repository_id GROUP BY 1) b ON b.developer_id = a.developer_id LEFT JOIN {act} l ON l.repository_id = a.repository_id AND l.developer_id = a.developer_id GROUP BY r.id, r.momentum) z) q",
    "subgraph_filter": "SELECT edge_type, source, target FROM {graph_edges}, (SELECT list('R:' || repository_id) AS keep FROM {repository_topics} WHERE topic IN ('size-1', 'size-2')) k WHERE (NOT starts_with(source, 'R:') OR list_contains(keep, source)) AND (NOT starts_with(target, 'R:') OR list_contains(keep, target))",
    "quality_rollup": "SELECT 'observations' AS dimension, CASE WHEN n >= 3 THEN '3+' ELSE CAST(n AS VARCHAR) END AS value, count(*) AS repositories FROM {labelled} GROUP BY ALL UNION ALL SELECT 'language', coalesce(primary_language, 'unknown'), count(*) FROM {dense_repositories} GROUP BY ALL UNION ALL SELECT 'momentum', CASE WHEN momentum IS NULL THEN 'missing' ELSE 'available' END, count(*) FROM {labelled} GROUP BY ALL UNION ALL SELECT 'trend', trend, count(*) FROM {labelled} GROUP BY ALL",
    "category_overlap": "SELECT x.topic AS a, y.topic AS b, (SELECT count(*) FROM {dense_topics} p JOIN {dense_topics} q ON p.repository_id = q.repository_id WHERE p.topic = x.topic AND q.topic = y.topic) AS shared FROM (SELECT DISTINCT topic FROM {dense_topics}) x JOIN (SELECT DISTINCT topic FROM {dense_topics}) y ON x.topic < y.topic",
    "developer_quality": "SELECT (SELECT count(*) FROM {act}) AS links, (SELECT count(delta) FROM {act}) AS usable, (SELECT count(*) FROM {act} WHERE delta IS NOT NULL AND complete) AS complete, count(*) AS developers, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x.lower()}" for x in ("EMERGING", "ACTIVE", "ESTABLISHED", "QUIET", "INSUFFICIENT_HISTORY")) + " FROM {emerge}",
    "evidence_ids": "SELECT event_id, array_to_string(list_sort(list_distinct(['E2', 'E' || (event_id % 17), 'E' || user_id])), ',') AS ids FROM {events}",
    "contribution_delta": "SELECT c.repository_id, c.developer_id, d.days AS window_days, c.observations, coalesce(u.contributions, f.contributions) AS current, CASE WHEN b.captured_at < u.captured_at THEN b.contributions END AS base, CASE WHEN b.captured_at < u.captured_at THEN u.contributions - b.contributions END AS delta, coalesce(b.captured_at < u.captured_at AND (epoch_us(c.ref) - epoch_us(b.captured_at)) / 86400e6 - d.days <= d.days * 0.5, false) AS complete FROM (SELECT repository_id, developer_id, count(*) AS observations, min(captured_at) AS first_at, any_value(ref) - INTERVAL 400 DAY AS ref, any_value(ref) - INTERVAL 401 DAY AS t1, any_value(ref) - INTERVAL 407 DAY AS t7, any_value(ref) - INTERVAL 430 DAY AS t30 FROM {contributor_snapshots}, {ref} GROUP BY ALL) c CROSS JOIN (VALUES (1), (7), (30)) d(days) JOIN {contributor_snapshots} f ON f.repository_id = c.repository_id AND f.developer_id = c.developer_id AND f.captured_at = c.first_at ASOF LEFT JOIN {contributor_snapshots} u ON u.repository_id = c.repository_id AND u.developer_id = c.developer_id AND u.captured_at <= c.ref ASOF LEFT JOIN {contributor_snapshots} b ON b.repository_id = c.repository_id AND b.developer_id = c.developer_id AND b.captured_at <= CASE d.days WHEN 1 THEN t1 WHEN 7 THEN t7 ELSE t30 END",
    "components": "WITH RECURSIVE e AS MATERIALIZED (SELECT 'D:' || owner_id AS x, 'R:' || id AS y FROM {repositories} WHERE owner_id IS NOT NULL UNION ALL SELECT 'D:' || developer_id, 'R:' || repository_id FROM {links} UNION ALL SELECT 'R:' || repository_id, 'T:' || topic FROM {repository_topics}), g AS MATERIALIZED (SELECT x AS u, y AS v FROM e UNION ALL SELECT y, x FROM e), n AS (SELECT 'D:' || id AS node FROM {developers} UNION SELECT 'R:' || id FROM {repositories} UNION SELECT 'T:' || topic FROM {repository_topics}), c AS (SELECT node, node AS seen FROM n UNION SELECT c.node, g.v FROM c JOIN g ON g.u = c.seen), m AS (SELECT node, min(seen) AS component FROM c GROUP BY 1) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM m",
}


def sql(text: str) -> str:
    """``text`` with the views and steps that it needs as CTEs before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        body = VIEWS.get(name) or STEPS.get(name)
        if body and name not in order:
            for x in needs(body):
                visit(x)
            order.append(name)

    for x in needs(text):
        visit(x)
    plain = lambda t: t.replace("{", "").replace("}", "")
    ctes = [f"{n} AS MATERIALIZED ({plain(VIEWS.get(n) or STEPS[n]).strip()})" for n in order]
    body = plain(text)
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[len("WITH RECURSIVE ") :]])
    if body.startswith("WITH "):
        return "WITH " + ", ".join([*ctes, body[len("WITH ") :]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body


ORACLE_SQL = {k: sql(v) for k, v in QUERIES.items()}
