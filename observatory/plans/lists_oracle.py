"""The results of ``plans.lists`` in SQL of another engine."""

from __future__ import annotations

from observatory.plans.oracle import QUERIES as BASE
from observatory.plans.oracle import sql

_LISTED = """(SELECT r.*, l.stars, l.forks, l.momentum, l.trend, x.delta AS stars_7d FROM {dense_repositories} r LEFT JOIN (SELECT s.*, f.v AS forks FROM {labelled} s LEFT JOIN {fields} f ON f.repository_id = s.repository_id AND f.captured_at = s.newest_at AND f.field = 'forks') l ON l.repository_id = r.id
    LEFT JOIN {deltas} x ON x.repository_id = r.id AND x.field = 'stars' AND x.window_days = 7)"""
_PEOPLE = """(SELECT e.*, d.login, d.followers, e.score AS activity FROM {emerge} e JOIN {developers} d ON d.id = e.developer_id)"""


def _paged(rows: str, order: str, columns: str, limit: int = 25, offset: int = 0) -> str:
    return f"SELECT place, {columns}, total, {offset + limit} < total AS has_more FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place, count(*) OVER () AS total FROM {rows} q) p WHERE place > {offset} AND place <= {offset + limit}"


_JSON = "CAST(json_extract(report_json, '$.{}') AS {})"
_PARTIAL = "(status = 'running' OR json_extract_string(report_json, '$.partial') = 'true')"


def _report(name: str) -> str:
    return f"CAST(json_extract_string(report_json, '$.{name}') AS BIGINT)"


_SEARCH, _CONTRIBUTORS = "CAST(json_extract_string(requests_json, '$.search') AS BIGINT)", "CAST(json_extract_string(requests_json, '$.contributors') AS BIGINT)"
_UNSTORED = "(SELECT * FROM {events} WHERE event_type <> 'view')"
_STORED = "(SELECT * FROM {events} WHERE event_type = 'view')"
_PLAN = """(SELECT lower(r_name) AS category, recipe, sort, 150 AS slots, 2 AS pages,
    concat_ws(' ', 'topic:' || lower(r_name), 'is:public archived:false fork:false', stars, made, pushed) AS query
    FROM {region}, (VALUES ('rising', 'stars:10..500', 'created:>=2023-03-02', 'pushed:>=2024-01-31', 'updated'), ('big', 'stars:>=1000', NULL, NULL, 'stars'), ('new', NULL, 'created:>=2024-01-01', NULL, 'stars')) v(recipe, stars, made, pushed, sort))"""
_ITEMS = """(SELECT user_id AS entity, event_type AS kind, CAST(event_id AS VARCHAR) AS source, props AS payload, 'E' || row_number() OVER (PARTITION BY user_id ORDER BY event_type, CAST(event_id AS VARCHAR), props) AS evidence_id FROM {events})"""
#: White space as the texts' rules take it; an engine without lookahead takes the line feed along.
_SPACE = r"[\t-\r \x85\p{Z}]"
_RAW_TEXT = r"(chr(9) || ' ' || chr(1) || ' ' || replace(text, chr(10), ' ' || chr(13) || chr(10)) || '  ')"


def _stripped(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


def _cut(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) > {most} THEN regexp_replace(substring({x}, 1, {most}), '{_SPACE}+$', '') || ' …[truncated]' WHEN {x} = '' THEN '—' ELSE {x} END"


# JSON as Python's json.dumps writes it; braces stand for tables in these texts, so those of JSON are chr(123) and chr(125)
_UNIT = "'\\u' || lpad(lower(to_hex({})), 4, '0')"
_SHORT = "WHEN '\"' THEN '\\\"' WHEN '\\' THEN '\\\\' WHEN chr(10) THEN '\\n' WHEN chr(13) THEN '\\r' WHEN chr(9) THEN '\\t' WHEN chr(12) THEN '\\f' WHEN chr(8) THEN '\\b'"


def _escaped(value: str, ascii_only: bool) -> str:
    high, low = _UNIT.format("((unicode(c) - 65536) // 1024 + 55296)"), _UNIT.format("((unicode(c) - 65536) % 1024 + 56320)")
    beyond = f"WHEN unicode(c) >= 65536 THEN {high} || {low} WHEN unicode(c) > 126 THEN {_UNIT.format('unicode(c)')} " if ascii_only else ""
    one = f"CASE c {_SHORT} ELSE CASE {beyond}WHEN unicode(c) < 32 THEN {_UNIT.format('unicode(c)')} ELSE c END END"
    return f"""'"' || array_to_string(list_transform(regexp_extract_all({value}, '(?s).'), lambda c: {one}), '') || '"'"""


def _string(value: str) -> str:
    return _escaped(value, True)


def _plain(value: str) -> str:
    return _escaped(value, False)


def _quoted(value: str) -> str:
    return f"""'"' || {value} || '"'"""


def _object(fields: list[tuple[str, str]]) -> str:
    return "chr(123) || " + " || ', ' || ".join(f"""'"{k}": ' || {v}""" for k, v in fields) + " || chr(125)"


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"
_ODD = "CASE event_id % 5 WHEN 0 THEN '\"' WHEN 1 THEN chr(233) || '\\' WHEN 2 THEN chr(119070) WHEN 3 THEN chr(10) || chr(9) ELSE chr(8232) || chr(1) END"
_PAIRS = f"'[[\"a\", ' || {_string('odd')} || '], [\"n\", ' || {_string('source')} || ']]'"
_EVIDENCE = f"""(SELECT *, 'E' || place AS evidence_id, CASE WHEN event_id % 3 = 0 THEN {_PAIRS} ELSE '[]' END AS meta FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY kind, source, payload) AS place FROM
    (SELECT event_id, user_id AS entity, event_type AS kind, CAST(event_id AS VARCHAR) AS source, {_ODD} AS odd, props || {_ODD} AS payload, ts AS observed_at FROM {{events}}) x) y)"""


QUERIES = {
    "lookup_references": "SELECT ref, CASE WHEN regexp_full_match(n, '[0-9]+') THEN (SELECT id FROM {dense_repositories} WHERE CAST(id AS VARCHAR) = n) ELSE (SELECT id FROM {dense_repositories} WHERE full_name = n) END AS id FROM (SELECT ref, trim(trim(ref), '/') AS n FROM (VALUES ('7'), (' /org1/repo1/ '), ('ORG1/repo1'), ('12345678901'), ('nobody/x'), ('org2/repo2')) v(ref)) x",
    "repository_history": "SELECT id, epoch_us(captured_at) AS captured_at, stars, forks, watchers FROM {dense_snapshots} WHERE repository_id = 5",
    "rows_by_ids": "SELECT id, full_name, primary_language FROM {dense_repositories} WHERE id IN (1, 5, 9, 100000000)",
    "repo_list_last_seen": _paged(_LISTED, "last_seen_at DESC NULLS LAST, full_name DESC", "id, full_name"),
    "repo_list_momentum": _paged(f"(SELECT * FROM {_LISTED} z WHERE NOT is_archived AND NOT is_fork)", "round(momentum, 6) DESC NULLS LAST, full_name DESC", "id, round(momentum, 6) AS momentum", 100, 10),
    "repo_list_stars_7d_ascending": _paged(f"(SELECT * FROM {_LISTED} z WHERE stars BETWEEN 20 AND 100000)", "stars_7d ASC NULLS FIRST, full_name", "id, stars_7d", 50),
    "repo_list_trend": _paged(f"(SELECT * FROM {_LISTED} z WHERE lower(primary_language) = 'rust')", "CASE trend WHEN 'rising' THEN 4 WHEN 'steady' THEN 3 WHEN 'declining' THEN 2 WHEN 'new' THEN 1 WHEN 'inactive' THEN 0 ELSE -1 END DESC, full_name DESC", "id, trend", 40),
    "repo_list_of_trend": _paged(f"(SELECT * FROM {_LISTED} z WHERE trend = 'rising')", "full_name", "full_name, stars"),
    "quality_ranking": "SELECT repository_id, round(momentum, 6) AS momentum FROM {scored} WHERE momentum IS NOT NULL ORDER BY round(momentum, 6) DESC, repository_id LIMIT 10",
    "due_count": "SELECT count(*) FILTER (l.newest_at IS NULL OR l.newest_at <= (SELECT max(captured_at) - INTERVAL 12 HOUR FROM {dense_snapshots})) AS due FROM {repositories} r LEFT JOIN {last} l ON l.repository_id = r.id",
    "freshness": "SELECT epoch_us(max(ts)) AS newest, CAST(floor((epoch_us(TIMESTAMP '2024-06-01 12:00:00') - epoch_us(max(ts))) / 86400e6) AS INT) AS stale_days FROM {events}",
    "developers_by_relevance": _paged(f"(SELECT p.*, v.relevance FROM {_PEOPLE} p JOIN {{relevance}} v ON v.developer_id = p.developer_id AND v.topic = 'size-1' WHERE p.followers >= 1000)", "CASE WHEN round(relevance, 6) = 0 THEN -1 ELSE round(relevance, 6) END DESC, login", "login, followers, round(relevance, 6) AS relevance"),
    "developers_by_activity": _paged(f"(SELECT * FROM {_PEOPLE} p WHERE confidence >= 0.5 AND developer_id IN (SELECT a.developer_id FROM {{assoc}} a JOIN {{repositories}} r ON r.id = a.repository_id WHERE lower(r.primary_language) = 'economy'))", "coalesce(round(activity, 6), -1) DESC, login", "login, round(activity, 6) AS activity", 50),
    "developers_by_followers": _paged(f"(SELECT * FROM {_PEOPLE} p WHERE developer_id IN (SELECT a.developer_id FROM {{assoc}} a JOIN {{repositories}} r ON r.id = a.repository_id WHERE r.full_name ILIKE '%brand#1/%'))", "followers DESC NULLS LAST, login", "login, followers", 10, 5),
    "best_topic": "SELECT developer_id, place, topic, round(relevance, 6) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY developer_id ORDER BY round(relevance, 6) DESC, topic) AS place FROM {relevance}) x WHERE place <= 3",
    "developer_levels": "SELECT CASE WHEN confidence >= 0.75 THEN 'HIGH' WHEN confidence >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level, count(*) AS developers FROM {activity} GROUP BY 1",
    "workspace_saved": _paged(f"(SELECT p.developer_id, v.relevance FROM {_PEOPLE} p JOIN {{relevance}} v ON v.developer_id = p.developer_id AND v.topic = 'size-1' JOIN {{workspace}} w ON w.developer_id = p.developer_id WHERE w.saved AND w.status = 'interested' AND v.relevance >= 0.3)", "round(relevance, 6) DESC, developer_id", "developer_id, round(relevance, 6) AS relevance"),
    "workspace_unsaved": "SELECT d.id AS developer_id, d.login, w.status FROM {developers} d LEFT JOIN {workspace} w ON w.developer_id = d.id WHERE w.saved IS DISTINCT FROM true",
    "search_all": " UNION ALL ".join(
        f"(SELECT '{kind}' AS kind, CAST({i} AS VARCHAR) AS id, {n} AS name FROM (SELECT DISTINCT {i}, {n} AS {n if n != i else 'same'} FROM {{{v}}} WHERE lower({n}) LIKE '%brand#1%') x ORDER BY {n}, {i} LIMIT 10)"
        for kind, v, i, n in (("repository", "repositories", "id", "full_name"), ("topic", "repository_topics", "topic", "topic"), ("developer", "developers", "id", "login"))
    ),
    "nodes_in_order": _paged(f"({BASE['graph_nodes']})", "node_type, node", "node_type, node", 100, 50),
    "topics_by_centrality": _paged(f"({BASE['centrality_topic']})", "weight DESC, degree DESC, lower(topic)", "topic, degree, weight"),
    "edges_of_type": "SELECT source, target FROM {graph_edges} WHERE edge_type = 'OWNS'",
    "node_lookup": f"SELECT name, (SELECT node FROM ({BASE['graph_nodes']}) n WHERE lower(n.label) = lower(v.name) ORDER BY node_type, node LIMIT 1) AS node FROM (VALUES ('SUPPLIER#000000003'), ('size-1'), ('brand#1/economy'), ('nobody')) v(name)",
    "bridges_page": _paged(f"(SELECT * FROM ({BASE['developer_bridges']}) b WHERE score >= 0.3 AND developer_id IN (SELECT a.developer_id FROM {{assoc}} a JOIN {{repository_topics}} t ON t.repository_id = a.repository_id WHERE t.topic = 'size-2'))", "bridge DESC, developer_id", "developer_id, bridge", 20),
    "shared_evidence": "SELECT a.repository_id, r.full_name, a.contributions AS a_contributions, round(a.share, 6) AS a_share, b.contributions AS b_contributions, round(b.share, 6) AS b_share FROM {act} a JOIN {act} b ON b.repository_id = a.repository_id AND a.developer_id = 1 AND b.developer_id = 2 JOIN {repositories} r ON r.id = a.repository_id",
    "ecosystem_report": "",
    "developer_report": f"SELECT r.developer_id, d.login, r.contributed, r.owned, r.reached_repositories, r.reached_developers, r.reached_topics, c.degree, c.weight, b.memberships, b.bridge FROM ({BASE['reach_developer']}) r JOIN ({BASE['centrality_developer']}) c ON c.developer_id = r.developer_id JOIN {{developers}} d ON d.id = r.developer_id LEFT JOIN ({BASE['developer_bridges']}) b ON b.developer_id = r.developer_id WHERE r.developer_id = 3",
    "topic_report": f"SELECT * FROM ({BASE['reach_topic']}) r, (SELECT CASE WHEN a = 'size-1' THEN b ELSE a END AS other, developers AS shared_developers, repositories AS shared_repositories FROM (SELECT a.topic AS a, b.topic AS b, count(DISTINCT a.repository_id) FILTER (a.repository_id = b.repository_id) AS repositories, count(DISTINCT a.developer_id) AS developers FROM (SELECT t.topic, t.repository_id, p.developer_id FROM {{repository_topics}} t LEFT JOIN {{assoc}} p ON p.repository_id = t.repository_id) a JOIN (SELECT t.topic, t.repository_id, p.developer_id FROM {{repository_topics}} t LEFT JOIN {{assoc}} p ON p.repository_id = t.repository_id) b ON a.topic = 'size-1' AND b.topic <> a.topic AND a.developer_id = b.developer_id GROUP BY 1, 2) x ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10) y WHERE r.topic = 'size-1'",
    "repository_report": f"SELECT r.*, x.other, x.shared_developers FROM ({BASE['reach_repository']}) r, (SELECT b.repository_id AS other, count(DISTINCT b.developer_id) AS shared_developers FROM {{assoc}} a JOIN {{assoc}} b ON a.repository_id = 5 AND b.developer_id = a.developer_id AND b.repository_id <> 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) x WHERE r.repository_id = 5",
    "subgraph_of_momentum": "SELECT e.* FROM {graph_edges} e, (SELECT list('R:' || id) AS keep FROM {repos_scored} WHERE momentum >= 0.5 AND id IN (SELECT repository_id FROM {repository_topics} WHERE topic IN ('size-1', 'size-2'))) k WHERE (NOT starts_with(source, 'R:') OR list_contains(keep, source)) AND (NOT starts_with(target, 'R:') OR list_contains(keep, target))",
    "owner_changes": "SELECT 'D:' || (event_id % 7) AS source, 'R:' || user_id AS target FROM (SELECT * FROM {events} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) x WHERE event_type <> 'error'",
    "developer_memberships": "SELECT a.developer_id, array_to_string(list_sort(list(DISTINCT t.topic)), ',') AS topics FROM {assoc} a JOIN {repository_topics} t ON t.repository_id = a.repository_id GROUP BY 1",
    "graph_projection": f"SELECT node_type, node, place, weight FROM (SELECT n.node_type, n.node, c.weight, row_number() OVER (PARTITION BY n.node_type ORDER BY c.weight DESC, c.degree DESC, n.label) AS place FROM ({BASE['graph_nodes']}) n JOIN (SELECT 'D:' || developer_id AS node, degree, weight FROM ({BASE['centrality_developer']}) d UNION ALL SELECT 'R:' || repository_id, degree, weight FROM ({BASE['centrality_repository']}) r UNION ALL SELECT 'T:' || topic, degree, weight FROM ({BASE['centrality_topic']}) t) c ON c.node = n.node) x WHERE place <= 18",
    "artifact_counts": "SELECT o_orderpriority AS artifact_type, count(*) AS artifacts FROM {orders} GROUP BY 1",
    "artifacts_newest": "SELECT id, entity_key, window_days, epoch_us(generated_at) AS generated_at FROM {artifacts} WHERE entity_type = 'developer' AND artifact_type = '2-HIGH' AND window_days = 7 ORDER BY {artifacts}.generated_at DESC, id DESC LIMIT 50",
    "artifact_by_key": "WITH fits AS (SELECT * FROM {artifacts} WHERE entity_type = 'repository' AND entity_key = '3') SELECT id, artifact_type, window_days FROM fits WHERE window_days = 30 OR NOT EXISTS (SELECT 1 FROM fits WHERE window_days = 30) ORDER BY generated_at DESC, id DESC LIMIT 5",
    "run_receipts": f"SELECT run_id, kind, status, {_PARTIAL} AS partial, CAST({_report('candidates_examined')} AS INT) AS examined, {_SEARCH} AS search_requests FROM {{collection_runs}} ORDER BY started_at DESC, run_id DESC LIMIT 100",
    "run_stats": f"SELECT *, round(partial / runs, 6) AS partial_share, round(reused / examined, 6) AS duplicate_rate, round(requests / new, 6) AS requests_per_new FROM (SELECT count(*) AS runs, sum({_SEARCH} + {_CONTRIBUTORS}) AS requests, sum({_report('candidates_examined')}) AS examined, sum({_report('new_repositories_saved')}) AS new, sum({_report('existing_repositories_reused')}) AS reused, count(*) FILTER {_PARTIAL.replace('(status', '(status', 1)} AS partial, count(*) FILTER (json_extract_string(report_json, '$.budget_exhausted') = 'true') AS exhausted FROM {{collection_runs}}) x",
    "run_requests": f"SELECT 'search' AS scope, sum({_SEARCH}) AS requests FROM {{collection_runs}} UNION ALL SELECT 'contributors', sum({_CONTRIBUTORS}) FROM {{collection_runs}}",
    "run_scaling": f"SELECT target, CAST(ceil(target * requests / new) AS BIGINT) AS requests FROM (SELECT sum({_SEARCH} + {_CONTRIBUTORS}) AS requests, sum({_report('new_repositories_saved')}) AS new FROM {{collection_runs}}) x, (VALUES (50), (100), (300), (500)) t(target)",
    "operator_report": f"SELECT (SELECT count(*) FROM {{collection_runs}}) AS runs, r.run_id AS refresh_run, epoch_us(r.finished_at) AS refreshed_at, q.run_id AS discovery_run, q.status AS discovery_status, p.problem_runs, p.unfinished_runs, p.exhausted_runs, n.run_id AS newest_run FROM (SELECT * FROM {{collection_runs}} WHERE kind = 'refresh' AND status = 'completed' AND NOT {_PARTIAL} ORDER BY started_at DESC, run_id DESC LIMIT 1) r, (SELECT * FROM {{collection_runs}} WHERE kind = 'discover' ORDER BY started_at DESC, run_id DESC LIMIT 1) q, (SELECT * FROM {{collection_runs}} ORDER BY started_at DESC, run_id DESC LIMIT 1) n, (SELECT count(*) FILTER {_PARTIAL} AS problem_runs, count(*) FILTER (finished_at IS NULL) AS unfinished_runs, count(*) FILTER (json_extract_string(report_json, '$.budget_exhausted') = 'true') AS exhausted_runs FROM {{collection_runs}}) p",
    "problem_runs": f"SELECT run_id, kind, status FROM {{collection_runs}} WHERE {_PARTIAL} ORDER BY started_at DESC, run_id DESC LIMIT 20",
    "scheduled_runs": "SELECT k.kind, CASE WHEN p.run_id IS NULL THEN 'run' ELSE 'skipped' END AS decision, p.run_id AS prior_run FROM (VALUES ('refresh', TIMESTAMP '2001-07-31'), ('discover', TIMESTAMP '2001-08-06'), ('other', TIMESTAMP '2001-07-30')) k(kind, since) LEFT JOIN LATERAL (SELECT run_id FROM {collection_runs} c WHERE c.kind = k.kind AND c.status <> 'running' AND c.started_at >= k.since ORDER BY started_at DESC, run_id DESC LIMIT 1) p ON true",
    "discovery_plan": f"SELECT category, recipe, query, sort, slots, pages FROM {_PLAN} x",
    "discovery_demand": f"SELECT scope, required, cap, required > cap AS exceeded FROM (SELECT sum(pages) AS p, sum(slots) AS n FROM {_PLAN} x) y, LATERAL (VALUES ('search', CAST(p AS BIGINT), 100), ('repository_details', CAST(n AS BIGINT), 1000), ('contributors', CAST(n AS BIGINT), 5000), ('profiles', CAST(n * 30 AS BIGINT), 10000), ('total', CAST(p + n + n + n * 30 AS BIGINT), 20000)) v(scope, required, cap)",
    "upsert_profiles": f"SELECT coalesce(s.user_id, n.user_id) AS developer_id, coalesce(n.score, s.score) AS score, coalesce(n.source, s.source) AS source FROM (SELECT user_id, CASE WHEN arg_max(value, event_id) >= 3 THEN arg_max(value, event_id) END AS score, 'view' AS source FROM {_STORED} x GROUP BY 1) s FULL JOIN (SELECT user_id, CASE WHEN arg_max(value, event_id) >= 3 THEN arg_max(value, event_id) END AS score, arg_max(event_type, event_id) AS source FROM {_UNSTORED} y GROUP BY 1) n ON n.user_id = s.user_id",
    "replace_topics": f"WITH new AS (SELECT DISTINCT user_id AS repository_id, 'new-' || event_type AS topic FROM {_UNSTORED} y WHERE value > 5) SELECT * FROM new UNION ALL SELECT DISTINCT user_id, 'old-' || (user_id % 5) FROM {{events}} WHERE user_id NOT IN (SELECT repository_id FROM new)",
    "note_provenance": "SELECT user_id AS repository_id, event_type AS category, sha256('topic:' || event_type) AS query_hash, epoch_us(min(ts)) AS first_seen_at, epoch_us(max(ts)) AS last_seen_at, arg_max(event_id, ts) AS last_run_id FROM {events} GROUP BY 1, 2",
    "due_profiles": "SELECT user_id, epoch_us(f) AS fetched_at, n AS fetched_limit FROM (SELECT user_id, max(ts) FILTER (event_type = 'signup') AS f, count(*) AS n FROM {events} GROUP BY 1) x WHERE f IS NULL OR f <= TIMESTAMP '2024-01-29' OR n < 60",
    "candidates_once": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, count(*) - 1 AS duplicates FROM {events} GROUP BY 1",
    "stage_candidates": f"SELECT c.user_id, c.event_type, k.user_id IS NULL AS is_new FROM (SELECT user_id * 2 AS user_id, arg_min(event_type, event_id) AS event_type FROM {_UNSTORED} y GROUP BY 1) c LEFT JOIN (SELECT DISTINCT user_id FROM {_STORED} x) k ON k.user_id = c.user_id",
    "refused_observations": f"SELECT n.user_id, count(*) FILTER (s.at IS NULL OR n.ts >= s.at) AS accepted, count(*) FILTER (n.ts < s.at) AS refused FROM {_UNSTORED} n LEFT JOIN (SELECT user_id, max(ts) AS at FROM {_STORED} x GROUP BY 1) s ON s.user_id = n.user_id GROUP BY 1",
    "repository_evidence": "SELECT s.repository_id, v.kind, v.payload FROM (SELECT s.*, x.delta, x.growth_pct, f.v AS forks FROM {labelled} s LEFT JOIN {deltas} x ON x.repository_id = s.repository_id AND x.field = 'stars' AND x.window_days = 7 LEFT JOIN {fields} f ON f.repository_id = s.repository_id AND f.captured_at = s.newest_at AND f.field = 'forks') s, LATERAL (VALUES ('counts', 'stars=' || stars || ' forks=' || forks), ('growth', CASE WHEN delta IS NULL THEN 'stars over 7 days: unknown' ELSE 'stars over 7 days: ' || printf('%+d', CAST(delta AS BIGINT)) || ' (' || coalesce(printf('%.1f%%', growth_pct), 'unknown') || ', ' || CASE WHEN complete THEN 'complete' ELSE 'partial' END || ' window)' END), ('momentum', 'momentum=' || coalesce(printf('%.2f', momentum), 'unknown')), ('trend', 'trend=' || coalesce(trend, 'unknown'))) v(kind, payload)",
    "prompts": f"SELECT entity, count(*) AS items, CAST(sum(length(p)) AS BIGINT) AS chars, sum(length(p)) >= 120 AS omitted, sha256(string_agg('[' || evidence_id || '] kind=' || kind || chr(10) || p, chr(10) || chr(10) ORDER BY evidence_id) || CASE WHEN sum(length(p)) >= 120 THEN chr(10) || chr(10) || '(remaining evidence omitted — hit the size cap)' ELSE '' END) AS text_sha256 FROM (SELECT *, substring(payload, 1, CAST(120 - before AS INT)) AS p FROM (SELECT *, coalesce(sum(length(payload)) OVER (PARTITION BY entity ORDER BY evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {_ITEMS} i) x WHERE before < 120) y GROUP BY 1",
    "safe_texts": "SELECT event_id, event_type AS topic, '<untrusted-data> kind=props' || chr(10) || 'key=[REDACTED] ' || props || chr(10) || '</untrusted-data>' AS wrapped, CASE WHEN event_type LIKE '%purchase%' THEN 'purchase' ELSE '' END AS secrets FROM {events}",
    "text_normalize": f"SELECT doc_id, {_cut('p', 120)} AS payload, md5({_cut('e', 10000)}) AS excerpt FROM (SELECT doc_id, {_stripped('clean')} AS p, {_stripped(f'regexp_replace(lines, {chr(39)}[\t\x0b\x0c\r \\x85\\p{{Z}}]+\\n{chr(39)}, chr(10), {chr(39)}g{chr(39)})')} AS e FROM (SELECT doc_id, clean, regexp_replace(clean, '\\r\\n?', chr(10), 'g') AS lines FROM (SELECT doc_id, regexp_replace({_RAW_TEXT}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS clean FROM {{documents}}) x) y) z",
    "bundle_fingerprints": f"SELECT entity, count(*) AS items, sha256('[' || string_agg({_object([('id', _string('evidence_id')), ('kind', _string('kind')), ('source', _string('source')), ('payload', _string('payload')), ('meta', 'meta')])}, ', ' ORDER BY evidence_id) || ']') AS fingerprint FROM {_EVIDENCE} e GROUP BY 1",
    "stored_bundles": f"SELECT entity, length(j) AS n, sha256(j) AS bundle_sha256 FROM (SELECT entity, {_object([('entity_key', _quoted('CAST(entity AS VARCHAR)')), ('entity_type', _quoted(chr(39) + 'developer' + chr(39))), ('fingerprint', _quoted('fingerprint')), ('generated_at', _quoted(_ISO.format('newest'))), ('items', 'items'), ('window_days', chr(39) + '7' + chr(39))])} AS j FROM (SELECT entity, '[' || string_agg({_object([('id', _plain('evidence_id')), ('kind', _plain('kind')), ('observed_at', _quoted(_ISO.format('observed_at'))), ('payload', _plain('payload')), ('source', _plain('source'))])}, ', ' ORDER BY place) || ']' AS items, sha256('[' || string_agg({_object([('id', _string('evidence_id')), ('kind', _string('kind')), ('source', _string('source')), ('payload', _string('payload')), ('meta', 'meta')])}, ', ' ORDER BY evidence_id) || ']') AS fingerprint, (SELECT max(ts) FROM {{events}}) AS newest FROM {_EVIDENCE} e GROUP BY 1) x) y",
    "developer_quality_windows": "SELECT d.days AS window_days, count(*) AS links, count(a.delta) AS usable, count(*) FILTER (coalesce(a.delta IS NOT NULL AND a.gap <= d.days * 0.5, false)) AS complete, count(DISTINCT l.developer_id) AS developers, count(DISTINCT l.developer_id) FILTER (a.delta IS NOT NULL) AS developers_usable, count(DISTINCT l.developer_id) FILTER (coalesce(a.delta IS NOT NULL AND a.gap <= d.days * 0.5, false)) AS developers_complete FROM {links} l CROSS JOIN (VALUES (1), (7), (30)) d(days) LEFT JOIN {anchored} a ON a.repository_id = l.repository_id AND a.developer_id = l.developer_id AND a.window_days = d.days GROUP BY 1",
    "quality_flags": "SELECT count(*) AS repositories, count(*) FILTER (r.is_archived) AS archived, count(*) FILTER (r.is_fork) AS forked, count(*) FILTER (epoch_us((SELECT max(captured_at) FROM {dense_snapshots})) - epoch_us(l.newest_at) >= 24 * 3600000000) AS stale, count(*) FILTER (l.newest_at IS NULL) AS never_observed FROM {dense_repositories} r LEFT JOIN {last} l ON l.repository_id = r.id",
}
_COMPONENTS = BASE["components"]
_HEAD, _TAIL = _COMPONENTS.rsplit(" SELECT node, component", 1)
QUERIES["ecosystem_report"] = (
    f"{_HEAD} SELECT n.*, e.*, (SELECT count(DISTINCT component) FROM m) AS components, (SELECT max(k) FROM (SELECT count(*) AS k FROM m GROUP BY component) z) AS largest FROM "
    "(SELECT (SELECT count(*) FROM {developers}) AS developer, (SELECT count(*) FROM {repositories}) AS repository, (SELECT count(DISTINCT topic) FROM {repository_topics}) AS topic) n, "
    "(SELECT count(*) FILTER (edge_type = 'OWNS') AS owns, count(*) FILTER (edge_type = 'CONTRIBUTES_TO') AS contributes_to, count(*) FILTER (edge_type = 'TAGGED_WITH') AS tagged_with FROM {graph_edges}) e"
)

ORACLE_SQL = {k: sql(v) for k, v in QUERIES.items()}
