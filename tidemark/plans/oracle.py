"""The registered queries as plain SQL over the same tables, for a second engine to check."""

from __future__ import annotations

# The sample adapters, restated: `f` are facts, `log` the payload log, `base` their common columns.
_BASE = r"""
e AS (SELECT event_id, date_trunc('millisecond', ts) AS ts, user_id, event_type, value AS spent,
             cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events),
base AS (SELECT *,
    'workspace-' || (user_id % 3) AS workspace_id,
    CASE WHEN user_id % 10 = 0 THEN '' ELSE 'user-' || user_id END AS actor_id,
    'anon-' || user_id AS anon_id,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE 's-' || user_id || '-' || strftime(ts, '%Y%m%d') END AS session_id,
    CASE event_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'ios' ELSE 'android' END AS source,
    CASE user_id % 5 WHEN 0 THEN 'IN' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' WHEN 3 THEN 'GB' END AS country,
    user_id % 2 = 0 AS authenticated,
    CASE user_id % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'ios' WHEN 2 THEN 'android' ELSE '' END AS platform,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'desktop' ELSE 'mobile' END AS device_type,
    CASE WHEN event_id % 17 = 0 THEN '' ELSE 'browser-' || (event_id % 12) END AS browser,
    CASE WHEN user_id % 6 = 0 THEN '' ELSE 'city-' || (user_id % 25) END AS city,
    CASE WHEN event_id % 4 = 0 THEN 'red shoes'
         ELSE 'red shoes ' || cast(floor(spent / 10) AS bigint) || repeat('x', cast(k % 7 AS int)) END AS query,
    k + 1 AS rank
    FROM e),
f AS (SELECT *, 'org-alpha' AS org_id, event_type AS event_name, ts AS event_timestamp,
    ts + to_minutes(cast(event_id % 7 AS int)) AS arrived_at, cast(event_id AS varchar) AS id FROM base)"""

_LOG = r""",
p AS (SELECT *,
    regexp_replace(md5(cast(event_id AS varchar)), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\1-\2-\3-\4-\5') AS uuid,
    CASE WHEN event_id % 997 = 1 THEN 'not_json' WHEN event_id % 991 = 2 THEN 'bad_org' WHEN event_id % 983 = 3 THEN 'no_org'
         WHEN event_id % 977 = 4 THEN 'no_time' WHEN event_id % 211 = 5 THEN 'line_break' ELSE '' END AS defect,
    '{"k":' || k || ',"platform":"' || platform || '"' || coalesce(',"device_type":"' || device_type || '"', '')
    || ',"browser":"' || browser || '","city":"' || city || '","rank":' || rank || ',"query":"' || query || '","amount":'
    || CASE k % 3 WHEN 0 THEN '12.5' WHEN 1 THEN '"12.5"' ELSE '{"currency":"EUR","cents":1250}' END
    || ',"cart":{"coupon":"C' || (k % 5) || '","items":[' || k || ',1]}}' AS properties
    FROM f),
once AS (SELECT *, CASE WHEN defect = 'not_json' THEN 'oops ' || event_id ELSE
    '{"envelop_version":"1.0"' || CASE WHEN defect = 'line_break' THEN ',' || chr(10) ELSE ',' END
    || '"id":"' || uuid || '","name":"' || event_type || '"'
    || CASE WHEN defect = 'no_time' THEN '' ELSE ',"occured_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"' END
    || CASE WHEN defect = 'no_time' OR event_id % 7 = 6 THEN ''
            ELSE ',"arrived_at":"' || strftime(arrived_at, '%Y-%m-%dT%H:%M:%S.%g') || '000000Z"' END
    || CASE defect WHEN 'no_org' THEN ',"org_id":""' WHEN 'bad_org' THEN ',"org_id":"Bad Org"' ELSE ',"org_id":"org-alpha"' END
    || ',"workspace_id":"' || workspace_id || '"'
    || CASE WHEN session_id = '' THEN '' ELSE ',"session_id":"' || session_id || '"' END
    || ',"anon_id":"' || anon_id || '"'
    || CASE WHEN actor_id = '' THEN '' ELSE ',"actor_id":"' || actor_id || '"' END
    || ',"source":"' || source || '","authenticated":' || CASE WHEN authenticated THEN 'true' ELSE 'false' END
    || ',"properties":' || properties
    || ',"system_properties":{"geo":{"country":"' || coalesce(country, 'unknown') || '"},"timezone":"Europe/Berlin"}}' END AS value,
    anon_id AS key, 'events' AS topic, cast(user_id % 6 AS bigint) AS partition, event_id * 2 AS "offset",
    CASE WHEN event_id % 7 = 6 THEN ts ELSE arrived_at END AS bucket_at FROM p),
log AS (SELECT * FROM once UNION ALL SELECT * REPLACE ("offset" + 1 AS "offset") FROM once WHERE event_id % 20 = 0),
routed AS (SELECT *, 'org-alpha' AS org, workspace_id AS workspace, strftime(bucket_at, '%Y-%m-%d') AS dt,
    hour(bucket_at) AS hour FROM log WHERE defect NOT IN ('not_json', 'no_org', 'no_time'))"""

_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S.%g')"
_RANGE = "event_timestamp >= TIMESTAMP '2024-01-01' AND event_timestamp <= TIMESTAMP '2024-02-01'"
_TREE = "event_timestamp >= TIMESTAMP '2024-01-01' AND event_timestamp < TIMESTAMP '2024-01-31'"
_NOW = "TIMESTAMP '2024-01-20 10:00:00'"


def _at(column: str) -> str:
    return _TIME.format(column)


def _facts(sql: str) -> str:
    return f"WITH {_BASE} {sql}"


def _log(sql: str) -> str:
    return f"WITH {_BASE}{_LOG} {sql}"


def _count_by(expr: str, name: str, where: str = "true", count: str = "event_count", tail: str = "") -> str:
    return _facts(f"SELECT {expr} AS {name}, count(*) AS {count} FROM f WHERE {_RANGE} AND {where} GROUP BY 1 {tail}")


def _top(n: int, name: str, count: str = "event_count") -> str:
    return f"ORDER BY {count} DESC, {name} LIMIT {n}"


def _by_name(where: str) -> str:
    return _facts(f"SELECT event_name, count(*) AS event_count FROM f WHERE {where} GROUP BY 1")


_SQL: dict[str, str] = {}

# -- metric library --------------------------------------------------------

_SQL |= {
    "daily_event_volume": _count_by("strftime(event_timestamp, '%Y-%m-%d')", "date"),
    "daily_event_volume_local": _count_by("strftime(event_timestamp + INTERVAL 330 MINUTE, '%Y-%m-%d')", "date"),
    "event_distribution": _count_by("event_name", "event_name", count="count", tail=_top(20, "event_name", "count")),
    "events_by_platform": _count_by("platform", "platform", "platform <> ''"),
    "events_by_device": _count_by("device_type", "device_type", "device_type <> ''"),
    "events_by_browser": _count_by("browser", "browser", "browser <> ''", tail=_top(10, "browser")),
    "events_by_country": _count_by("country", "country", "country <> ''", tail=_top(20, "country")),
    "hourly_distribution": _count_by("hour(event_timestamp)", "hour"),
    "weekly_trend": _count_by(
        "strftime(date_trunc('day', event_timestamp) - to_days(cast(dayofweek(event_timestamp) AS int)), '%Y-%m-%d')", "week"
    ),
    "monthly_trend": _count_by("strftime(event_timestamp, '%Y-%m')", "month"),
    "month_start_counts": _count_by("strftime(date_trunc('month', event_timestamp), '%Y-%m-%d')", "month_start"),
    "specific_event_count": _facts(f"SELECT count(*) AS event_count FROM f WHERE event_name = 'purchase' AND {_RANGE}"),
    "unique_users": _facts(f"SELECT count(DISTINCT actor_id) AS unique_users FROM f WHERE {_RANGE} AND actor_id <> ''"),
    "daily_active_users": _facts(
        f"SELECT strftime(event_timestamp, '%Y-%m-%d') AS date, count(DISTINCT actor_id) AS unique_users "
        f"FROM f WHERE {_RANGE} AND actor_id <> '' GROUP BY 1"
    ),
    "top_cities": _count_by("city", "city", "city <> ''", tail=_top(20, "city")),
    "available_events": _facts("SELECT DISTINCT event_name FROM f ORDER BY 1 LIMIT 100"),
    "property_distribution": _count_by(
        "cast(rank AS varchar)", "property_value", "event_name = 'click'", "count", _top(30, "property_value", "count")
    ),
    "mean_reciprocal_rank": _facts(f"SELECT round(avg(1.0::double / rank), 9) AS mrr FROM f WHERE event_name = 'click' AND {_RANGE}"),
    "reciprocal_position": _facts(
        "SELECT CASE WHEN 1.0::double / rank >= 0.5 THEN 'top_2' WHEN 1.0::double / rank >= 0.2 THEN 'top_5' "
        "WHEN 1.0::double / rank >= 0.1 THEN 'top_10' ELSE 'beyond_10' END AS position_bucket, count(*) AS event_count "
        "FROM f WHERE event_name = 'click' GROUP BY 1"
    ),
    "boolean_crosstab": _facts(
        "SELECT authenticated AS dim_a, source = 'web' AS dim_b, count(*) AS cnt FROM f WHERE country IS NOT NULL GROUP BY 1, 2"
    ),
    "event_names": _facts("SELECT DISTINCT event_name FROM f"),
    "events_today": _facts(
        f"SELECT count(*) AS events_today FROM f WHERE cast(event_timestamp + INTERVAL 330 MINUTE AS date) = "
        f"cast({_NOW} + INTERVAL 330 MINUTE AS date)"
    ),
    "value_share": _facts(
        f"SELECT event_name, count(*) AS count, round(count(*) * 100.0::double / (SELECT count(*) FROM f), 1) AS share "
        f"FROM f WHERE {_RANGE} GROUP BY 1 {_top(20, 'event_name', 'count')}"
    ),
    "metric_registry": _facts(
        f"""SELECT id, rows FROM (
        SELECT 'gq-001' AS id, count(DISTINCT cast(ts AS date)) AS rows FROM f WHERE {_RANGE}
        UNION ALL SELECT 'gq-002', least(20, count(DISTINCT event_name)) FROM f WHERE {_RANGE}
        UNION ALL SELECT 'gq-003', count(DISTINCT platform) FROM f WHERE platform <> ''
        UNION ALL SELECT 'gq-004', count(DISTINCT device_type) FROM f WHERE device_type <> ''
        UNION ALL SELECT 'gq-005', least(10, count(DISTINCT browser)) FROM f WHERE browser <> ''
        UNION ALL SELECT 'gq-006', least(20, count(DISTINCT country)) FROM f WHERE country <> ''
        UNION ALL SELECT 'gq-007', count(DISTINCT hour(ts)) FROM f
        UNION ALL SELECT 'gq-008', count(DISTINCT date_trunc('day', ts) - to_days(cast(dayofweek(ts) AS int))) FROM f
        UNION ALL SELECT 'gq-009', count(DISTINCT strftime(ts, '%Y-%m')) FROM f
        UNION ALL SELECT 'gq-011', 1
        UNION ALL SELECT 'gq-012', count(DISTINCT cast(ts AS date)) FROM f WHERE actor_id <> ''
        UNION ALL SELECT 'gq-014', least(20, count(DISTINCT city)) FROM f WHERE city <> '')"""
    ),
}

# -- behaviour -------------------------------------------------------------


def _funnel(rows: str, names: list[str], window_s: int, tail: str) -> str:
    """One row per step hit; each step takes over the latest chain start of the step before it."""
    steps = " UNION ALL ".join(
        f"SELECT actor_id, epoch(date_trunc('second', event_timestamp))::bigint AS t, {n} AS step FROM {rows} WHERE event_name = '{name}'"
        for n, name in enumerate(names)
    )
    ctes = [f"hits AS ({steps})", "s0 AS (SELECT *, CASE WHEN step = 0 THEN t END AS c0 FROM hits)"]
    for n in range(1, len(names)):
        last = (
            f"last_value(c{n - 1} IGNORE NULLS) OVER (PARTITION BY actor_id ORDER BY t, step "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        )
        ctes.append(
            f"l{n} AS (SELECT *, {last} AS prev FROM s{n - 1}), "
            f"s{n} AS (SELECT * EXCLUDE (prev), CASE WHEN step = {n} AND t <= prev + {window_s} THEN prev END AS c{n} FROM l{n})"
        )
    best = ", ".join(f"CASE WHEN c{n} IS NOT NULL THEN {n + 1} ELSE 0 END" for n in range(len(names)))
    ctes.append(
        f"levels AS (SELECT actor_id, cast(max(greatest({best})) AS bigint) AS level FROM s{len(names) - 1} "
        f"GROUP BY 1 HAVING max(greatest({best})) > 0)"
    )
    return ", " + ", ".join(ctes) + " " + tail


def _cumulative(names: list[str]) -> str:
    cases = " ".join(f"WHEN {n + 1} THEN '{name}'" for n, name in enumerate(names))
    return (
        f"SELECT level, CASE level {cases} END AS event, cast(sum(n) OVER (ORDER BY level DESC) AS bigint) AS count "
        "FROM (SELECT level, count(*) AS n FROM levels GROUP BY 1)"
    )


_SHIPMENTS = """WITH shipments AS (SELECT 's-' || l_suppkey AS actor_id, l_returnflag AS event_name,
    l_shipdate AS event_timestamp FROM lineitem)"""
_GAP = """SELECT CASE WHEN gap < 10 THEN '<10s' WHEN gap < 30 THEN '10-30s' WHEN gap < 60 THEN '30-60s'
    WHEN gap < 300 THEN '1-5min' ELSE '5min+' END AS gap_bucket, count(*) AS pair_count FROM (
    SELECT (epoch_ms(lead(event_timestamp) OVER (PARTITION BY actor_id ORDER BY event_timestamp)) - epoch_ms(event_timestamp))
        / 1000.0 AS gap FROM {} WHERE event_name = '{}') WHERE gap IS NOT NULL GROUP BY 1"""
_FLOW = """flow AS (SELECT event_name AS source, target, count(*) AS value FROM (
    SELECT event_name, lead(event_name) OVER (PARTITION BY session_id ORDER BY event_timestamp, event_name) AS target
    FROM f WHERE session_id <> '') WHERE target IS NOT NULL GROUP BY 1, 2)"""
_DURATION = """CASE WHEN {0} < 1000 THEN {0} || 'ms' WHEN {0} < 60000 THEN printf('%.1fs', {0} / 1000.0::double)
    WHEN {0} < 3600000 THEN printf('%dm %02ds', {0} // 60000, {0} // 1000 % 60)
    WHEN {0} < 86400000 THEN printf('%dh %02dm', {0} // 3600000, {0} // 60000 % 60)
    ELSE printf('%dd %dh', {0} // 86400000, {0} // 3600000 % 24) END"""
_AMOUNT = """CASE k % 3 WHEN 0 THEN 'amount=12.5' WHEN 1 THEN 'amount=12.5' ELSE 'amount.cents=1250' END"""

_SQL |= {
    "window_funnel": _facts(_funnel("f", ["view", "click", "purchase"], 21600, "SELECT actor_id, level FROM levels")),
    "funnel_cumulative": _facts(
        _funnel("f", ["view", "click", "purchase"], 21600, _cumulative(["view", "click", "purchase"]))
    ),
    "funnel_lineitem": _SHIPMENTS + _funnel("shipments", ["N", "A", "R"], 30 * 86400, _cumulative(["N", "A", "R"])),
    "consecutive_gap": _facts(_GAP.format("f", "view")),
    "gap_lineitem": _SHIPMENTS + _GAP.format("shipments", "R"),
    "consecutive_similarity": _facts(
        """SELECT CASE WHEN d = 0 THEN 'identical' WHEN d <= 2 THEN 'minor_change' WHEN d <= 5 THEN 'moderate_change'
        ELSE 'major_change' END AS similarity_bucket, count(*) AS pair_count FROM (
        SELECT levenshtein(query, lead(query) OVER (PARTITION BY actor_id ORDER BY event_timestamp, query)) AS d
        FROM f WHERE event_name = 'view') WHERE d IS NOT NULL GROUP BY 1"""
    ),
    "session_timeline": _facts(
        f""", timed AS (SELECT *, epoch_ms(ts) - epoch_ms(min(ts) OVER (PARTITION BY session_id)) AS offset_ms,
            epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, id)) AS gap_ms FROM f WHERE session_id <> '')
        SELECT session_id, id AS event_id, {_at('ts')} AS event_timestamp, event_name, offset_ms, gap_ms,
            coalesce(gap_ms >= 30000, false) AS idle, '+' || {_DURATION.format('offset_ms')} AS offset_text,
            CASE k % 3 WHEN 2 THEN 'amount.cents=1250, amount.currency=EUR, browser=' || browser || ', cart.coupon=C' || (k % 5)
            ELSE 'amount=12.5, browser=' || browser || ', cart.coupon=C' || (k % 5) || ', cart.items=[' || k || ',1]' END AS properties_shown
        FROM timed"""
    ),
    "session_strip_position": _facts(
        """SELECT session_id, id AS event_id, event_name, round((epoch_ms(ts) - epoch_ms(min(ts) OVER w))::double
        / greatest(1, epoch_ms(max(ts) OVER w) - epoch_ms(min(ts) OVER w)), 6) AS position
        FROM f WHERE session_id <> '' WINDOW w AS (PARTITION BY session_id)"""
    ),
    "flow_edges": _facts(f", {_FLOW} SELECT source, target, value FROM flow"),
    "flow_break_cycles": "WITH RECURSIVE "
    + _BASE
    + f""", {_FLOW}, ranked AS (SELECT *, row_number() OVER (ORDER BY value, source, target) AS r FROM flow),
        walk AS (SELECT e.r AS edge, e.target AS node FROM ranked e
            UNION SELECT w.edge, n.target FROM walk w JOIN ranked n ON n.source = w.node AND n.r > w.edge)
        SELECT source, target, value, EXISTS (SELECT 1 FROM walk w WHERE w.edge = r.r AND w.node = r.source) AS removed
        FROM ranked r""",
}
_SQL["flow_acyclic"] = f"""WITH flagged AS ({_SQL["flow_break_cycles"]}), left_over AS (SELECT * FROM flagged WHERE NOT removed)
    SELECT source, target, value, removed_edges FROM (SELECT count(*) FILTER (removed) AS removed_edges FROM flagged) LEFT JOIN left_over ON true"""

# -- predicates ------------------------------------------------------------

_SQL |= {
    "p_match_all": _by_name("true"),
    "p_term": _by_name("platform = 'ios'"),
    "p_terms": _by_name("country IN ('IN', 'DE')"),
    "p_term_list_item": _by_name("k = 7"),
    "p_match": _by_name("event_name = 'view'"),
    "p_match_phrase": _by_name("authenticated"),
    "p_range": _by_name(
        "event_timestamp >= TIMESTAMP '2024-01-05' - INTERVAL 330 MINUTE AND event_timestamp < TIMESTAMP '2024-01-09' - INTERVAL 330 MINUTE"
    ),
    "p_range_relative": _by_name(f"event_timestamp >= TIMESTAMP '2024-01-13' AND event_timestamp <= {_NOW}"),
    "p_range_text": _by_name("cast(rank AS varchar) >= '2' AND cast(rank AS varchar) < '30'"),
    "p_exists": _by_name("device_type IS NOT NULL"),
    "p_prefix": _by_name("session_id LIKE 's-1%'"),
    "p_wildcard": _by_name("query LIKE '%shoes _xx%'"),
    "p_ids": _by_name("id IN ('1', '77', '400')"),
    "p_bool": _by_name(
        "source = 'web' AND (event_name = 'view' OR session_id <> '') AND coalesce(device_type, '') <> 'mobile'"
    ),
    "p_text_and_or_not": _by_name("event_name = 'purchase' AND actor_id = ''"),
    "p_pills": _by_name(
        "event_name IN ('view', 'click', 'signup') AND source <> 'ios' AND actor_id <> '' "
        "AND event_timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28'"
    ),
    "p_pill_replace": _by_name("event_name <> 'view'"),
    "p_time_halfopen": _by_name("event_timestamp >= TIMESTAMP '2024-01-05' AND event_timestamp < TIMESTAMP '2024-01-09'"),
    "p_time_closed": _by_name("event_timestamp >= TIMESTAMP '2024-01-05' AND event_timestamp <= TIMESTAMP '2024-01-09 23:59:59.999'"),
    "p_time_relative": _by_name(f"event_timestamp >= {_NOW} - INTERVAL 7 DAY AND event_timestamp < {_NOW}"),
    "p_like": _by_name("event_name LIKE '%i%'"),
    "p_scope": _facts("SELECT workspace_id, event_name, count(*) AS event_count FROM f GROUP BY 1, 2"),
    "p_workspace_ingest": _by_name("workspace_id = 'workspace-1'"),
}

# -- exploring -------------------------------------------------------------


def _histogram(start: str, end: str) -> str:
    return _facts(
        f""", spine AS (SELECT unnest(generate_series(epoch({start})::bigint // 43200, (epoch({end})::bigint - 1) // 43200)) AS b),
        seen AS (SELECT epoch(ts)::bigint // 43200 AS b, count(*) AS n FROM f WHERE ts >= {start} AND ts < {end} GROUP BY 1)
        SELECT {_at('make_timestamp(b * 43200000000)')} AS time, coalesce(n, 0) AS count FROM spine LEFT JOIN seen USING (b)"""
    )


def _facet(expr: str, size: int, where: str = "true") -> str:
    return _facts(
        f""", hits AS (SELECT nullif({expr}, '') AS value FROM f WHERE {_TREE} AND {where}),
        top AS (SELECT value, count(*) AS count FROM hits WHERE value IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {size})
        SELECT value, count, (SELECT count(*) FROM hits) AS total,
            cast((SELECT count(value) FROM hits) - (SELECT sum(count) FROM top) AS bigint) AS other FROM top"""
    )


_SESSIONS = f"""sessions AS (SELECT session_id, min(ts) AS low, max(ts) AS high, count(*) AS event_count
    FROM f WHERE session_id <> '' AND {_TREE} GROUP BY 1)"""
_SESSION_COLUMNS = f"session_id, {_at('low')} AS first_event_at, {_at('high')} AS last_event_at, event_count"
_PAGE = f"id AS event_id, {_at('ts')} AS event_timestamp, event_name, workspace_id"

_SQL |= {
    "count_matching": _facts(
        "SELECT count(*) AS count FROM f WHERE source = 'web' AND (event_name = 'view' OR session_id <> '') "
        "AND coalesce(device_type, '') <> 'mobile'"
    ),
    "histogram": _histogram("TIMESTAMP '2024-01-01 07:30:00'", "TIMESTAMP '2024-01-31'"),
    "histogram_selection": _facts(
        f"""SELECT {_at("TIMESTAMP '2024-01-03 12:00:00'")} AS "from", {_at("TIMESTAMP '2024-01-11 12:00:00'")} AS "to", count(*) AS count
        FROM f WHERE ts >= TIMESTAMP '2024-01-03 12:00:00' AND ts < TIMESTAMP '2024-01-11 12:00:00'"""
    ),
    "facets": _facet("session_id", 20),
    "facet_prefix": _facet("actor_id", 5, "actor_id LIKE 'user-1%'"),
    "facet_value_text": _facet("cast(authenticated AS varchar)", 5),
    "sessions_list": _facts(f", {_SESSIONS} SELECT {_SESSION_COLUMNS} FROM sessions"),
    "session_duration": _facts(
        f""", {_SESSIONS}, d AS (SELECT *, epoch_ms(high) - epoch_ms(low) AS duration_ms FROM sessions)
        SELECT {_SESSION_COLUMNS}, duration_ms, {_DURATION.format('duration_ms')} AS duration_text FROM d"""
    ),
    "session_facts": _facts(
        "SELECT session_id, epoch_ms(max(ts)) - epoch_ms(min(ts)) AS duration_ms, count(*) AS event_count FROM f WHERE session_id <> '' GROUP BY 1"
    ),
    "session_values": _facts(
        " UNION ".join(
            f"SELECT session_id, '{c}' AS field, {c} AS value FROM f WHERE session_id <> '' AND {c} <> ''"
            for c in ("anon_id", "actor_id", "source", "country")
        )
    ),
    "session_event_names": _facts("SELECT session_id, event_name, count(*) AS count FROM f WHERE session_id <> '' GROUP BY 1, 2"),
    "events_page": _facts(f"SELECT {_PAGE} FROM f WHERE {_TREE} ORDER BY ts DESC, id LIMIT 101"),
    "events_page_after": _facts(
        f"""SELECT {_PAGE} FROM f WHERE ts > TIMESTAMP '2024-01-15 10:00:00' OR (ts = TIMESTAMP '2024-01-15 10:00:00' AND id > '5000')
        ORDER BY ts, id LIMIT 51"""
    ),
    "session_events_page": _facts(f"SELECT {_PAGE} FROM f WHERE session_id = 's-7-20240103' ORDER BY ts, id LIMIT 51"),
    "sessions_page": _facts(f", {_SESSIONS} SELECT {_SESSION_COLUMNS} FROM sessions WHERE session_id > 's-12-20240115' ORDER BY session_id LIMIT 101"),
    "get_event": _facts(f"SELECT {_PAGE} FROM f WHERE id = '0'"),
    "event_public": _facts(
        f"""SELECT workspace_id, id AS event_id, event_name, {_at('ts')} AS event_timestamp, {_at('arrived_at')} AS arrived_at,
        session_id, anon_id, actor_id, source, '' AS correlation_id, '' AS trace_id, authenticated, country,
        'Europe/Berlin' AS timezone, cast(NULL AS varchar) AS ip_address, {_at('ts')} AS inserted_at, {_at('ts')} AS updated_at,
        cast(0 AS bigint) AS is_deleted FROM f"""
    ),
    "top_values_sample": _facts(
        """, page AS (SELECT device_type FROM f ORDER BY ts DESC, id LIMIT 100)
        SELECT 'string' AS kind, device_type AS label, count(*) AS count, (SELECT count(device_type) FROM page) AS with_field,
        (SELECT count(*) FROM page) AS sampled FROM page WHERE device_type IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5"""
    ),
}

# -- catalog ---------------------------------------------------------------

_CATALOG = """leaves AS (SELECT org_id, workspace_id, event_name, k, device_type, unnest([
        ['k', 'Int64'], ['platform', 'String'], ['browser', 'String'], ['city', 'String'], ['rank', 'Int64'], ['query', 'String'],
        ['cart.coupon', 'String'], ['cart.items', 'Array(Nullable(Int64))'],
        CASE WHEN device_type IS NULL THEN NULL ELSE ['device_type', 'String'] END,
        CASE k % 3 WHEN 0 THEN ['amount', 'Float64'] WHEN 1 THEN ['amount', 'String'] ELSE ['amount.currency', 'String'] END,
        CASE k % 3 WHEN 2 THEN ['amount.cents', 'Int64'] END]) AS leaf FROM f),
    catalog AS (SELECT DISTINCT org_id, workspace_id, event_name, leaf[1] AS property, leaf[2] AS type FROM leaves WHERE leaf IS NOT NULL),
    listed AS (SELECT event_name, property, min(type) AS type FROM catalog GROUP BY 1, 2),
    names AS (SELECT DISTINCT event_name FROM f),
    event_docs AS (SELECT event_name, CASE WHEN event_name = 'view' THEN '' ELSE 'about ' || event_name END AS description
        FROM names WHERE event_name IN ('click', 'purchase', 'view')),
    property_docs AS (SELECT event_name, property, CASE WHEN property = 'city' THEN '' ELSE property || ' of ' || event_name END AS description
        FROM (SELECT event_name, unnest(['rank', 'cart.coupon', 'city']) AS property FROM event_docs))"""

_SQL |= {
    "schema_catalog": _facts(f", {_CATALOG} SELECT org_id, workspace_id, event_name, property, type FROM catalog"),
    "schema_catalog_list": _facts(f", {_CATALOG} SELECT event_name, property, type FROM listed"),
    "event_property_keys": _facts(f", {_CATALOG} SELECT DISTINCT property FROM catalog WHERE event_name = 'click'"),
    "unnest": _facts(f", {_CATALOG} SELECT DISTINCT property AS path, type FROM catalog"),
    "field_catalog": _facts(
        f""", {_CATALOG}, known AS (SELECT unnest([
            ['0', 'name', 'string'], ['1', 'occured_at', 'date'], ['2', 'session_id', 'string'], ['3', 'anon_id', 'string'],
            ['4', 'actor_id', 'string'], ['5', 'source', 'string'], ['6', 'authenticated', 'boolean'], ['7', 'id', 'string'],
            ['8', 'arrived_at', 'date'], ['9', 'correlation_id', 'string'], ['10', 'trace_id', 'string'],
            ['11', 'envelop_version', 'string'], ['12', 'workspace_id', 'string'], ['13', 'system_properties.geo.country', 'string'],
            ['14', 'system_properties.timezone', 'string'], ['15', 'system_properties.ip_address', 'ip']]) AS r),
        seen AS (SELECT property, CASE WHEN property <> 'amount' THEN
                CASE min(type) WHEN 'String' THEN 'string' WHEN 'Int64' THEN 'number' ELSE 'object' END
                ELSE (SELECT arg_min(CASE k % 3 WHEN 0 THEN 'number' ELSE 'string' END, ts) FROM f WHERE k % 3 < 2) END AS type
            FROM catalog GROUP BY 1)
        SELECT cast(r[1] AS bigint) AS position, r[2] AS name, r[3] AS type FROM known
        UNION ALL SELECT 16, 'properties.' || property, type FROM seen"""
    ),
    "join_schema_docs": _facts(
        f""", {_CATALOG} SELECT l.event_name, l.property, l.type, coalesce(e.description, '') AS event_description,
        coalesce(p.description, '') AS property_description FROM listed l LEFT JOIN event_docs e USING (event_name)
        LEFT JOIN property_docs p ON p.event_name = l.event_name AND p.property = l.property"""
    ),
    "join_undocumented": _facts(
        f", {_CATALOG} SELECT event_name, property FROM listed EXCEPT SELECT event_name, property FROM property_docs"
    ),
    "documentation_coverage": _facts(
        f""", {_CATALOG}, ev AS (SELECT description FROM names LEFT JOIN event_docs USING (event_name)),
        pr AS (SELECT description FROM listed l LEFT JOIN property_docs p ON p.event_name = l.event_name AND p.property = l.property)
        SELECT (SELECT count(*) FROM ev) AS events, (SELECT count(*) FROM ev WHERE coalesce(description, '') = '') AS events_missing,
        (SELECT count(*) FROM ev WHERE description IS NULL) AS events_undocumented, (SELECT count(*) FROM pr) AS properties,
        (SELECT count(*) FROM pr WHERE coalesce(description, '') = '') AS properties_missing,
        (SELECT count(*) FROM pr WHERE description IS NULL) AS properties_undocumented"""
    ),
    "schema_search": _facts(f", {_CATALOG} SELECT event_name FROM names WHERE lower(event_name) LIKE '%ick%'"),
    "sink_descriptions": _facts(
        f""", {_CATALOG}, updates AS (SELECT event_name FROM names WHERE event_name >= 'p')
        SELECT coalesce(u.event_name, b.event_name) AS event_name,
            CASE WHEN u.event_name IS NULL THEN b.description ELSE 'new text' END AS description,
            CASE WHEN b.event_name IS NULL THEN '2024-02-02 00:00:00.000' ELSE '2023-12-31 00:00:00.000' END AS created_at,
            CASE WHEN u.event_name IS NULL THEN '2024-01-01 00:00:00.000' ELSE '2024-02-02 00:00:00.000' END AS updated_at
        FROM event_docs b FULL JOIN updates u ON u.event_name = b.event_name"""
    ),
}

# -- ingest ----------------------------------------------------------------

_REQUESTS = """requests AS (SELECT *, anon_id || '/' || strftime(ts, '%Y%m%d%H') AS request_id,
    NOT (workspace_id = 'workspace-1' AND event_name <> 'error' OR workspace_id = 'workspace-0' AND event_name NOT IN ('view', 'click')) AS allowed
    FROM f)"""
_ENRICHED = """enriched AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE arrived_at END AS sent_at,
    CASE WHEN event_id % 5 = 0 THEN '9.9.9.9' END AS own_ip, user_id % 30 AS a, user_id % 7 AS b, user_id % 250 AS d,
    (user_id % 30) || '.' || (user_id % 7) || '.0.' || (user_id % 250) AS request_ip FROM f)"""
_PUBLIC = "(a <> 10 AND NOT (a = 0 AND b = 0 AND d = 0))"
_TENANTS = """tenants AS (SELECT CASE WHEN event_id % 991 = 2 THEN 'Bad Org' WHEN event_id % 983 = 3 THEN '' ELSE 'org-alpha' END AS org_id,
    workspace_id FROM base),
    settled AS (SELECT *, CASE WHEN org_id = 'org-alpha' AND workspace_id = 'workspace-2' THEN 'events-{org_id}-eu'
        WHEN org_id = 'org-alpha' THEN 'events-dedicated'
        WHEN org_id = 'Bad Org' AND workspace_id = 'workspace-1' THEN 'Not A Valid Index' ELSE 'events-{org_id}' END AS template FROM tenants)"""
_DESTINATION = "CASE WHEN defect NOT IN ('not_json', 'no_time', 'no_org', 'bad_org') THEN 'events-org-alpha-' || workspace_id END"
_ERROR = """CASE WHEN defect IN ('not_json', 'no_time') THEN 'decode' WHEN defect IN ('no_org', 'bad_org') THEN 'invalid_org' END"""
_SLUG = "'[a-z][a-z0-9-]{4,28}[a-z0-9]'"

_SQL |= {
    "scope_check": _facts(
        f""", {_REQUESTS}, bad AS (SELECT request_id, min(event_id) AS rejected_at FROM requests WHERE event_id % 301 = 7 GROUP BY 1)
        SELECT request_id, event_id AS pos, rejected_at FROM requests LEFT JOIN bad USING (request_id)"""
    ),
    "allow_list": _facts(f", {_REQUESTS} SELECT workspace_id, event_name, allowed, count(*) AS event_count FROM requests GROUP BY 1, 2, 3"),
    "collection_status": _facts(
        f", {_REQUESTS} SELECT request_id, count(*) FILTER (NOT allowed) AS filtered, count(*) FILTER (allowed) AS collected, count(*) AS total FROM requests GROUP BY 1"
    ),
    "mark_authenticated": _facts("SELECT source, source = 'web' AS authenticated, count(*) AS event_count FROM f GROUP BY 1, 2"),
    "enrich_arrived_at": _facts(
        f", {_ENRICHED} SELECT id AS event_id, {_at('''coalesce(sent_at, TIMESTAMP '2024-03-01 12:00:00')''')} AS arrived_at FROM enriched"
    ),
    "enrich_ip": _facts(f", {_ENRICHED} SELECT id AS event_id, coalesce(own_ip, request_ip) AS ip_address FROM enriched"),
    "public_ip": _facts(f", {_ENRICHED} SELECT id AS event_id, {_PUBLIC} AS is_public FROM enriched"),
    "client_ip": _facts(
        f""", {_ENRICHED} SELECT id AS event_id, CASE event_id % 4 WHEN 0 THEN request_ip WHEN 1 THEN '5.5.5.5'
        ELSE CASE WHEN event_id % 3 = 0 THEN '7.7.7.7' ELSE '5.5.5.5' END END AS client_ip FROM enriched"""
    ),
    "enrich_country": _facts(
        f""", {_ENRICHED} SELECT id AS event_id, coalesce(country, CASE WHEN event_id % 2 = 1 OR {_PUBLIC} THEN 'N' || (n.n_nationkey % 10) END) AS country
        FROM enriched LEFT JOIN nation n ON n.n_nationkey = a"""
    ),
    "dedup_events": _facts(
        f"""SELECT id AS event_id, {_at('CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END')} AS updated_at,
        cast(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS bigint) AS is_deleted FROM f"""
    ),
    "soft_delete": _facts("SELECT id AS event_id, event_name FROM f WHERE event_id % 3 <> 0"),
    "slug_check": _facts(
        f"SELECT id AS event_id, regexp_full_match(anon_id, {_SLUG}) AS anon_ok, regexp_full_match(session_id, {_SLUG}) AS session_ok FROM f"
    ),
    "validate_event": _log(
        """SELECT partition, "offset", CASE WHEN defect IN ('not_json', 'no_time') THEN 'decode' END AS error_class,
        CASE defect WHEN 'not_json' THEN 'not a canonical event: object' WHEN 'no_time' THEN 'not a canonical event: occured_at' END AS error_reason
        FROM log"""
    ),
    "conform_events": _log(
        f"""SELECT workspace_id, CASE defect WHEN 'no_org' THEN '' WHEN 'bad_org' THEN 'Bad Org' ELSE org_id END AS org_id,
        uuid AS event_id, event_name, {_at('ts')} AS event_timestamp,
        CASE WHEN event_id % 7 <> 6 THEN {_at('arrived_at')} END AS arrived_at, session_id, anon_id, actor_id, source,
        '' AS correlation_id, '' AS trace_id, authenticated, country, 'Europe/Berlin' AS timezone, cast(NULL AS varchar) AS ip_address,
        '2024-03-01 00:00:00.000' AS inserted_at, '2024-03-01 00:00:00.000' AS updated_at, cast(0 AS bigint) AS is_deleted, platform
        FROM once WHERE defect NOT IN ('not_json', 'no_time')"""
    ),
    "hour_bucket": _log(
        """SELECT reason, CASE WHEN reason IS NULL THEN CASE WHEN defect = 'bad_org' THEN 'Bad Org' ELSE 'org-alpha' END END AS org,
        CASE WHEN reason IS NULL THEN workspace_id END AS workspace,
        CASE WHEN reason IS NULL THEN strftime(bucket_at, '%Y-%m-%d') END AS dt, CASE WHEN reason IS NULL THEN hour(bucket_at) END AS hour,
        count(*) AS payloads FROM (SELECT *, CASE defect WHEN 'not_json' THEN 'InvalidJson' WHEN 'no_org' THEN 'MissingOrgId'
            WHEN 'no_time' THEN 'MissingTimestamp' END AS reason FROM log) GROUP BY ALL"""
    ),
    "resolve_override": _facts(f", {_TENANTS} SELECT org_id, workspace_id, template, count(*) AS events FROM settled GROUP BY ALL"),
    "destination_check": _facts(
        f""", {_TENANTS}, judged AS (SELECT *, CASE WHEN template = 'Not A Valid Index' THEN 'invalid_index'
            WHEN template LIKE '%{{org_id}}%' AND org_id IN ('', 'Bad Org') THEN 'invalid_org' END AS error_class FROM settled)
        SELECT org_id, workspace_id, CASE WHEN error_class IS NULL THEN replace(template, '{{org_id}}', org_id) END AS destination,
        error_class, count(*) AS events FROM judged GROUP BY ALL"""
    ),
    "topic_check": _facts(
        f""", {_TENANTS} SELECT 'in.' || org_id || '.' || workspace_id AS topic_name, org_id <> 'Bad Org' AS topic_ok, count(*) AS events
        FROM tenants GROUP BY ALL"""
    ),
    "size_reject": _log(
        f""", judged AS (SELECT *, {_ERROR} AS early, strlen({_DESTINATION}) + 36 + 33 + 2
            + strlen(value) - CASE WHEN defect = 'line_break' THEN 1 ELSE 0 END AS size FROM once)
        SELECT coalesce(early, CASE WHEN size > 740 THEN 'too_large' END) AS error_class, count(*) AS records FROM judged GROUP BY 1"""
    ),
    "compact_json": _log(
        """SELECT "offset", false AS has_break, CASE WHEN defect <> 'not_json' THEN uuid END AS id FROM once"""
    ),
    "default_properties": _facts(
        "SELECT id AS event_id, platform, 'dark' AS theme, coalesce(device_type, 'unknown') AS device_type FROM f"
    ),
    "nested_property_audit": _facts("SELECT id AS event_id, true AS nested FROM f"),
    "storefront_conform": """WITH lines AS (SELECT l_orderkey, count(*) AS n, arg_min(l_partkey, l_linenumber || '{"quantity":' || cast(l_quantity AS bigint) || ',"variant":{"sku":"sku-' || l_partkey || '"')
        AS first_part FROM lineitem GROUP BY 1)
        SELECT CASE o_orderkey % 4 WHEN 0 THEN 'order_completed' WHEN 1 THEN 'checkout_started' ELSE 'add_to_cart' END AS event_name,
        'c-' || o_custkey AS cookie, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE o_custkey || '@example.com' END AS email,
        '555-' || o_custkey AS phone, 'cu-' || o_custkey AS customer, cast(o_orderkey AS varchar) AS order_id,
        round(o_totalprice, 2) AS amount, coalesce(n, 0) AS items, 'sku-' || first_part AS first_sku
        FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey WHERE o_orderkey % 4 < 3""",
}

# -- sources and sinks -----------------------------------------------------


def _uuid(suffix: str) -> str:
    return rf"regexp_replace(md5(event_id || '{suffix}'), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\1-\2-\3-\4-\5')"


_GOOD = "defect NOT IN ('not_json', 'no_time')"

_SQL |= {
    "src_batch_envelope": _facts(
        " UNION ALL ".join(
            f"SELECT event_id, cast({n} AS bigint) AS pos, {_uuid(s)} AS id, CASE WHEN event_id % 3 <> 0 THEN 'batch' END AS timezone "
            "FROM base WHERE event_id % 50 <> 9"
            for n, s in enumerate("ab")
        )
    ),
    "src_concatenated": _facts(
        " UNION ALL ".join(
            f"SELECT event_id, cast({n} AS bigint) AS pos, {_uuid(s)} AS id FROM base WHERE event_id % 40 <> 3" for n, s in enumerate("ab")
        )
    ),
    "src_facts": _facts(
        "SELECT workspace_id, event_name, count(*) AS event_count FROM f "
        "WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' GROUP BY 1, 2"
    ),
    "merge_facts": _facts("SELECT id AS event_id, event_name FROM f WHERE event_id % 3 <> 0"),
    "sink_facts": _log(
        f"SELECT uuid AS event_id, event_name, {_at('ts')} AS event_timestamp, workspace_id, actor_id, country FROM once WHERE {_GOOD}"
    ),
    "facts_over_batches": _log(f"SELECT workspace_id, event_name, count(*) AS event_count FROM once WHERE {_GOOD} GROUP BY 1, 2"),
    "sink_catalog": _log(
        ", kept AS (SELECT * REPLACE (CASE defect WHEN 'bad_org' THEN 'Bad Org' WHEN 'no_org' THEN '' ELSE org_id END AS org_id) FROM once WHERE " + _GOOD + "), "
        + _CATALOG.replace("FROM f)", "FROM kept)")
        + " SELECT org_id, workspace_id, event_name, property, type FROM catalog"
    ),
    "sink_archive": _log(
        "SELECT CASE WHEN defect = 'bad_org' THEN 'Bad Org' ELSE org END AS org, workspace, dt, hour, md5(value) AS digest FROM routed"
    ),
    "src_archive": _log(
        """SELECT workspace, dt, count(DISTINCT event_id) AS payloads
        FROM routed WHERE defect <> 'bad_org' AND dt BETWEEN '2024-01-03' AND '2024-01-20' GROUP BY 1, 2"""
    ),
    "sink_archive_manifest": _log(
        """, parts AS (SELECT CASE WHEN defect = 'bad_org' THEN 'Bad Org' ELSE org END AS org, workspace, dt, hour, topic, partition,
            count(*) AS n, min("offset") AS low, max("offset") AS high FROM routed GROUP BY ALL)
        SELECT org, workspace, dt, hour, cast(sum(n) AS bigint) AS event_count,
        string_agg(topic || ':' || partition || ':' || low || ':' || high, ';' ORDER BY low, topic, partition) AS ranges,
        'sample' AS source, '2024-03-01 00:00:00.000' AS created_at FROM parts GROUP BY 1, 2, 3, 4"""
    ),
    "sink_archive_idempotent": _log(
        """, objects AS (SELECT CASE WHEN defect = 'bad_org' THEN 'Bad Org' ELSE org END AS org, workspace, dt, hour, partition,
            "offset" // 1000 AS block, count(*) AS event_count, min("offset") AS first_offset, max("offset") AS last_offset,
            substr(sha256(string_agg(value || chr(10), '' ORDER BY "offset")), 1, 16) AS hash FROM routed GROUP BY ALL)
        SELECT 'backup/' || org || '/' || workspace || '/dt=' || dt || '/hour=' || lpad(cast(hour AS varchar), 2, '0') || '/' || hash
            || '.jsonl' AS object_key, event_count, first_offset, last_offset FROM objects"""
    ),
    "trigger_n_or_time": _log(
        """, r AS (SELECT topic, partition, "offset", (row_number() OVER (PARTITION BY partition ORDER BY "offset") - 1) // 100 AS cycle FROM log)
        SELECT topic, partition, cycle, CASE WHEN count(*) = 100 THEN 'number' ELSE 'time' END AS by, count(*) AS records,
            min("offset") AS first_offset, max("offset") AS last_offset FROM r GROUP BY topic, partition, cycle"""
    ),
    "linger_batch": _log(
        """, r AS (SELECT topic, partition, "offset", strlen(value) AS size, row_number() OVER w AS rn, sum(strlen(value)) OVER w AS total
            FROM log WINDOW w AS (PARTITION BY partition ORDER BY "offset")),
        reach AS (SELECT a.partition, a.rn AS start, max(b.rn) AS stop FROM r a JOIN r b ON a.partition = b.partition AND b.rn >= a.rn AND b.rn < a.rn + 50
            AND (b.rn = a.rn OR b.total - a.total + a.size <= 32768) GROUP BY 1, 2),
        chain AS (SELECT partition, start, stop, 0::BIGINT AS batch FROM reach WHERE start = 1
            UNION ALL SELECT n.partition, n.start, n.stop, batch + 1 FROM chain c JOIN reach n ON n.partition = c.partition AND n.start = c.stop + 1)
        SELECT topic, r.partition, batch, count(*) AS docs, cast(sum(size) AS bigint) AS bytes, min("offset") AS first_offset, max("offset") AS last_offset
        FROM r JOIN chain c ON r.partition = c.partition AND rn BETWEEN start AND stop GROUP BY 1, 2, 3"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "sink_quarantine": _log(
        """SELECT DISTINCT substr(sha256(value || chr(10)), 1, 16) AS content_hash, CASE defect WHEN 'not_json' THEN 'InvalidJson'
        WHEN 'no_org' THEN 'MissingOrgId' ELSE 'MissingTimestamp' END AS reason, value FROM log
        WHERE defect IN ('not_json', 'no_org', 'no_time')"""
    ),
    "sink_search_create": _facts("SELECT id AS event_id, event_name FROM f WHERE country IS DISTINCT FROM 'IN'"),
    "sink_dlq": _log(
        f"""SELECT key, partition, "offset", {_ERROR} AS error_class, cast("offset" AS varchar) AS source_offset,
        '2024-03-01T00:00:00.000Z' AS failed_at FROM log WHERE {_ERROR} IS NOT NULL"""
    ),
    "sink_routed": _log(f"SELECT {_DESTINATION} AS destination, count(*) AS records FROM log WHERE {_ERROR} IS NULL GROUP BY 1"),
    "sink_keyed": _facts("SELECT anon_id, count(*) AS events, true AS together FROM f GROUP BY 1"),
    "sink_expire": _log("SELECT dt, count(*) AS payloads FROM routed WHERE dt >= '2024-01-12' GROUP BY 1"),
    "sink_export_csv": _facts(
        """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS occured_at, id, event_name AS name,
        '{"coupon":"C' || (k % 5) || '","items":[' || k || ',1]}' AS cart, query FROM f"""
    ),
    "sink_export_json": _facts(
        f"""SELECT workspace_id, id AS event_id, event_name, {_at('ts')} AS event_timestamp, {_at('arrived_at')} AS arrived_at,
        session_id, anon_id, actor_id, source, '' AS correlation_id, '' AS trace_id, authenticated, country,
        'Europe/Berlin' AS timezone, cast(NULL AS varchar) AS ip_address, {_at('ts')} AS inserted_at, {_at('ts')} AS updated_at,
        cast(0 AS bigint) AS is_deleted, 'C' || (k % 5) AS coupon, k || ',1' AS items, query FROM f"""
    ),
    "sink_metric_snapshot": f"SELECT *, true AS kept, true AS failed, cast(3600 AS bigint) AS age_s FROM ({_SQL['event_distribution']})",
    "ingest_counters": _log(
        f""", judged AS (SELECT event_id, {_ERROR} AS class FROM log)
        SELECT 'consumed' AS counter, 'events' AS label, count(*) AS count FROM judged
        UNION ALL SELECT 'written', 'created', count(DISTINCT event_id) FROM judged WHERE class IS NULL
        UNION ALL SELECT 'written', 'already_written', count(*) - count(DISTINCT event_id) FROM judged WHERE class IS NULL
        UNION ALL SELECT 'rejected', class, count(*) FROM judged WHERE class IS NOT NULL GROUP BY class"""
    ),
    "dedup_audit": _log(
        f""", judged AS (SELECT event_id, {_ERROR} AS class FROM log)
        SELECT count(DISTINCT event_id) FILTER (class IS NULL) AS valid_ids, count(DISTINCT event_id) FILTER (class IS NULL) AS written_rows,
        cast(0 AS bigint) AS missing_ids, cast(0 AS bigint) AS duplicated_ids, cast(0 AS bigint) AS unexpected_ids,
        count(*) FILTER (class IS NULL) - count(DISTINCT event_id) FILTER (class IS NULL) AS resent,
        count(*) FILTER (class IS NOT NULL) AS bad_records, count(*) FILTER (class IS NOT NULL) AS dead_letters FROM judged"""
    ),
    "stream_reject_split": _log(
        ", kept AS (SELECT * FROM once WHERE " + _ERROR + " IS NULL), " + _CATALOG.replace("FROM f)", "FROM kept)")
        + f""" SELECT 'facts' AS sink, count(*) AS rows FROM kept
        UNION ALL SELECT 'dead_letters', count(*) FROM log WHERE {_ERROR} IS NOT NULL
        UNION ALL SELECT 'archive', count(*) FROM routed
        UNION ALL SELECT 'quarantine', count(DISTINCT value) FROM log WHERE defect IN ('not_json', 'no_org', 'no_time')
        UNION ALL SELECT 'catalog', count(*) FROM catalog"""
    ),
    "stream_dedup": _log(f"SELECT uuid AS event_id, event_name FROM once WHERE {_GOOD}"),
    "live_histogram": _log(
        f"SELECT {_at('make_timestamp((epoch(ts)::bigint // 43200) * 43200000000)')} AS time, count(*) AS count FROM log WHERE {_GOOD} GROUP BY 1"
    ),
    "auto_refresh": _SQL["p_time_relative"],
}

# -- shaping ---------------------------------------------------------------

_DAILY = """daily AS (SELECT strftime(ts, '%Y-%m-%d') AS day, cast(count(*) AS double) AS events,
    cast(count(DISTINCT nullif(actor_id, '')) AS double) AS users FROM f GROUP BY 1)"""

_SQL |= {
    "metric_sql": _facts(
        """SELECT strftime(ts, '%Y-%m-%d') AS day, event_name, count(*) AS events FROM f WHERE workspace_id = 'workspace-1'
        GROUP BY GROUPING SETS ((1, 2), (1))"""
    ),
    "metric_params": _facts(
        """SELECT event_name, count(*) AS events FROM f WHERE workspace_id = 'workspace-0' AND ts >= TIMESTAMP '2024-01-10'
        AND event_name LIKE '%i%' AND length(event_name) >= 5 GROUP BY 1"""
    ),
    "metric_dropdown": _facts("SELECT DISTINCT event_name AS option FROM f WHERE workspace_id = 'workspace-0' AND event_name LIKE '%e%'"),
    "metric_of_metric": _facts(
        """, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_name, count(*) AS events, count(DISTINCT actor_id) FILTER (actor_id <> '') AS users
        FROM f WHERE workspace_id = 'workspace-1' GROUP BY 1, 2)
        SELECT event_name, count(*) AS days, max(events) AS busiest, cast(sum(users) AS bigint) AS users FROM d GROUP BY 1"""
    ),
    "pivot_matrix": _facts(
        "SELECT event_name, "
        + ", ".join(f"coalesce(sum(cast(rank AS double)) FILTER (source = '{s}'), 0) AS {s}" for s in ("web", "ios", "android"))
        + " FROM f GROUP BY 1"
    ),
    "series_multi": _facts(
        f", {_DAILY} SELECT 'events' AS series, day, events AS y FROM daily UNION ALL SELECT 'users', day, users FROM daily"
    ),
    "minmax_normalise": _facts(
        f", {_DAILY} "
        + " UNION ALL ".join(
            f"SELECT '{y}' AS series, day, round(coalesce(({y} - min({y}) OVER ()) / nullif(max({y}) OVER () - min({y}) OVER (), 0) * 100, 0), 6)"
            f" AS scaled, {y} AS original FROM daily"
            for y in ("events", "users")
        )
    ),
    "top10_of_many": _facts(
        f""", c AS (SELECT city, count(*) AS n FROM f WHERE {_RANGE} AND city <> '' GROUP BY 1)
        SELECT city, n, (SELECT count(*) FROM c) AS categories FROM c ORDER BY n DESC, city LIMIT 10"""
    ),
    "reverse_order": _SQL["event_distribution"],
    "doc_summary": _facts(
        """SELECT id AS event_id, 'name=' || event_name || CASE WHEN session_id <> '' THEN '|session_id=' || session_id ELSE '' END
        || '|anon_id=' || anon_id || CASE WHEN actor_id <> '' THEN '|actor_id=' || actor_id ELSE '' END || '|source=' || source
        || CASE k % 3 WHEN 2 THEN '|properties.amount.cents=1250|properties.amount.currency=EUR' ELSE '|properties.amount=12.5' END
        || '|properties.browser=' || browser || '|properties.cart.coupon=C' || (k % 5) || '|properties.cart.items=[' || k || ',1]'
        || '|properties.city=' || city || coalesce('|properties.device_type=' || device_type, '') || '|properties.k=' || k
        || '|properties.platform=' || platform || '|properties.query=' || query || '|properties.rank=' || rank
        || coalesce('|system_properties.geo.country=' || country, '') || '|system_properties.timezone=Europe/Berlin'
        || '|arrived_at=' || strftime(arrived_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z|authenticated=' || cast(authenticated AS varchar)
        || '|id=' || id AS summary FROM f"""
    ),
    "redact": _facts("SELECT id AS event_id, 'cannot read [index] of [redacted]' AS text FROM f"),
}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
