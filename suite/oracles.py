"""The SQL each registered query must agree with, run on the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

# --- shared table expressions ---------------------------------------------

SIGNALS = """
k0 AS (
    SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events
),
s AS (
    SELECT event_id, user_id, event_type, value, k, ts,
        'node-' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS node_id,
        'boot-' || CAST((day(ts) - 1) // 10 AS VARCHAR) AS boot_id,
        strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS emitted_at,
        event_id + 1 AS seq,
        epoch_us(ts) // 3600000000 AS hour_no,
        NOT (event_type = 'signup' AND k % 10 = 0) AS cpu_ok,
        NOT (event_type = 'error' AND k % 4 = 0) AS beat_ok,
        CASE WHEN NOT (event_type = 'signup' AND k % 10 = 0) THEN value / 10 END AS load1,
        CASE WHEN NOT (event_type = 'signup' AND k % 10 = 0) THEN value / 20 END AS load5,
        CASE WHEN NOT (event_type = 'signup' AND k % 10 = 0) THEN value / 40 END AS load15,
        CAST(17179869100 AS BIGINT) AS mem_total,
        CAST(k + 1 AS BIGINT) * 171798691 AS mem_avail,
        CAST(500000000000 AS BIGINT) AS disk_total,
        ((event_id * 37) % 100 + 1) * 5000000000 AS disk_free
    FROM k0
)"""

HOURS = "3600000000.0"


def verdicts(
    source: str = "s",
    name: str = "r",
    cpu=("0.85e0", "1.25e0"),
    mem=("15e0", "8e0"),
    disk=("10e0", "5e0"),
    failures: bool = True,
    extra: str = "NULL",
) -> str:
    """Reasons and health of every row of ``source`` under the given limits."""
    tags = (
        "CASE WHEN NOT beat_ok THEN 'collector_failed:heartbeat' END,"
        " CASE WHEN NOT cpu_ok THEN 'collector_failed:cpu' END,"
        if failures
        else ""
    )
    return f"""
{name}_reasons AS (
    SELECT *, list_sort(list_distinct(list_filter([{tags}
        CASE WHEN load1 > 8 * {cpu[1]} THEN 'signal:cpu_critical'
             WHEN load1 > 8 * {cpu[0]} THEN 'signal:cpu_high' END,
        CASE WHEN mem_avail / mem_total * 1e2 < {mem[1]} THEN 'signal:mem_available_critical'
             WHEN mem_avail / mem_total * 1e2 < {mem[0]} THEN 'signal:mem_available_low' END,
        CASE WHEN disk_free / disk_total * 1e2 < {disk[1]} THEN 'signal:disk_free_critical'
             WHEN disk_free / disk_total * 1e2 < {disk[0]} THEN 'signal:disk_free_low' END,
        {extra}
    ], lambda x: x IS NOT NULL))) AS reasons
    FROM {source}
),
{name} AS (
    SELECT *, CASE
        WHEN len(list_filter(reasons, lambda x: ends_with(x, '_critical'))) > 0 THEN 'UNHEALTHY'
        WHEN len(reasons) > 0 THEN 'DEGRADED' ELSE 'OK' END AS health
    FROM {name}_reasons
)"""


BASE = f"WITH {SIGNALS},\n{verdicts()}"

TAIL = """
tail AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY event_id DESC) AS tail_rank FROM r
    ) WHERE tail_rank <= 200
)"""


def _trend(signal: str, column: str, unit: str, divisor: str, stable: str) -> str:
    return f"""
    SELECT node_id, '{signal}' AS signal,
        CASE WHEN abs(slope) < {stable} THEN 'stable'
             WHEN slope > 0 THEN 'rising' ELSE 'declining' END AS direction,
        slope, '{unit}' AS unit
    FROM (
        SELECT node_id, CASE WHEN count({column}) >= 2 THEN
            regr_slope(CAST({column} AS DOUBLE), CAST(epoch_us(ts) AS DOUBLE)) * {HOURS} / {divisor}
            END AS slope
        FROM src GROUP BY node_id
    ) WHERE slope IS NOT NULL"""


def summary(source: str) -> str:
    """Table expressions ending in ``summary``, over the rows of ``source``."""
    return f"""
src AS (SELECT * FROM {source}),
latest AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (
            PARTITION BY node_id ORDER BY emitted_at DESC, seq DESC, event_id) AS newest FROM src
    ) WHERE newest = 1
),
moves AS (
    SELECT node_id, CAST(sum(CASE WHEN before <> health THEN 1 ELSE 0 END) AS BIGINT) AS moves FROM (
        SELECT node_id, health, lag(health) OVER (PARTITION BY node_id ORDER BY event_id) AS before FROM src
    ) GROUP BY node_id
),
counts AS (
    SELECT node_id, reason, count(*) AS n FROM (
        SELECT node_id, unnest(reasons) AS reason FROM src) GROUP BY node_id, reason
),
places AS (
    SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, reason) AS place FROM counts
),
top5 AS (
    SELECT node_id, string_agg(reason || ':' || n, ',' ORDER BY place) AS listed,
        string_agg(reason || ':' || n, ', ' ORDER BY place) AS listed_text,
        string_agg('{{"count":' || n || ',"reason":"' || reason || '"}}', ',' ORDER BY place) AS listed_json,
        min_by(reason, place) AS most
    FROM places WHERE place <= 5 GROUP BY node_id
),
trends AS (
    {_trend('loadavg_1m', 'load1', 'load/hr', '1.0', '0.1')}
    UNION ALL {_trend('mem_available_bytes', 'mem_avail', 'GB/hr', '1073741824.0', '0.1')}
    UNION ALL {_trend('disk_free_bytes', 'disk_free', 'GB/hr', '1073741824.0', '0.01')}
),
trend_labels AS (
    SELECT node_id, signal, direction, CAST(printf('%.3f', slope) AS DOUBLE) AS slope_per_hr,
        CASE WHEN direction = 'stable' THEN 'stable'
             ELSE direction || ' (' || printf('%+.2f', slope) || ' ' || unit || ')' END AS label
    FROM trends
),
trend_lists AS (
    SELECT node_id, string_agg(signal || '=' || label, ',' ORDER BY signal) AS listed,
        string_agg(signal || '_trend: ' || label, chr(10) ORDER BY signal) AS text_lines,
        string_agg('  ' || signal || ': ' || label, chr(10) ORDER BY signal) AS pretty_lines,
        string_agg('- ' || signal || ': ' || label, chr(10) ORDER BY signal) AS explain_lines,
        string_agg('"' || signal || '":{{"direction":"' || direction || '","label":"' || label
            || '","slope_per_hr":' || CAST(slope_per_hr AS VARCHAR) || '}}', ',' ORDER BY signal) AS json
    FROM trend_labels GROUP BY node_id
),
totals AS (
    SELECT node_id, count(*) AS seen,
        count(*) FILTER (WHERE health = 'DEGRADED') AS degraded,
        count(*) FILTER (WHERE health = 'UNHEALTHY') AS unhealthy,
        CAST(printf('%.2f', max(load1)) AS DOUBLE) AS max_load,
        CAST(printf('%.2f', min(mem_avail / mem_total * 1e2)) AS DOUBLE) AS min_mem,
        CAST(printf('%.2f', min(disk_free / disk_total * 1e2)) AS DOUBLE) AS min_disk
    FROM src GROUP BY node_id
),
summary AS (
    SELECT t.node_id, l.boot_id AS current_boot_id, l.seq AS latest_seq,
        l.emitted_at AS latest_emitted_at, l.health AS current_health, l.reasons AS reasons,
        t.seen AS reports_seen_tail, t.degraded AS degraded_count_tail,
        t.unhealthy AS unhealthy_count_tail,
        l.load1 AS loadavg_1m, l.load5 AS loadavg_5m, l.load15 AS loadavg_15m,
        8 AS cpu_count_logical, l.mem_total AS mem_total_bytes, l.mem_avail AS mem_available_bytes,
        l.disk_total AS disk_total_bytes, l.disk_free AS disk_free_bytes,
        t.max_load AS max_cpu1_tail, t.min_mem AS min_mem_available_pct_tail,
        t.min_disk AS min_disk_free_pct_tail, m.moves AS health_transitions_tail,
        coalesce(p.listed, '') AS top_reasons_tail, coalesce(p.listed_text, 'none') AS top_text,
        coalesce(p.listed_json, '') AS top_json, coalesce(p.most, 'none') AS most,
        array_to_string(l.reasons, ',') AS current_reasons,
        coalesce(d.listed, '') AS signal_trends,
        d.text_lines, d.pretty_lines, d.explain_lines, d.json AS trends_json
    FROM totals t JOIN latest l USING (node_id) JOIN moves m USING (node_id)
    LEFT JOIN top5 p USING (node_id) LEFT JOIN trend_lists d USING (node_id)
)"""


SUMMARY = f"{BASE},{TAIL},{summary('tail')}\n"
HISTORY = f"{BASE},{summary('r')}\n"

FLAT = """SELECT node_id, current_boot_id, latest_seq, latest_emitted_at, current_health,
    reports_seen_tail, degraded_count_tail, unhealthy_count_tail, loadavg_1m, loadavg_5m,
    loadavg_15m, cpu_count_logical, mem_total_bytes, mem_available_bytes, disk_total_bytes,
    disk_free_bytes, max_cpu1_tail, min_mem_available_pct_tail, min_disk_free_pct_tail,
    health_transitions_tail, current_reasons, top_reasons_tail, signal_trends FROM summary"""

# --- signals and verdicts -------------------------------------------------

REASONS = "array_to_string(reasons, ',') AS reasons"

SQL["reports_view"] = f"""{BASE}
SELECT event_id, node_id, boot_id, emitted_at, seq, health, {REASONS}, '1' AS schema_version,
    load1 AS loadavg_1m, mem_avail AS mem_available_bytes, disk_free AS disk_free_bytes FROM r"""

SQL["pct_signals"] = f"""WITH {SIGNALS}
SELECT event_id, round(mem_avail / mem_total * 1e2, 6) AS mem_pct,
    round(disk_free / disk_total * 1e2, 6) AS disk_pct FROM s"""

SQL["eval_cpu"] = f"""WITH {SIGNALS}
SELECT event_id, CASE WHEN load1 > 8 * 1.25e0 THEN 'signal:cpu_critical'
    WHEN load1 > 8 * 0.85e0 THEN 'signal:cpu_high' END AS reason FROM s"""

SQL["eval_mem"] = f"""WITH {SIGNALS}
SELECT event_id, CASE WHEN mem_avail / mem_total * 1e2 < 8 THEN 'signal:mem_available_critical'
    WHEN mem_avail / mem_total * 1e2 < 15 THEN 'signal:mem_available_low' END AS reason FROM s"""

SQL["eval_disk"] = f"""WITH {SIGNALS}
SELECT event_id, CASE WHEN disk_free / disk_total * 1e2 < 5 THEN 'signal:disk_free_critical'
    WHEN disk_free / disk_total * 1e2 < 10 THEN 'signal:disk_free_low' END AS reason FROM s"""

SQL["failure_tags"] = f"""WITH {SIGNALS}
SELECT event_id, coalesce(concat_ws(',',
    CASE WHEN NOT cpu_ok THEN 'collector_failed:cpu' END,
    CASE WHEN NOT beat_ok THEN 'collector_failed:heartbeat' END,
    CASE WHEN k % 13 = 0 THEN 'collector_failed:identity' END), '') AS tags FROM s"""

SQL["health_verdict"] = f"{BASE}\nSELECT event_id, health, {REASONS} FROM r"

SQL["verdict_extra_rule"] = f"""WITH {SIGNALS},
{verdicts(failures=False, extra="CASE WHEN load5 > 4 THEN 'signal:load_spike' END")}
SELECT event_id, health, {REASONS} FROM r"""

SQL["builder_errors"] = f"""WITH {SIGNALS}
SELECT event_id, CASE k % 10
    WHEN 1 THEN 'timing.seq must be >= 1'
    WHEN 2 THEN 'identity.node_id is empty'
    WHEN 3 THEN 'assessment.health must be: [''DEGRADED'', ''OK'', ''UNHEALTHY'']'
    WHEN 4 THEN 'timing.emitted_at is empty'
    WHEN 5 THEN 'meta.agent_version must be non-empty' END AS error FROM s"""

# --- thresholds -----------------------------------------------------------

LAYERS = """
given AS (
    SELECT 'p' || c_custkey AS profile, 1 AS rank, 'cpu' AS section, 'degraded_factor' AS key,
        CAST((50 + c_custkey % 50) / 100.0 AS DOUBLE) :: VARCHAR AS value FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT 'p' || c_custkey, 1, 'mem', 'degraded_pct', '15' FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT 'p' || c_custkey, 1, 'disk', 'spare_pct', '1.5' FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT 'p' || c_custkey, 2, 'mem', 'unhealthy_pct', (c_custkey % 10) || '.0'
        FROM customer WHERE c_custkey % 7 = 0
    UNION ALL SELECT 'p' || c_custkey, 2, 'cpu', 'unhealthy_factor', NULL FROM customer WHERE c_custkey % 11 = 0
    UNION ALL SELECT 'p' || c_custkey, 2, 'evaluation', 'profile_name', '"' || lower(c_mktsegment) || '"'
        FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT 'p' || c_custkey, 1, 'disk', 'degraded_pct', '12.5' FROM customer
    UNION ALL SELECT 'p' || c_custkey, 0, d.section, d.key, d.value
        FROM customer, (VALUES ('cpu', 'degraded_factor', '0.85'), ('cpu', 'unhealthy_factor', '1.25'),
            ('disk', 'degraded_pct', '10.0'), ('disk', 'unhealthy_pct', '5.0'),
            ('evaluation', 'profile_name', '"default"'), ('mem', 'degraded_pct', '15.0'),
            ('mem', 'unhealthy_pct', '8.0')) AS d(section, key, value)
),
resolved AS (
    SELECT profile, section, key, max_by(value, rank) FILTER (WHERE value IS NOT NULL) AS value,
        CASE WHEN max(rank) = 2 THEN 'env'
             WHEN max(rank) = 1 AND try_cast(max(value) FILTER (WHERE rank = 1) AS DOUBLE) IS DISTINCT FROM
                  try_cast(max(value) FILTER (WHERE rank = 0) AS DOUBLE) THEN 'file'
             ELSE 'default' END AS source
    FROM given GROUP BY profile, section, key
),
parts AS (
    SELECT profile, section, '"' || section || '":{' ||
        string_agg('"' || key || '":' || value, ',' ORDER BY key) || '}' AS part
    FROM resolved GROUP BY profile, section
),
hashes AS (
    SELECT profile, left(sha256('{' || string_agg(part, ',' ORDER BY section) || '}'), 16) AS thresholds_hash
    FROM parts GROUP BY profile
),
profiles AS (
    SELECT profile,
        max(try_cast(value AS DOUBLE)) FILTER (WHERE section = 'cpu' AND key = 'degraded_factor') AS cpu_degraded_factor,
        max(try_cast(value AS DOUBLE)) FILTER (WHERE section = 'cpu' AND key = 'unhealthy_factor') AS cpu_unhealthy_factor,
        max(try_cast(value AS DOUBLE)) FILTER (WHERE section = 'mem' AND key = 'degraded_pct') AS mem_degraded_pct,
        max(try_cast(value AS DOUBLE)) FILTER (WHERE section = 'mem' AND key = 'unhealthy_pct') AS mem_unhealthy_pct,
        max(try_cast(value AS DOUBLE)) FILTER (WHERE section = 'disk' AND key = 'degraded_pct') AS disk_degraded_pct,
        max(try_cast(value AS DOUBLE)) FILTER (WHERE section = 'disk' AND key = 'unhealthy_pct') AS disk_unhealthy_pct,
        max(trim(value, '"')) FILTER (WHERE key = 'profile_name') AS profile_name
    FROM resolved GROUP BY profile
)"""

SQL["threshold_layers"] = f"WITH {LAYERS}\nSELECT * FROM resolved"
SQL["thresholds_by_profile"] = f"WITH {LAYERS}\nSELECT * FROM profiles JOIN hashes USING (profile)"

SQL["threshold_documents"] = """
WITH given AS (
    SELECT 'p' || c_custkey AS profile, 0 AS rank, d.section, d.key, d.value
    FROM customer, (VALUES ('cpu', 'degraded_factor', '0.85'), ('cpu', 'unhealthy_factor', '1.25'),
        ('disk', 'degraded_pct', '10.0'), ('disk', 'unhealthy_pct', '5.0'),
        ('evaluation', 'profile_name', '"default"'), ('mem', 'degraded_pct', '15.0'),
        ('mem', 'unhealthy_pct', '8.0')) AS d(section, key, value)
    UNION ALL SELECT 'p' || c_custkey, 1, 'mem', 'degraded_pct', (c_custkey % 50) || '.5' FROM customer WHERE c_custkey % 7 = 2
    UNION ALL SELECT 'p' || c_custkey, 1, 'disk', 'spare_pct', c_custkey :: VARCHAR FROM customer WHERE c_custkey % 7 = 3
    UNION ALL SELECT 'p' || c_custkey, 1, 'disk', 'degraded_pct', '10' FROM customer WHERE c_custkey % 7 = 3
    UNION ALL SELECT 'p' || c_custkey, 1, 'evaluation', 'profile_name', '"' || lower(c_mktsegment) || '"'
        FROM customer WHERE c_custkey % 7 = 4
    UNION ALL SELECT 'p' || c_custkey, 1, 'evaluation', 'own', '{"a":[1,"x"]}' FROM customer WHERE c_custkey % 7 = 4
    UNION ALL SELECT 'p' || c_custkey, 1, 'mem', 'unhealthy_pct', 'null' FROM customer WHERE c_custkey % 7 = 5
    UNION ALL SELECT 'p' || c_custkey, 1, 'mem', 'degraded_pct', '15' FROM customer WHERE c_custkey % 7 = 5
),
wide AS (
    SELECT profile, section, key, max(value) FILTER (WHERE rank = 0) AS base, max(value) FILTER (WHERE rank = 1) AS file
    FROM given GROUP BY profile, section, key
)
SELECT profile, section, key, coalesce(file, base) AS value,
    CASE WHEN file IS NULL OR file = base OR try_cast(file AS DOUBLE) = try_cast(base AS DOUBLE) THEN 'default'
         ELSE 'file' END AS source
FROM wide"""
SQL["iso_forms"] = """
WITH parts AS (
    SELECT event_id, ts, CAST(event_id % 8 AS INTEGER) AS form,
        lpad(CAST(isoyear(ts) AS VARCHAR), 4, '0') AS y, lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS w, isodow(ts) AS d
    FROM events)
SELECT event_id,
    CASE form WHEN 0 THEN strftime(ts, '%Y%m%dT%H%M%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H')
        WHEN 2 THEN strftime(ts, '%Y%m%d') WHEN 3 THEN y || '-W' || w || '-' || d
        WHEN 4 THEN y || 'W' || w || d || strftime(ts, 'T%H%M')
        WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S,%f+0130')
        WHEN 6 THEN strftime(ts, '%Y%m%dx%H:%M:%S.%f-19:30:15') ELSE '2026-W54-1' END AS text,
    CASE form WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(date_trunc('hour', ts))
        WHEN 2 THEN epoch_us(date_trunc('day', ts)) WHEN 3 THEN epoch_us(date_trunc('day', ts))
        WHEN 4 THEN epoch_us(date_trunc('minute', ts)) WHEN 5 THEN epoch_us(ts) - 5400000000
        WHEN 6 THEN epoch_us(ts) + 70215000000 END AS micros
FROM parts"""

_BY_PROFILE = verdicts(
    source="named",
    cpu=("coalesce(cpu_degraded_factor, 0.85e0)", "coalesce(cpu_unhealthy_factor, 1.25e0)"),
    mem=("coalesce(mem_degraded_pct, 15e0)", "coalesce(mem_unhealthy_pct, 8e0)"),
    disk=("coalesce(disk_degraded_pct, 10e0)", "coalesce(disk_unhealthy_pct, 5e0)"),
)
SQL["verdict_by_profile"] = f"""WITH {SIGNALS}, {LAYERS},
named AS (SELECT s.*, profiles.* FROM s LEFT JOIN profiles ON profiles.profile = 'p' || s.user_id),
{_BY_PROFILE}
SELECT event_id, health, {REASONS} FROM r"""

_STRICT = verdicts(
    name="n", cpu=("0.5e0", "1.25e0"), mem=("25e0", "8e0"), disk=("10e0", "8e0")
)
SQL["verdict_shift_matrix"] = f"""{BASE},
{_STRICT}
SELECT r.health, n.health AS new_health, count(*) AS reports
FROM r JOIN n USING (event_id) GROUP BY r.health, n.health"""

# --- tails and summaries --------------------------------------------------

SQL["tail_per_node"] = f"{BASE},{TAIL}\nSELECT node_id, event_id, tail_rank FROM tail"
SQL["node_summary"] = SUMMARY + FLAT
SQL["stream_node_summary"] = SQL["node_summary"]
SQL["node_history_summary"] = HISTORY + FLAT
SQL["node_counts"] = f"""{SUMMARY}
SELECT node_id, reports_seen_tail, degraded_count_tail, unhealthy_count_tail FROM summary"""
SQL["node_latest"] = f"""{BASE}
SELECT node_id, event_id, boot_id, CAST(k AS BIGINT) AS seq, left(emitted_at, 10) AS emitted_at,
    health, {REASONS}
FROM (SELECT *, row_number() OVER (
        PARTITION BY node_id ORDER BY left(emitted_at, 10) DESC, k DESC, event_id) AS newest FROM r)
WHERE newest = 1"""
SQL["node_extremes"] = f"""{SUMMARY}
SELECT node_id, max_cpu1_tail, min_mem_available_pct_tail, min_disk_free_pct_tail FROM summary"""
SQL["reason_counts"] = f"""{BASE}
SELECT node_id, reason, count(*) AS count FROM (SELECT node_id, unnest(reasons) AS reason FROM r)
GROUP BY node_id, reason"""
SQL["top_reasons"] = f"""{HISTORY}
SELECT node_id, reason, n AS count, place FROM places WHERE place <= 3"""
SQL["health_transitions"] = f"""{HISTORY}
SELECT node_id, reports_seen_tail AS reports, health_transitions_tail AS transitions FROM summary"""
SQL["signal_trends"] = f"""{SUMMARY}
SELECT node_id, signal, direction, slope_per_hr, label FROM trend_labels"""
SQL["filter_node"] = f"""{SUMMARY}
SELECT node_id, current_health, reports_seen_tail FROM summary WHERE node_id = 'node-07'"""
SQL["filter_degraded"] = f"""{SUMMARY}
SELECT node_id, current_health, degraded_count_tail FROM summary WHERE current_health = 'DEGRADED'"""
SQL["filter_unhealthy"] = f"""{SUMMARY}
SELECT node_id, current_health, unhealthy_count_tail FROM summary WHERE current_health = 'UNHEALTHY'"""
SQL["filter_min_degraded"] = f"""{SUMMARY}
SELECT node_id, current_health, degraded_count_tail FROM summary WHERE degraded_count_tail >= 45"""
SQL["fleet_rollup"] = f"""{SUMMARY}
SELECT count(*) AS nodes, count(*) FILTER (WHERE current_health = 'OK') AS ok_nodes,
    count(*) FILTER (WHERE current_health = 'DEGRADED') AS degraded_nodes,
    count(*) FILTER (WHERE current_health = 'UNHEALTHY') AS unhealthy_nodes,
    coalesce(bool_or(current_health = 'DEGRADED'), false) AS any_degraded,
    coalesce(bool_or(current_health = 'UNHEALTHY'), false) AS any_unhealthy FROM summary"""
SQL["alert_code"] = f"""{SUMMARY}
SELECT CASE WHEN count(*) > 0 THEN 2 ELSE 0 END AS alert_code FROM summary
WHERE current_health = 'DEGRADED'"""

META = """
meta AS (
    SELECT '1' AS schema_version, 200 AS tail_n, count(*) AS nodes_seen_tail,
        count(*) FILTER (WHERE degraded_count_tail >= 45) AS nodes_emitted,
        CAST(sum(reports_seen_tail) AS BIGINT) AS reports_parsed, CAST(0 AS BIGINT) AS reports_invalid,
        '2026-01-01T00:00:00+00:00' AS computed_at
    FROM summary
)"""
SQL["summary_meta"] = f"{SUMMARY},{META}\nSELECT * FROM meta"

SQL["ranked_reasons"] = f"""{BASE},
counts AS (
    SELECT node_id, reason, count(*) AS count FROM (SELECT node_id, unnest(reasons) AS reason FROM r)
    GROUP BY node_id, reason
)
SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY count DESC, reason) AS place FROM counts"""
SQL["fleet_reasons"] = f"""{BASE},
counts AS (
    SELECT reason, count(*) AS count FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason
)
SELECT *, row_number() OVER (ORDER BY count DESC, reason) AS place FROM counts"""

SQL["legacy_summary"] = f"""{BASE},
last AS (SELECT * FROM r ORDER BY event_id DESC LIMIT 1),
counts AS (
    SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason
)
SELECT node_id, boot_id, CAST(seq AS VARCHAR) AS latest_seq, emitted_at AS latest_emitted_at,
    health AS latest_health,
    (SELECT count(*) FROM r WHERE health = 'DEGRADED') AS degraded_count_tail,
    (SELECT string_agg(reason || ':' || n, ', ' ORDER BY n DESC, reason) FROM counts) AS top_reasons_tail
FROM last"""

SQL["tail_stats"] = f"""{BASE},{TAIL}
SELECT count(*) AS reports_parsed, CAST(max_by(seq, event_id) AS VARCHAR) AS last_seq,
    max_by(health, event_id) AS last_health FROM tail"""

SQL["tail_large"] = """
SELECT l_linestatus, l_orderkey, l_linenumber, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey DESC, l_linenumber DESC) <= 12000"""

SQL["mixed_thresholds"] = f"""{BASE},
newest AS (
    SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY node_id ORDER BY emitted_at DESC, seq DESC, event_id) AS place FROM r) WHERE place = 1
),
per_hash AS (SELECT 'h' || (user_id % 7) AS hash, count(*) AS nodes FROM newest GROUP BY 1)
SELECT count(*) AS distinct_hashes, CAST(sum(nodes) AS BIGINT) AS nodes_with_hash,
    (SELECT hash FROM per_hash ORDER BY nodes DESC, hash DESC LIMIT 1) AS most_common_hash,
    count(*) > 1 AS mixed FROM per_hash"""

# --- lines, parsing and validation ---------------------------------------

def shortest(x: str) -> str:
    """A double as JSON text: below 0.001 with an exponent, as Java writes it."""
    return f"""CASE WHEN {x} = 0 OR abs({x}) >= 0.001 THEN CAST({x} AS VARCHAR)
        WHEN {x} >= 0.0001 THEN substr(CAST({x} AS VARCHAR), 6, 1) || '.' ||
            coalesce(nullif(substr(CAST({x} AS VARCHAR), 7), ''), '0') || 'E-4'
        ELSE regexp_replace(split_part(CAST({x} AS VARCHAR), 'e', 1), '^(\\d+)$', '\\1.0') || 'E' ||
            CAST(split_part(CAST({x} AS VARCHAR), 'e', 2) AS INTEGER) END"""


REPORT_JSON = f"""
'{{"assessment":{{"health":"' || health || '","reasons":[' ||
    array_to_string(list_transform(reasons, lambda x: '"' || x || '"'), ',') ||
    ']}},"identity":{{"boot_id":"' || boot_id || '","node_id":"' || node_id ||
    '"}},"meta":{{"agent_version":"0.1.0","schema_version":"1","threshold_profile":"default",' ||
    '"thresholds_hash":""}},"signals":{{"cpu_count_logical":8,"disk_free_bytes":' || disk_free ||
    ',"disk_total_bytes":' || disk_total || CASE WHEN beat_ok THEN ',"heartbeat_ok":true' ELSE '' END ||
    CASE WHEN cpu_ok THEN ',"loadavg_15m":' || {shortest("load15")} || ',"loadavg_1m":' || {shortest("load1")} ||
        ',"loadavg_5m":' || {shortest("load5")} ELSE '' END ||
    ',"mem_available_bytes":' || mem_avail || ',"mem_total_bytes":' || mem_total ||
    '}},"timing":{{"emitted_at":"' || emitted_at || '","seq":' || seq || '}}}}'"""

SQL["report_json_lines"] = f"{BASE}\nSELECT event_id, {REPORT_JSON} AS line FROM r"

# what each damaged line still holds
LINES = """
lines AS (
    SELECT *, event_id % 40 AS fault, event_id % 40 IN (1, 2, 3, 14) AS unparsed FROM r
),
parsed AS (
    SELECT event_id, node_id AS spool, fault,
        CASE WHEN fault = 8 THEN 'unknown' ELSE node_id END AS node_id,
        CASE WHEN fault = 6 THEN 'BROKEN' WHEN fault = 13 THEN NULL ELSE health END AS health,
        CASE WHEN fault = 11 THEN [] ELSE reasons END AS reasons,
        CASE WHEN fault = 9 THEN 'yesterday' ELSE emitted_at END AS emitted_at,
        CASE WHEN fault = 9 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS emitted_ts,
        CASE WHEN fault = 7 THEN 0 WHEN fault = 16 THEN 3 ELSE seq END AS seq,
        CASE WHEN fault = 7 THEN '0' WHEN fault = 16 THEN '3.9' ELSE CAST(seq AS VARCHAR) END AS seq_text,
        CASE WHEN fault = 7 THEN '0' WHEN fault = 16 THEN '3.9' WHEN fault = 5 THEN '"' || seq || '"'
            ELSE CAST(seq AS VARCHAR) END AS seq_json,
        CASE WHEN fault = 4 THEN NULL WHEN fault IN (10, 13) THEN '2' ELSE '1' END AS schema_version,
        CASE WHEN fault IN (4, 12) OR NOT beat_ok THEN NULL ELSE true END AS heartbeat_ok,
        CASE WHEN fault IN (4, 12) THEN NULL ELSE load1 END AS load1,
        CASE WHEN fault IN (4, 12) THEN NULL ELSE load5 END AS load5,
        CASE WHEN fault IN (4, 12) THEN NULL ELSE load15 END AS load15,
        CASE WHEN fault IN (4, 12) THEN NULL ELSE mem_avail END AS mem_avail,
        mem_total, CASE WHEN fault IN (4, 12, 17) THEN NULL ELSE disk_free END AS disk_free, disk_total
    FROM lines WHERE NOT unparsed
)"""
PARSED = f"{BASE},{LINES}\n"

SQL["parse_lines"] = f"""{PARSED}
SELECT event_id, node_id, health, {REASONS}, emitted_at, emitted_ts, seq, schema_version,
    heartbeat_ok, load1 AS loadavg_1m, load5 AS loadavg_5m, load15 AS loadavg_15m,
    mem_avail AS mem_available_bytes, disk_free AS disk_free_bytes FROM parsed"""
SQL["invalid_counts"] = f"""{PARSED}
SELECT node_id AS file_path, count(*) AS lines, count(*) FILTER (WHERE NOT unparsed) AS reports_parsed,
    count(*) FILTER (WHERE fault IN (2, 3, 14)) AS reports_invalid FROM lines GROUP BY node_id"""

LAST_VALID = f"""{PARSED},
complete AS (
    SELECT *, row_number() OVER (PARTITION BY spool ORDER BY event_id DESC) AS place FROM parsed
    WHERE fault NOT IN (8, 13)
)"""
SQL["last_valid_report"] = f"""{LAST_VALID}
SELECT spool AS file_path, 'node_id=' || node_id || ' health=' || health || ' seq=' || seq_text ||
    ' emitted_at=' || emitted_at || ' reasons=' ||
    CASE WHEN len(reasons) = 0 THEN 'none' ELSE array_to_string(reasons, ',') END AS status
FROM complete WHERE place = 1"""
SQL["status_json"] = f"""{LAST_VALID}
SELECT spool AS file_path, '{{"emitted_at":"' || emitted_at || '","health":"' || health ||
    '","node_id":"' || node_id || '","reasons":[' ||
    array_to_string(list_transform(reasons, lambda x: '"' || x || '"'), ',') ||
    '],"seq":' || seq_json || '}}' AS status
FROM complete WHERE place = 1"""
SQL["valid_report_fields"] = f"""{PARSED}
SELECT event_id, NOT unparsed AND fault NOT IN (8, 13) AS complete FROM lines"""

CHECKED = f"""{BASE},{LINES},
checked AS (
    SELECT event_id, node_id AS spool, fault, CASE fault
        WHEN 2 THEN ['invalid JSON']
        WHEN 3 THEN ['expected JSON object, got list']
        WHEN 4 THEN ['missing required keys: [''meta'', ''signals'']']
        WHEN 5 THEN ['timing.seq must be an integer >= 1, got ''' || seq || '''']
        WHEN 6 THEN ['assessment.health must be one of [''DEGRADED'', ''OK'', ''UNHEALTHY''], got ''BROKEN''']
        WHEN 7 THEN ['timing.seq must be an integer >= 1, got 0']
        WHEN 8 THEN ['identity.node_id must be a non-empty string']
        WHEN 9 THEN ['timing.emitted_at is not a valid RFC3339 timestamp: ''yesterday''']
        WHEN 10 THEN ['meta.schema_version must be ''1'', got 2']
        WHEN 11 THEN ['assessment.reasons must be an array']
        WHEN 12 THEN ['signals must be an object']
        WHEN 13 THEN ['assessment.health must be one of [''DEGRADED'', ''OK'', ''UNHEALTHY''], got None',
                      'meta.schema_version must be ''1'', got ''2''']
        WHEN 14 THEN ['invalid JSON']
        WHEN 16 THEN ['timing.seq must be an integer >= 1, got 3.9']
        ELSE [] END AS errors
    FROM lines WHERE fault <> 1
),
checked_tail AS (
    SELECT *, row_number() OVER (PARTITION BY spool ORDER BY event_id) AS line_no FROM (
        SELECT *, row_number() OVER (PARTITION BY spool ORDER BY event_id DESC) AS back FROM checked
    ) WHERE back <= 100
)"""
SQL["validate_reports"] = f"""{CHECKED}
SELECT event_id, len(errors) = 0 AS is_valid, array_to_string(errors, '; ') AS errors FROM checked"""
SQL["validation_errors"] = f"""{CHECKED}
SELECT spool, line_no, unnest(errors) AS message FROM checked_tail"""
SQL["validation_all_lines"] = f"""{CHECKED}
SELECT spool, event_id, len(errors) = 0 AS is_valid,
    row_number() OVER (PARTITION BY spool ORDER BY event_id) AS line_no FROM checked"""
SQL["validation_counts"] = f"""{CHECKED}
SELECT count(*) FILTER (WHERE len(errors) = 0) AS valid_count,
    count(*) FILTER (WHERE len(errors) > 0) AS invalid_count,
    CAST(sum(len(errors)) AS BIGINT) AS error_count FROM checked_tail"""
SQL["quarantine"] = f"""{CHECKED}
SELECT spool AS file_path, CASE WHEN len(errors) = 0 THEN 'valid' ELSE 'invalid' END AS lot,
    count(*) AS lines FROM checked GROUP BY 1, 2"""

FILES = f"""{BASE},
filed AS (
    SELECT *, 'f' || CASE WHEN user_id % 3 = 0 THEN user_id % 30 ELSE 100 + user_id % 40 END AS file_path
    FROM r
)"""
SQL["multi_node_files"] = f"""{FILES}
SELECT file_path, min(node_id) AS first_node, max(node_id) AS last_node FROM filed
GROUP BY file_path HAVING count(DISTINCT node_id) > 1"""
SQL["single_node_files"] = f"""{FILES}
SELECT file_path, node_id, count(*) AS reports FROM filed WHERE file_path NOT IN (
    SELECT file_path FROM filed GROUP BY file_path HAVING count(DISTINCT node_id) > 1)
GROUP BY file_path, node_id"""

# --- event log ------------------------------------------------------------

EVENT_LOG = """
log AS (
    SELECT event_id, k, event_type AS source, CAST(floor(value * 100) AS BIGINT) AS ms,
        CASE event_type WHEN 'click' THEN 'agent_tick' WHEN 'view' THEN 'agent_tick_metrics'
            WHEN 'error' THEN 'collector_failed' WHEN 'signup' THEN 'health_report_emitted'
            ELSE 'spool_rotated' END AS kind
    FROM k0
)"""
SQL["validate_events"] = f"""WITH {SIGNALS},{EVENT_LOG},
found AS (
    SELECT event_id, concat_ws('; ',
        CASE WHEN k = 98 THEN 'missing required key: agent_version' END,
        CASE WHEN k = 99 THEN 'unknown event_type: ''agent_nap''' END,
        CASE WHEN k = 97 THEN 'utc_now is not a timestamp: ''now''' END,
        CASE WHEN k = 96 THEN 'unknown mode: ''daemon''' END,
        CASE WHEN k = 94 AND source = 'signup' THEN 'seq must be an integer >= 1' END,
        CASE WHEN k = 95 AND source = 'click' AND ms < 100000 THEN 'tick_elapsed_ms must be an integer >= 0' END
    ) AS errors FROM log
)
SELECT event_id, errors = '' AS is_valid, errors FROM found"""
SQL["collector_failures"] = f"""WITH {SIGNALS},{EVENT_LOG}
SELECT ['identity', 'heartbeat', 'cpu', 'memory', 'disk', 'network'][k % 6 + 1] AS collector,
    ['OSError', 'ValueError', 'TimeoutError'][k % 3 + 1] AS error_type, count(*) AS failures
FROM log WHERE source = 'error' AND k <> 99 GROUP BY 1, 2"""
SQL["event_messages"] = f"""WITH {SIGNALS},{EVENT_LOG}
SELECT event_id, kind AS event_type, CASE WHEN source = 'error' THEN
    CASE WHEN 8 * (k + 1) > 200 THEN left(repeat('no data ', k + 1), 200) || '...[truncated ' ||
        (8 * (k + 1) - 200) || ' chars]' ELSE repeat('no data ', k + 1) END END AS message
FROM log WHERE k <> 99"""

# --- order over whole histories ------------------------------------------

SQL["assign_seq"] = f"""WITH {SIGNALS},
known AS (
    SELECT *, CASE WHEN boot_id IS DISTINCT FROM lag(boot_id) OVER (PARTITION BY node_id ORDER BY event_id)
        THEN 1 ELSE 0 END AS starts FROM s WHERE k % 13 <> 0
),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY node_id ORDER BY event_id) AS run FROM known)
SELECT event_id, node_id, row_number() OVER (PARTITION BY node_id, run ORDER BY event_id) AS assigned_seq
FROM runs
UNION ALL SELECT event_id, node_id, 1 FROM s WHERE k % 13 = 0"""

STEPS = f"""WITH {SIGNALS},
clocked AS (
    SELECT event_id, node_id, boot_id, CAST(greatest(1, (day(ts) - 1) * 24 + hour(ts)
        - (day(ts) - 1) // 10 * 10 * 24 + 1 - CASE WHEN k % 25 = 0 THEN 3 ELSE 0 END) AS BIGINT) AS seq
    FROM s
),
before AS (
    SELECT *, lag(boot_id) OVER w AS prev_boot, seq - lag(seq) OVER w AS change FROM clocked
    WINDOW w AS (PARTITION BY node_id ORDER BY event_id)
),
steps AS (
    SELECT *, CASE WHEN prev_boot IS NULL THEN 'first' WHEN prev_boot <> boot_id THEN 'restart'
        WHEN change = 1 THEN 'next' WHEN change > 1 THEN 'gap' WHEN change = 0 THEN 'duplicate'
        ELSE 'regression' END AS step FROM before
)"""
SQL["sequence_steps"] = f"""{STEPS}
SELECT event_id, node_id, step, CAST(CASE WHEN step = 'gap' THEN change - 1 ELSE 0 END AS BIGINT) AS missed
FROM steps"""
SQL["sequence_audit"] = f"""{STEPS}
SELECT node_id, count(*) AS reports, count(*) FILTER (WHERE step = 'gap') AS gaps,
    CAST(sum(CASE WHEN step = 'gap' THEN change - 1 ELSE 0 END) AS BIGINT) AS missed,
    count(*) FILTER (WHERE step = 'duplicate') AS duplicates,
    count(*) FILTER (WHERE step = 'regression') AS regressions,
    count(*) FILTER (WHERE step = 'restart') AS restarts FROM steps GROUP BY node_id"""

TICKS = f"""WITH {SIGNALS},
base AS (SELECT *, CAST(floor(value * 100000) AS BIGINT) AS elapsed FROM s),
ticks AS (
    SELECT *, elapsed > 3600000 AS overrun, greatest(0, 3600000 - elapsed) AS sleep_ms,
        coalesce(greatest(0, (epoch_us(ts) - lag(epoch_us(ts)) OVER (
            PARTITION BY node_id ORDER BY event_id) - 3600000000) // 1000), 0) AS drift
    FROM base
)"""
SQL["tick_drift"] = f"""{TICKS}
SELECT event_id, node_id, CAST(drift AS BIGINT) AS sleep_drift_ms, overrun, sleep_ms FROM ticks"""
SQL["tick_rollup"] = f"""{TICKS}
SELECT node_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
    strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f') AS window_end,
    count(*) AS ticks, count(*) FILTER (WHERE overrun) AS overruns,
    round(count(*) FILTER (WHERE overrun) / count(*), 6) AS overrun_rate,
    round(avg(elapsed), 3) AS mean_tick_ms,
    quantile_disc(elapsed, 0.5) AS p50_tick_ms, quantile_disc(elapsed, 0.95) AS p95_tick_ms,
    max(elapsed) AS max_tick_ms, CAST(max(drift) AS BIGINT) AS max_drift_ms
FROM ticks GROUP BY node_id, date_trunc('day', ts)"""
SQL["slowest_collector"] = f"""WITH {SIGNALS},
d AS (
    SELECT event_id, k, ['identity', 'heartbeat', 'cpu', 'memory', 'disk', 'network'] AS names,
        [k % 7, k % 5, k % 3, k % 11, k % 2, k % 13] AS ms FROM s
)
SELECT event_id, CAST(list_sum(ms) AS BIGINT) AS collector_total_ms,
    names[list_position(ms, list_max(ms))] AS slowest_collector_name,
    CAST(list_max(ms) AS BIGINT) AS slowest_collector_ms FROM d"""
SQL["sustained_alerts"] = f"""{BASE},
changes AS (
    SELECT *, CASE WHEN health IS DISTINCT FROM lag(health) OVER (PARTITION BY node_id ORDER BY event_id)
        THEN 1 ELSE 0 END AS starts FROM r
),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY node_id ORDER BY event_id) AS run FROM changes),
islands AS (
    SELECT node_id, health, run, min(ts) AS began, max(ts) AS finished, count(*) AS reports
    FROM runs GROUP BY node_id, health, run
)
SELECT node_id, health, strftime(began, '%Y-%m-%d %H:%M:%S.%f') AS started,
    strftime(finished, '%Y-%m-%d %H:%M:%S.%f') AS ended, reports,
    round((epoch_us(finished) - epoch_us(began)) / 1e6, 3) AS seconds
FROM islands
WHERE (health = 'UNHEALTHY' AND epoch_us(finished) - epoch_us(began) >= 300000000)
   OR (health = 'DEGRADED' AND epoch_us(finished) - epoch_us(began) >= 600000000)"""

# --- printed reports ------------------------------------------------------


def _load(column: str) -> str:
    return f"coalesce(printf('%.2f', {column}), 'n/a')"


def _size(column: str, unit: str) -> str:
    gib = f"({column} / 1073741824.0e0)"
    return f"CASE WHEN {gib} >= 10 THEN printf('%.0f', {gib}) ELSE printf('%.1f', {gib}) END || '{unit}'"


NL = "chr(10)"
TEXT_BLOCK = f"""concat_ws({NL}, '', 'node_id: ' || node_id, 'current_boot_id: ' || current_boot_id,
    'latest_health: ' || current_health, 'latest_seq: ' || latest_seq,
    'latest_emitted_at: ' || latest_emitted_at,
    'degraded_count_tail: ' || degraded_count_tail || ' / ' || reports_seen_tail,
    'unhealthy_count_tail: ' || unhealthy_count_tail || ' / ' || reports_seen_tail,
    'top_reasons_tail: ' || top_text,
    'current_reasons: ' || CASE WHEN len(reasons) > 0 AND current_health <> 'OK'
        THEN array_to_string(reasons, ', ') ELSE 'none' END,
    'max_cpu1_tail: ' || {_load('max_cpu1_tail')},
    'min_mem_available_pct_tail: ' || printf('%.2f', min_mem_available_pct_tail) || '%',
    'min_disk_free_pct_tail: ' || printf('%.2f', min_disk_free_pct_tail) || '%',
    'health_transitions_tail: ' || health_transitions_tail, text_lines)"""
PRETTY_BLOCK = f"""concat_ws({NL}, 'NODE ' || node_id, repeat('-', 5 + length(node_id)),
    'Health: ' || current_health, 'Seq: ' || latest_seq || '   Boot: ' || current_boot_id,
    'Emitted: ' || latest_emitted_at, '',
    'CPU load (1m/5m/15m): ' || {_load('loadavg_1m')} || ' / ' || {_load('loadavg_5m')} || ' / '
        || {_load('loadavg_15m')},
    'Disk free: ' || {_size('disk_free_bytes', ' GB')},
    'Memory available: ' || {_size('mem_available_bytes', ' GB')}, '',
    'Degraded (tail): ' || degraded_count_tail || ' / ' || reports_seen_tail,
    'Unhealthy (tail): ' || unhealthy_count_tail || ' / ' || reports_seen_tail,
    'Top reasons: ' || top_text, {NL} || 'Trends:' || {NL} || pretty_lines)"""
EXPLAIN_REASON = f"""'- ' || CASE x
    WHEN 'signal:cpu_high' THEN 'CPU load high (' || {_load('loadavg_1m')} || ' > 6.80)'
    WHEN 'signal:cpu_critical' THEN 'CPU load critical (' || {_load('loadavg_1m')} || ' > 10.00)'
    WHEN 'signal:disk_free_low' THEN 'Disk free low (10% threshold)'
    WHEN 'signal:disk_free_critical' THEN 'Disk free critical (5% threshold)'
    WHEN 'signal:mem_available_low' THEN 'Memory available low (15% threshold)'
    WHEN 'signal:mem_available_critical' THEN 'Memory available critical (8% threshold)'
    ELSE x END"""
EXPLAIN_BLOCK = f"""concat_ws({NL}, 'Node: ' || node_id, 'Status: ' || current_health, '', 'Reasons:',
    CASE WHEN len(reasons) = 0 THEN '- none'
         ELSE array_to_string(list_transform(reasons, lambda x: {EXPLAIN_REASON}), {NL}) END, '',
    'Tail Summary:', '- Degraded: ' || degraded_count_tail || ' / ' || reports_seen_tail,
    '- Unhealthy: ' || unhealthy_count_tail || ' / ' || reports_seen_tail,
    '- Health transitions: ' || health_transitions_tail,
    '- Max CPU load (1m): ' || printf('%.2f', max_cpu1_tail),
    '- Min memory available: ' || printf('%.2f', min_mem_available_pct_tail) || '%',
    '- Min disk free: ' || printf('%.2f', min_disk_free_pct_tail) || '%',
    '- Most frequent issue: ' || most, {NL} || 'Trends:' || {NL} || explain_lines)"""


def _body(block: str, report: int = 0) -> str:
    return f"SELECT {report} AS report, 1 AS part, node_id, {block} AS text FROM summary"


SQL["render_text"] = f"""{SUMMARY},{META}
SELECT 0 AS report, 0 AS part, '' AS node_id, 'nodes_seen_tail: ' || nodes_seen_tail || {NL} ||
    'nodes_emitted: ' || nodes_emitted AS text FROM meta
UNION ALL {_body(TEXT_BLOCK)}"""
SQL["render_pretty"] = f"{SUMMARY}\n{_body(PRETTY_BLOCK)}"
SQL["render_explain"] = f"{SUMMARY}\n{_body(EXPLAIN_BLOCK)}"
SQL["render_own"] = f"{SUMMARY}\n" + _body("node_id || ' ' || current_health")

_CELLS = {
    "NODE": "node_id",
    "HEALTH": "current_health",
    "CPU1": _load("loadavg_1m"),
    "MEM_FREE": _size("mem_available_bytes", "G"),
    "DISK_FREE": _size("disk_free_bytes", "G"),
    "DEG": "CAST(degraded_count_tail AS VARCHAR)",
    "UNH": "CAST(unhealthy_count_tail AS VARCHAR)",
    "TRNS": "CAST(health_transitions_tail AS VARCHAR)",
}
_WIDTHS = ", ".join(f"greatest({len(t)}, max(length({t}))) AS w_{t}" for t in _CELLS)
_HEAD = " || '  ' || ".join(f"rpad('{t}', CAST(w_{t} AS INTEGER), ' ')" for t in _CELLS)
_ROW = " || '  ' || ".join(f"rpad({t}, CAST(w_{t} AS INTEGER), ' ')" for t in _CELLS)
SQL["render_table"] = f"""{SUMMARY},
cells AS (SELECT node_id, {", ".join(f"{c} AS {t}" for t, c in _CELLS.items())} FROM summary),
widths AS (SELECT {_WIDTHS} FROM cells)
SELECT 0 AS report, 0 AS part, '' AS node_id, {_HEAD} AS text FROM widths
UNION ALL SELECT 0, 1, node_id, {_ROW} FROM cells, widths"""

JSON_NODE = f"""'{{"current_boot_id":"' || current_boot_id || '","current_health":"' || current_health ||
    '","current_reasons":[' || array_to_string(list_transform(reasons, lambda x: '"' || x || '"'), ',') ||
    '],"degraded_count_tail":' || degraded_count_tail || ',"health_transitions_tail":' ||
    health_transitions_tail || ',"latest_emitted_at":"' || latest_emitted_at || '","latest_seq":' ||
    latest_seq || ',"max_cpu1_tail":' || max_cpu1_tail || ',"min_disk_free_pct_tail":' ||
    min_disk_free_pct_tail || ',"min_mem_available_pct_tail":' || min_mem_available_pct_tail ||
    ',"node_id":"' || node_id || '","reports_seen_tail":' || reports_seen_tail ||
    ',"signal_trends":{{' || coalesce(trends_json, '') || '}},"top_reasons_tail":[' || top_json ||
    '],"unhealthy_count_tail":' || unhealthy_count_tail || '}}'"""


def _json_document(report: int) -> str:
    return f"""
SELECT {report} AS report, 0 AS part, '' AS node_id, '{{"meta":{{"computed_at":"' || computed_at ||
    '","nodes_emitted":' || nodes_emitted || ',"nodes_seen_tail":' || nodes_seen_tail ||
    ',"reports_invalid":0,"reports_parsed":' || reports_parsed ||
    ',"schema_version":"1","tail_n":200}},"nodes":[' AS text FROM meta
UNION ALL SELECT {report}, 1, node_id,
    CASE WHEN node_id = (SELECT min(node_id) FROM summary) THEN '' ELSE ',' END || {JSON_NODE} FROM summary
UNION ALL SELECT {report}, 2, '', ']}}'"""


SQL["summary_json"] = f"{SUMMARY},{META}{_json_document(0)}"
SQL["dual_output"] = f"{SUMMARY},{META}\n{_body(PRETTY_BLOCK)}\nUNION ALL {_json_document(1)}"

# --- spools on disk and live versions -------------------------------------

SQL["spool_read"] = f"""{PARSED}
SELECT node_id, health, count(*) AS reports, CAST(sum(mem_avail) AS BIGINT) AS memory
FROM parsed GROUP BY node_id, health"""

def spooled(rows: str, arrival: str, more: str = "") -> str:
    """Summary per node of the parsed lines in ``rows``, which arrived in the given order."""
    return f"""{PARSED},
{rows}
spooled AS (
    SELECT * REPLACE (coalesce(health, 'unknown') AS health),
        row_number() OVER (ORDER BY {arrival}) AS arrived FROM chosen
),
moves AS (
    SELECT node_id, CAST(sum(CASE WHEN before <> health THEN 1 ELSE 0 END) AS BIGINT) AS moves FROM (
        SELECT node_id, health, lag(health) OVER (PARTITION BY node_id ORDER BY arrived) AS before FROM spooled
    ) GROUP BY node_id
)
SELECT node_id, count(*) AS reports_seen_tail,
    count(*) FILTER (WHERE health = 'DEGRADED') AS degraded_count_tail,
    count(*) FILTER (WHERE health = 'UNHEALTHY') AS unhealthy_count_tail,
    any_value(moves) AS health_transitions_tail, max(emitted_at) AS latest_emitted_at,
    CAST(printf('%.2f', max(load1)) AS DOUBLE) AS max_cpu1_tail,
    CAST(printf('%.2f', min(mem_avail / mem_total * 1e2)) AS DOUBLE) AS min_mem_available_pct_tail,
    CAST(printf('%.2f', min(disk_free / disk_total * 1e2)) AS DOUBLE) AS min_disk_free_pct_tail{more}
FROM spooled JOIN moves USING (node_id) GROUP BY node_id"""


def last_lines(n: int) -> str:
    """The last ``n`` physical lines of every spool, and the parsed ones of them."""
    return f"""
ends AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY event_id DESC) AS back FROM lines)
    WHERE back <= {n}
),
chosen AS (SELECT parsed.* FROM parsed JOIN ends USING (event_id)),"""


SQL["spool_summary"] = spooled("chosen AS (SELECT * FROM parsed),", "spool, event_id")
SQL["spool_tail_summary"] = spooled(
    last_lines(50),
    "spool, event_id",
    """, 50 AS tail_n, (SELECT count(DISTINCT node_id) FROM lines) AS files_seen,
    (SELECT count(DISTINCT node_id) FROM chosen) AS nodes_seen_tail,
    (SELECT count(DISTINCT node_id) FROM chosen) AS nodes_emitted,
    (SELECT count(*) FROM chosen) AS reports_parsed,
    (SELECT count(*) FROM ends WHERE fault IN (2, 3, 14)) AS reports_invalid,
    (SELECT count(*) FROM ends WHERE fault IN (2, 3, 14)) AS reports_invalid_total""",
)
SQL["spool_appends"] = spooled(
    "chosen AS (SELECT * FROM parsed),",
    "list_position([2, 0, 3, 1], event_id % 4), event_id",
    ", max_by(seq, arrived) AS last_seq, max_by(health, arrived) AS last_health",
)
SQL["stream_growing_spool"] = spooled(
    """chosen AS (
    SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY spool ORDER BY event_id DESC) <= 200
),""",
    "spool, event_id",
)

# the text of every line, damage included
DAMAGED = f"""
whole AS (SELECT *, {REPORT_JSON} AS json FROM r),
written AS (
    SELECT event_id, node_id AS spool, CASE event_id % 40
        WHEN 1 THEN ' '
        WHEN 2 THEN left(json, length(json) - 3)
        WHEN 3 THEN '[1,2]'
        WHEN 4 THEN regexp_replace(json, ',"meta":.*,"timing"', ',"timing"')
        WHEN 5 THEN regexp_replace(json, '"seq":([0-9]+)', '"seq":"\\1"')
        WHEN 6 THEN regexp_replace(json, '"health":"[A-Z]+"', '"health":"BROKEN"')
        WHEN 7 THEN regexp_replace(json, '"seq":[0-9]+', '"seq":0')
        WHEN 8 THEN regexp_replace(json, '"node_id":"[^"]*"', '"node_id":""')
        WHEN 9 THEN regexp_replace(json, '"emitted_at":"[^"]*"', '"emitted_at":"yesterday"')
        WHEN 10 THEN replace(json, '"schema_version":"1"', '"schema_version":2')
        WHEN 11 THEN regexp_replace(json, '"reasons":\\[[^]]*\\]', '"reasons":"none"')
        WHEN 12 THEN regexp_replace(json, '"signals":\\{{[^}}]*\\}}', '"signals":[]')
        WHEN 13 THEN regexp_replace(replace(json, '"schema_version":"1"', '"schema_version":"2"'),
            '"health":"[A-Z]+"', '"health":null')
        WHEN 14 THEN json || ' x'
        WHEN 15 THEN '  ' || json || ' '
        WHEN 16 THEN regexp_replace(json, '"seq":[0-9]+', '"seq":3.9')
        WHEN 17 THEN regexp_replace(json, '"disk_free_bytes":([0-9]+)', '"disk_free_bytes":"\\1"')
        ELSE json END AS line FROM whole
)"""
SQL["tail_ranges"] = f"""{BASE},{DAMAGED}
SELECT spool, md5(line) AS line_md5 FROM written
QUALIFY row_number() OVER (PARTITION BY spool ORDER BY event_id DESC) <= 100"""

SQL["stream_evaluate"] = SQL["health_verdict"]
SQL["stream_sink"] = f"{BASE}\nSELECT event_id, node_id, health FROM r"
SQL["stream_reports"] = f"""{PARSED}
SELECT node_id, health, count(*) AS reports, CAST(sum(seq) AS BIGINT) AS seq_sum
FROM parsed GROUP BY node_id, health"""
SQL["stream_transitions"] = f"""{BASE}
SELECT node_id, event_id, prev_health, health FROM (
    SELECT *, lag(health) OVER (PARTITION BY node_id ORDER BY event_id) AS prev_health FROM r
) WHERE prev_health <> health"""
SQL["stream_seq_dedup"] = f"""WITH {SIGNALS}
SELECT DISTINCT node_id, boot_id, hour_no AS seq FROM s"""
SQL["stream_tick_windows"] = f"""{TICKS},
starts AS (
    SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts),
        time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS began FROM ticks
)
SELECT node_id, strftime(began, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
    strftime(began + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f') AS window_end, count(*) AS ticks,
    count(*) FILTER (WHERE overrun) AS overruns, round(avg(elapsed), 3) AS mean_tick_ms
FROM starts GROUP BY node_id, began"""
SQL["stream_outage_sessions"] = f"""{BASE},
bad AS (SELECT * FROM r WHERE health <> 'OK'),
starts AS (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY node_id ORDER BY ts) + INTERVAL 2 HOUR
        THEN 0 ELSE 1 END AS starts FROM bad
),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY node_id ORDER BY ts) AS run FROM starts)
SELECT node_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
    strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
    count(*) AS reports, count(*) FILTER (WHERE health = 'UNHEALTHY') AS unhealthy
FROM runs GROUP BY node_id, run"""


def all_sql() -> dict[str, str]:
    return dict(SQL)
