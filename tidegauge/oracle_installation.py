"""DuckDB SQL with the results of the queries that go through an installation."""

from __future__ import annotations

import re

from tidegauge.oracle import ALL, CHANGED, CLASS, LATEST, PARTS, SERIES, SIDES, STAGED, _rollups, _series, _with

NO_OVERRIDES = PARTS["own"].replace("FROM (SELECT DISTINCT", "FROM (SELECT * FROM (SELECT DISTINCT").replace("n FROM runs)", "n FROM runs) WHERE false)")


def _named(parts: dict[str, str], suffix: str, **renamed: str) -> dict[str, str]:
    """Parts of a query under other names."""
    names = {n: f"{n}_{suffix}" for n in parts} | renamed

    def rename(sql: str) -> str:
        return re.sub(r"(?<=FROM )(\w+)|(?<=JOIN )(\w+)", lambda m: names.get(m[0], m[0]), sql)

    return {names[n]: rename(sql) for n, sql in parts.items()}


def _drift(slug: str) -> dict[str, str]:
    """Drift of one source, as parts named after it."""
    parts = dict(SIDES)
    parts["sides"] = f"""SELECT agent_id, CASE WHEN at >= TIMESTAMP '2024-01-24' THEN 'current' ELSE 'baseline' END AS side, value, {CLASS} = 'good' OR at >= TIMESTAMP '2024-01-24' AS healthy
        FROM points JOIN defs USING (kpi_slug) WHERE kpi_slug = '{slug}' AND granularity = 'hour' AND at >= TIMESTAMP '2023-12-25' AND at < TIMESTAMP '2024-01-31'"""
    return _named(parts, slug)


#: The derived KPIs of the user's registry on the 31st.
DERIVED = {
    **_drift("latency_p95"), **_drift("sentiment"), **_drift("success_rate"),
    "means": """SELECT agent_id, avg(l.value) FILTER (WHERE l.slug = 'l' AND side = 'current') AS cl, avg(l.value) FILTER (WHERE l.slug = 'l' AND side = 'baseline') AS bl,
        avg(l.value) FILTER (WHERE l.slug = 's' AND side = 'current') AS cs, avg(l.value) FILTER (WHERE l.slug = 's' AND side = 'baseline') AS bs, count(*) FILTER (WHERE side = 'current') AS nc, count(*) FILTER (WHERE side = 'baseline') AS nb
        FROM (SELECT 'l' AS slug, * FROM sides_latency_p95 WHERE healthy UNION ALL SELECT 's', * FROM sides_success_rate WHERE healthy) l GROUP BY agent_id""",
    "worst": "SELECT agent_id, value, nc, nb FROM (SELECT * FROM psi_latency_p95 UNION ALL SELECT * FROM psi_sentiment) QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY value DESC) = 1",
    "derived": """SELECT agent_id, 'latency_drift' AS kpi_slug, value, nc, nb, 0.1 AS warning, 0.25 AS critical FROM psi_latency_p95
        UNION ALL SELECT agent_id, 'service_drift', value, nc, nb, 0.1, 0.25 FROM worst
        UNION ALL SELECT agent_id, 'service_moved', cl / bl - 1 + abs(cs - bs), nc, nb, 0.2, 0.5 FROM means WHERE cl IS NOT NULL AND bl IS NOT NULL AND cs IS NOT NULL AND bs IS NOT NULL""",
}

STAMP = "strftime(start_time, '%Y-%m-%dT%H:%M:%S.%fZ')"
PAYLOAD = f"""CAST(json_object('extra', json_object('metadata', json_object('cache_hit', n % 3 = 0, 'model', model, 'user', n % 150)), 'id', run_id, 'inputs', json_object('question', 'about ' || run_id, 'system', 'be "brief"'),
    'latency_ms', latency_ms, 'name', name, 'outputs', json_object('text', 'text of ' || run_id, 'tools', json_array('search', name)), 'prompt_tokens', prompt_tokens, 'start_time', {STAMP},
    'status', status, 'tags', json_array(name, 'k' || prompt_tokens)) AS VARCHAR)"""
#: What the grader says to each answer, by the length of its prompt.
GRADED = """SELECT *, CASE m WHEN 0 THEN 1.0 WHEN 6 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 END AS value FROM (
    SELECT source AS agent_id, CAST(doc_id AS VARCHAR) AS run_id, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS start_time, text, (length(text) + length('Grade the tone of this answer from A to D.') + 2) % 7 AS m FROM documents)"""


DAYS = [f"2024-01-{n}" for n in range(20, 32)]


def _daily() -> dict[str, str]:
    """Drift as of each of some days."""
    out = {}
    for day in DAYS:
        at = f"TIMESTAMP '{day}'"
        sides = SIDES["sides"].replace("TIMESTAMP '2024-01-24'", f"{at} - INTERVAL 7 DAY").replace("TIMESTAMP '2023-12-25'", f"{at} - INTERVAL 37 DAY").replace("TIMESTAMP '2024-01-31'", at)
        out |= _named(SIDES | {"sides": sides}, day[-2:])
    return out


#: Buckets of one width with what sketches keep exact; all the rest is near.
SKETCHED = """SELECT agent_id, kpi_slug, CAST(date_trunc('{width}', occurred_at) AS TIMESTAMP) AS bucket_start, count(*) AS count, round(sum(value), 6) + 0 AS sum, round(min(value), 6) + 0 AS min, round(max(value), 6) + 0 AS max,
    true AS p50_near, true AS p95_near, true AS p99_near, true AS distinct_near FROM ({seen}) GROUP BY ALL"""
SEEN = """SELECT * FROM obs UNION ALL SELECT agent_id, run_id, 'cache_hit_rate', CASE WHEN CAST(run_id AS BIGINT) % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 'extracted', start_time, start_time FROM runs"""


def oracle_change_feed() -> str:
    """Readings that differ from those of the 29th (the stream publishes what a comparison of snapshots finds)."""
    return _with(CHANGED, _rollups(["hour"]), STAGED)


def oracle_sql() -> dict[str, str]:
    out = {
        "payload_whole": _with(
            f"""SELECT agent_id, run_id, CASE WHEN status IS NULL THEN replace({PAYLOAD}, ',"status":null', '') ELSE {PAYLOAD} END AS payload, 'be "brief"' AS system, name AS tool, n % 150 AS user
            FROM (SELECT *, CAST(run_id AS BIGINT) AS n FROM runs)"""
        ),
        "kpi_added": _with(
            """SELECT agent_id, 'cache_hit_rate' AS kpi_slug, 'day' AS granularity, CAST(date_trunc('day', start_time) AS TIMESTAMP) AS at,
            round(avg(CASE WHEN CAST(run_id AS BIGINT) % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) + 0 AS value, count(*) AS sample_n, count(*) AS population_n FROM runs GROUP BY ALL"""
        ),
        "feedback_files": _with(
            """SELECT f.agent_id, f.run_id, CASE key WHEN 'kpi.toxicity' THEN 'toxicity' ELSE 'sentiment' END AS kpi_slug, round(score::DOUBLE, 6) + 0 AS value, r.start_time AS occurred_at, f.created_at AS computed_at
            FROM feedback f LEFT JOIN runs r ON r.agent_id = f.agent_id AND r.run_id = f.run_id"""
        ),
        "batches_logged": _with(
            """SELECT 'runs' AS stream, count(*) AS records, count(*) AS stored, 0::BIGINT AS faulty, CAST(count(status) + count(latency_ms) + count(*) AS BIGINT) AS observations, 0::BIGINT AS orphans, max(start_time) AS watermark FROM runs
            UNION ALL SELECT 'feedback', (SELECT count(*) FROM feedback), count(*), 0, count(*), (SELECT count(*) FROM feedback) - count(*), max(created_at) FROM matched"""
        ),
        "runs_reimported": _with(
            """SELECT agent_id, runs, latency, observations, observations AS distinct_observations FROM (SELECT agent_id, count(*) AS runs, CAST(sum(latency_ms) AS BIGINT) AS latency,
            count(status) + count(latency_ms) + count(*) AS observations FROM runs GROUP BY agent_id)"""
        ),
        "cursor_table": _with(
            """SELECT agent_id AS workspace_id, 'runs' AS stream, max(start_time) AS watermark, NULL::VARCHAR AS last_error, 0::INTEGER AS consecutive_failures FROM runs GROUP BY agent_id
            UNION ALL SELECT agent_id, 'feedback', max(created_at), 'ValueError: down', 1 FROM matched GROUP BY agent_id"""
        ),
        "poll_due": _with("SELECT r.agent_id, run_id, start_time FROM runs r JOIN (SELECT agent_id, max(start_time) AS last FROM runs GROUP BY agent_id) l ON l.agent_id = r.agent_id WHERE start_time >= to_timestamp(floor(epoch(last)) - 300) AT TIME ZONE 'UTC'"),
        "orphans_streamed": _with(
            """SELECT agent_id, run_id, key, round(score::DOUBLE, 6) + 0 AS score, created_at, start_time FROM matched
            UNION ALL SELECT agent_id, run_id, key, round(score::DOUBLE, 6) + 0, created_at, NULL FROM feedback f
            WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.agent_id = f.agent_id AND r.run_id = f.run_id) AND created_at < (SELECT max(start_time) - INTERVAL 2 DAY FROM runs)"""
        ),
        "changes_streamed": oracle_change_feed(),
        "drift_daily": _with("\nUNION ALL\n".join(f"SELECT agent_id, kpi_slug, TIMESTAMP '{day}' AS as_of, round(value, 6) + 0 AS value, nc, nb FROM psi_{day[-2:]}" for day in DAYS), _rollups(["hour"]), _daily()),
        "sketched_rollup": _with(SKETCHED.format(width="month", seen=SEEN)),
        "sketches_streamed": _with("SELECT * FROM (" + SKETCHED.format(width="day", seen=SEEN) + ") WHERE bucket_start + INTERVAL 1 DAY <= (SELECT max(start_time) - INTERVAL 6 HOUR FROM runs)"),
        "replays_dropped": _with("SELECT CASE agent_id WHEN 'agent-4' THEN 1 ELSE 0 END::INTEGER AS step, agent_id, count(*) AS runs FROM runs GROUP BY ALL"),
        "derived_registry": _with(
            """SELECT agent_id, kpi_slug, TIMESTAMP '2024-01-31' AS bucket_start, 1::BIGINT AS count, round(value, 6) + 0 AS sum, round(value, 6) + 0 AS p95, nc AS sample_n, nb AS population_n, round(value, 6) + 0 AS read_value,
            CASE WHEN value <= warning THEN 'good' WHEN value <= critical THEN 'warning' ELSE 'critical' END AS status FROM derived""",
            _rollups(["hour"]), DERIVED,
        ),
        "overview_stored": _with("SELECT agent_id, kpi_slug, granularity, at, round(value, 6) + 0 AS value, sample_n, population_n, raw_status AS status FROM judged", _rollups(ALL), {"own": NO_OVERRIDES} | LATEST),
        "series_stored": _with(SERIES, _rollups(ALL), _series([259200])).replace("TIMESTAMP '2024-01-31'", "TIMESTAMP '2024-01-23'"),
        "judge_backfill": f"""WITH graded AS ({GRADED}), due AS (SELECT *, start_time >= TIMESTAMP '2024-01-01 01:00:00' AND start_time < TIMESTAMP '2024-01-15' AND value IS NOT NULL AS judged FROM graded WHERE text IS NOT NULL)
            SELECT agent_id, run_id, 'tone' AS kpi_slug, CASE WHEN judged THEN value::DOUBLE END AS value, CASE WHEN judged THEN 'judged' ELSE 'unjudged' END AS source, CASE WHEN judged THEN 'grader' END AS judge_model, start_time AS occurred_at FROM due""",
    }
    return {name: re.sub(r"\bat\b", '"at"', sql) for name, sql in out.items()}  # a keyword there
