"""DuckDB SQL with the results of the registered KPI queries."""

from __future__ import annotations

import re

from tidegauge.functions.buckets import GRAINS, RANGES
from tidegauge.plans.kpis import LIMITS, SHIPPED


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)


def _definitions() -> str:
    rows = []
    for k in SHIPPED:
        limits = [k.thresholds.get(f) for f in LIMITS]
        rows.append("(" + ", ".join(map(_literal, (k.slug, k.kind, k.direction, k.aggregation, *limits, k.min_sample_n, k.health, *(k.range or (None, None)), k.feedback_key))) + ")")
    names = "kpi_slug, kind, direction, aggregation, " + ", ".join(LIMITS) + ", min_sample_n, health, range_lo, range_hi, feedback_key"
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t({names})"


AGENT = "'agent-' || CAST(user_id % 5 AS VARCHAR)"
LOST = "CAST(CASE WHEN event_id % 97 = 0 THEN event_id + 1000000000 ELSE event_id END AS VARCHAR)"

#: Named parts, in an order in which each may use those before it.
PARTS = {
    "defs": _definitions(),
    "runs": f"""SELECT CAST(event_id AS VARCHAR) AS run_id, {AGENT} AS agent_id, event_type AS name, ts AS start_time,
        CAST(round(value * 100) AS INTEGER) AS latency_ms,
        CASE WHEN event_type = 'error' THEN 'error' WHEN event_type <> 'signup' THEN 'success' END AS status,
        CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'm-1' ELSE 'm-2' END AS model,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS prompt_tokens, CAST(value / 1000 AS DECIMAL(14, 6)) AS cost_usd, props AS payload
        FROM events""",
    "feedback": f"""SELECT {LOST} AS run_id, {AGENT} AS agent_id, 'kpi.polarity' AS key, (event_id * 7919 % 2001 - 1000) / 1001.0 AS score, ts + INTERVAL 45 SECOND AS created_at FROM events
        UNION ALL
        SELECT {LOST}, {AGENT}, 'kpi.toxicity', CAST(toxic AS DOUBLE), ts + INTERVAL 45 SECOND FROM events JOIN labels ON doc_id = event_id""",
    "matched": "SELECT f.*, r.start_time FROM feedback f JOIN runs r ON f.agent_id = r.agent_id AND f.run_id = r.run_id",
    "extracted": """SELECT agent_id, run_id, 'success_rate' AS kpi_slug, CASE status WHEN 'success' THEN 1.0 ELSE 0.0 END::DOUBLE AS value, 'extracted' AS source, start_time AS occurred_at, start_time AS computed_at FROM runs WHERE status IS NOT NULL
        UNION ALL
        SELECT agent_id, run_id, 'latency_p95', latency_ms::DOUBLE, 'extracted', start_time, start_time FROM runs WHERE latency_ms IS NOT NULL""",
    "obs": """SELECT * FROM extracted
        UNION ALL
        SELECT agent_id, run_id, kpi_slug, score::DOUBLE, 'imported', start_time, created_at FROM matched JOIN defs ON key = feedback_key""",
    "grains": "SELECT * FROM (VALUES " + ", ".join(f"('{g}', {s})" for g, s in GRAINS.items()) + ") t(granularity, secs)",
    "own": """SELECT agent_id, 'success_rate' AS kpi_slug, 0.8 - n / 100 AS warning, 0.7 - n / 100 AS critical, NULL::DOUBLE AS good_lo, NULL::DOUBLE AS good_hi, NULL::DOUBLE AS warn_lo, NULL::DOUBLE AS warn_hi
        FROM (SELECT DISTINCT agent_id, CAST(substr(agent_id, 7) AS DOUBLE) AS n FROM runs)
        UNION ALL SELECT agent_id, 'latency_p95', 20000.0, n * 10000.0, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT agent_id, CAST(substr(agent_id, 7) AS DOUBLE) AS n FROM runs) WHERE n >= 2
        UNION ALL SELECT agent_id, 'sentiment', NULL, NULL, -0.05, 0.05, n - 0.5, 0.5 FROM (SELECT DISTINCT agent_id, CAST(substr(agent_id, 7) AS DOUBLE) AS n FROM runs) WHERE n <= 1""",
}


def _rollups(grains: list[str], obs: str = "obs", runs: str = "runs") -> str:
    one = """SELECT s.*, coalesce(p.n, 0) AS population_n FROM (
        SELECT agent_id, kpi_slug, '{g}' AS granularity, CAST(date_trunc('{g}', occurred_at) AS TIMESTAMP) AS bucket_start, count(*) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max,
               quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, count(DISTINCT value) AS distinct_count, count(*) AS sample_n
        FROM {obs} GROUP BY ALL) s
        LEFT JOIN (SELECT agent_id, CAST(date_trunc('{g}', start_time) AS TIMESTAMP) AS b, count(*) AS n FROM {runs} GROUP BY ALL) p ON p.agent_id = s.agent_id AND p.b = s.bucket_start"""
    return "\nUNION ALL\n".join(one.format(g=g, obs=obs, runs=runs) for g in grains)


VALUE = """CASE WHEN aggregation IN ('mean', 'rate') THEN sum / nullif(count, 0) WHEN aggregation = 'p50' THEN p50 WHEN aggregation = 'p95' THEN p95 WHEN aggregation = 'p99' THEN p99
    WHEN aggregation = 'count' THEN count::DOUBLE WHEN aggregation = 'count_distinct' THEN distinct_count::DOUBLE END"""
CLASS = """CASE direction WHEN 'higher_is_better' THEN CASE WHEN value >= warning THEN 'good' WHEN value >= critical THEN 'warning' ELSE 'critical' END
    WHEN 'lower_is_better' THEN CASE WHEN value <= warning THEN 'good' WHEN value <= critical THEN 'warning' ELSE 'critical' END
    ELSE CASE WHEN value BETWEEN good_lo AND good_hi THEN 'good' WHEN value BETWEEN warn_lo AND warn_hi THEN 'warning' ELSE 'critical' END END"""
STATE = f"CASE WHEN value IS NULL OR sample_n < min_sample_n THEN 'unknown' ELSE {CLASS} END"
SEVERITY = "CASE {} WHEN 'good' THEN 0 WHEN 'unknown' THEN 1 WHEN 'warning' THEN 2 WHEN 'critical' THEN 3 END"
SUM_STATS = "round(sum, 6) + 0 AS sum, round(min, 6) + 0 AS min, round(max, 6) + 0 AS max, round(p50, 6) + 0 AS p50, round(p95, 6) + 0 AS p95, round(p99, 6) + 0 AS p99"
BUCKETS = f"SELECT agent_id, kpi_slug, granularity, bucket_start, count, {SUM_STATS}, distinct_count, sample_n, population_n FROM rollups"
POINTS = f"SELECT agent_id, kpi_slug, granularity, bucket_start AS at, {VALUE} AS value, sample_n, population_n FROM rollups JOIN defs USING (kpi_slug) WHERE count > 0"
ALL = list(GRAINS)


def _with(query: str, rollups: str | None = None, more: dict[str, str] | None = None) -> str:
    parts = dict(PARTS)
    if rollups:
        parts["rollups"] = rollups
        parts["points"] = f"SELECT * FROM ({POINTS}) WHERE value IS NOT NULL"
    parts |= more or {}
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items()) + "\n" + query


def _series(ranges: list[int], max_points: int = 300, grain: str | None = None) -> dict[str, str]:
    now = "TIMESTAMP '2024-01-31'"
    values = ", ".join(f"({s})" for s in ranges)
    choice = f"'{grain}'" if grain else f"CASE WHEN span / 60 <= {max_points} THEN 'minute' WHEN span / 3600 <= {max_points} THEN 'hour' ELSE 'day' END"
    return {
        "asked": f"SELECT {now} - to_seconds(span) AS from_ts, {now} AS to_ts, span, {choice} AS granularity, {max_points} AS max_points FROM (VALUES {values}) t(span)",
        "sized": "SELECT a.*, secs, span // secs > max_points AS downsampled, CAST(ceil(greatest(span // max_points, secs) / secs) * secs AS BIGINT) AS width FROM asked a JOIN grains USING (granularity)",
        "cut": """SELECT r.*, aggregation, from_ts, to_ts, max_points, downsampled, CASE WHEN downsampled THEN to_timestamp(floor(epoch(bucket_start) / width) * width) AT TIME ZONE 'UTC' ELSE bucket_start END AS at
            FROM rollups r JOIN sized USING (granularity) JOIN defs USING (kpi_slug) WHERE count > 0 AND kind <> 'derived' AND bucket_start >= from_ts AND bucket_start < to_ts""",
        "grouped": """SELECT agent_id, kpi_slug, granularity, from_ts, to_ts, max_points, downsampled, at, aggregation, CAST(sum(sample_n) AS BIGINT) AS sample_n, CAST(sum(population_n) AS BIGINT) AS population_n,
            sum(count) AS count, sum(sum) AS sum, sum(distinct_count) AS distinct_count, max(p50) AS p50, max(p95) AS p95, max(p99) AS p99 FROM cut GROUP BY ALL""",
    }


SERIES = f"SELECT agent_id, kpi_slug, granularity, from_ts, to_ts, max_points, downsampled, at, round({VALUE}, 6) + 0 AS value, sample_n, population_n FROM grouped"

LATEST = {
    "every": """SELECT a.agent_id, d.kpi_slug, d.kind, d.direction, d.aggregation, d.min_sample_n, d.health, o.kpi_slug IS NOT NULL AS overridden,
        """
    + ", ".join(f"CASE WHEN o.kpi_slug IS NOT NULL THEN o.{f} ELSE d.{f} END AS {f}" for f in LIMITS)
    + """ FROM (SELECT DISTINCT agent_id FROM runs) a CROSS JOIN defs d LEFT JOIN own o ON o.agent_id = a.agent_id AND o.kpi_slug = d.kpi_slug""",
    "heads": "SELECT * FROM rollups WHERE count > 0 QUALIFY row_number() OVER (PARTITION BY agent_id, kpi_slug, granularity ORDER BY bucket_start DESC) = 1",
    "valued": f"SELECT h.agent_id, h.kpi_slug, h.granularity, h.bucket_start AS at, {VALUE} AS value, h.sample_n, h.population_n, e.min_sample_n FROM heads h JOIN every e ON e.agent_id = h.agent_id AND e.kpi_slug = h.kpi_slug WHERE e.kind <> 'derived' OR h.granularity = 'day'",
    "chosen": "SELECT * EXCLUDE (min_sample_n) FROM valued JOIN grains USING (granularity) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY agent_id, kpi_slug ORDER BY sample_n < min_sample_n, secs) = 1",
    "readings": """SELECT e.*, c.granularity, c.at, c.value, coalesce(c.sample_n, 0) AS sample_n, coalesce(c.population_n, 0) AS population_n
        FROM every e LEFT JOIN chosen c ON c.agent_id = e.agent_id AND c.kpi_slug = e.kpi_slug""",
    "judged": f"SELECT *, {STATE} AS raw_status FROM readings",
    "summary": f"""SELECT agent_id, CASE max(CASE WHEN health <> 'none' THEN {SEVERITY.format('raw_status')} END) WHEN 0 THEN 'good' WHEN 2 THEN 'warning' WHEN 3 THEN 'critical' ELSE 'unknown' END AS status,
        count(*) FILTER (WHERE raw_status = 'good') AS good, count(*) FILTER (WHERE raw_status = 'unknown') AS unknown, count(*) FILTER (WHERE raw_status = 'warning') AS warning,
        count(*) FILTER (WHERE raw_status = 'critical') AS critical, count(*) FILTER (WHERE health <> 'none') AS contributing FROM judged GROUP BY agent_id""",
}
#: Hysteresis as the fold it stands for: one recursion step per bucket.
SETTLED = {
    "recent": f"""SELECT agent_id, kpi_slug, i, n, {STATE} AS state FROM (
        SELECT r.agent_id, r.kpi_slug, r.sample_n, j.min_sample_n, j.direction, {', '.join('j.' + f for f in LIMITS)}, {VALUE.replace('aggregation', 'j.aggregation')} AS value,
               row_number() OVER (PARTITION BY r.agent_id, r.kpi_slug ORDER BY r.bucket_start) AS i, count(*) OVER (PARTITION BY r.agent_id, r.kpi_slug) AS n
        FROM (SELECT x.* FROM rollups x JOIN chosen c ON c.agent_id = x.agent_id AND c.kpi_slug = x.kpi_slug AND c.granularity = x.granularity WHERE count > 0
              QUALIFY row_number() OVER (PARTITION BY x.agent_id, x.kpi_slug ORDER BY x.bucket_start DESC) <= 12) r
        JOIN every j ON j.agent_id = r.agent_id AND j.kpi_slug = r.kpi_slug)""",
    "fold": """SELECT agent_id, kpi_slug, i, n, state AS settled, NULL::VARCHAR AS s1, state AS s0 FROM recent WHERE i = 1
        UNION ALL
        SELECT r.agent_id, r.kpi_slug, r.i, r.n, CASE WHEN f.s1 = r.state AND f.s0 = r.state THEN r.state ELSE f.settled END, f.s0, r.state
        FROM fold f JOIN recent r ON r.agent_id = f.agent_id AND r.kpi_slug = f.kpi_slug AND r.i = f.i + 1""",
}

SIDES = {
    "sides": f"""SELECT agent_id, CASE WHEN at >= TIMESTAMP '2024-01-24' THEN 'current' ELSE 'baseline' END AS side, value, value <= 5000 OR at >= TIMESTAMP '2024-01-24' AS healthy
        FROM points WHERE kpi_slug = 'latency_p95' AND granularity = 'hour' AND at >= TIMESTAMP '2023-12-25' AND at < TIMESTAMP '2024-01-31'""",
    "sizes": "SELECT agent_id, count(*) FILTER (WHERE side = 'current') AS nc, count(*) FILTER (WHERE side = 'baseline') AS nb, min(value) FILTER (WHERE side = 'baseline') AS lo, max(value) FILTER (WHERE side = 'baseline') AS hi FROM sides WHERE healthy GROUP BY agent_id",
    "binned": "SELECT *, greatest(2, least(10, least(nc, nb) // 20)) AS bins FROM sizes WHERE nc >= 30 AND nb >= 30 AND lo < hi",
    "sorted": "SELECT agent_id, value, row_number() OVER (PARTITION BY agent_id ORDER BY value) - 1 AS pos FROM sides WHERE healthy AND side = 'baseline'",
    "edges": "SELECT b.agent_id, s.value AS edge FROM binned b, range(1, 10) g(i) JOIN sorted s ON s.agent_id = b.agent_id AND s.pos = greatest(0, least(b.nb - 1, CAST(round(g.i / b.bins * b.nb) AS BIGINT) - 1)) WHERE g.i < b.bins",
    "placed": "SELECT s.agent_id, s.side, (SELECT count(*) FROM edges e WHERE e.agent_id = s.agent_id AND e.edge < s.value) AS bin FROM sides s JOIN binned USING (agent_id) WHERE healthy",
    "shares": """SELECT b.agent_id, g.i AS bin, b.nc, b.nb, b.bins,
        greatest(coalesce((SELECT count(*) FROM placed p WHERE p.agent_id = b.agent_id AND p.side = 'current' AND p.bin = g.i), 0) / b.nc, 1e-6) AS a,
        greatest(coalesce((SELECT count(*) FROM placed p WHERE p.agent_id = b.agent_id AND p.side = 'baseline' AND p.bin = g.i), 0) / b.nb, 1e-6) AS e
        FROM binned b, range(0, 10) g(i) WHERE g.i < b.bins""",
    "psi": "SELECT agent_id, 'latency_drift' AS kpi_slug, sum((a - e) * ln(a / e)) AS value, nc, nb, bins FROM shares GROUP BY agent_id, nc, nb, bins",
}


def _lookback(lo: str, hi: str) -> dict[str, str]:
    return {
        "near_obs": f"SELECT * FROM obs WHERE occurred_at >= TIMESTAMP '{lo}' AND occurred_at < TIMESTAMP '{hi}'",
        "near_runs": f"SELECT * FROM runs WHERE start_time >= TIMESTAMP '{lo}' AND start_time < TIMESTAMP '{hi}'",
        "rollups": _rollups(["hour"], "near_obs", "near_runs"),
    }


#: Overrides of the mapping that may not be stored.
BAD = """coalesce((direction = 'higher_is_better' AND own.critical >= own.warning) OR (direction = 'lower_is_better' AND own.warning >= own.critical), false)
    OR coalesce(own.good_lo > own.good_hi OR own.warn_lo > own.warn_hi OR own.warn_lo > own.good_lo OR own.good_hi > own.warn_hi, false)"""
OBS = "agent_id, run_id, kpi_slug, round(value, 6) + 0 AS value, source, 1 AS kpi_version, occurred_at"
#: Given replies, and the number each begins with.
REPLIES = r"""SELECT *, CASE WHEN text IS NULL THEN 'skip' WHEN value IS NULL THEN 'failed' ELSE 'ok' END AS outcome FROM (
    SELECT source AS agent_id, CAST(doc_id AS VARCHAR) AS run_id, text, CASE WHEN number BETWEEN 0 AND 1 THEN number END AS value FROM (
        SELECT *, TRY_CAST(regexp_extract(trim(reply), '^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)', 1) AS DOUBLE) AS number FROM (
            SELECT d.*, CASE WHEN toxic IS NOT NULL THEN toxic || ' because of: ' || text ELSE text END AS reply FROM documents d LEFT JOIN labels USING (doc_id))))"""
FLAT = "WITH runs AS (" + PARTS["runs"] + """)
    SELECT run_id, agent_id, 't-' || CAST(n % 100 AS VARCHAR) AS trace_id, CASE WHEN n % 4 = 0 THEN CAST(n - 1 AS VARCHAR) END AS parent_run_id, name, CASE WHEN name = 'error' THEN 'tool' ELSE 'chain' END AS run_type,
        start_time, CASE WHEN name NOT IN ('error', 'signup') THEN start_time + to_milliseconds(latency_ms) END AS end_time, CASE WHEN name <> 'signup' THEN latency_ms END AS latency_ms, status,
        CASE WHEN status = 'error' THEN 'failed with ' || prompt_tokens END AS error, model, prompt_tokens, prompt_tokens * 2 AS completion_tokens, round(CAST(cost_usd AS DOUBLE), 6) AS cost_usd,
        run_id AS payload_id, model AS payload_model
    FROM (SELECT *, CAST(run_id AS BIGINT) AS n FROM runs)"""
STAGED = {
    "published": f"""SELECT w, d.agent_id, d.kpi_slug, c.at, c.value, CASE WHEN c.value IS NULL OR c.sample_n < d.min_sample_n THEN 'unknown' ELSE {CLASS.replace('value', 'c.value')} END AS status
        FROM (SELECT a.agent_id, x.*, w FROM (SELECT DISTINCT agent_id FROM runs) a CROSS JOIN defs x CROSS JOIN (VALUES ('now'), ('then')) v(w)) d
        LEFT JOIN (SELECT 'now' AS w, * FROM points UNION ALL SELECT 'then', * FROM points WHERE at < TIMESTAMP '2024-01-29') c
          ON c.w = d.w AND c.agent_id = d.agent_id AND c.kpi_slug = d.kpi_slug AND d.kind <> 'derived'
        QUALIFY row_number() OVER (PARTITION BY d.w, d.agent_id, d.kpi_slug ORDER BY c.at DESC NULLS LAST) = 1""".replace("SELECT w, d", "SELECT d.w, d"),
}


CHANGED = """SELECT n.agent_id, n.kpi_slug, n.at, round(n.value, 6) + 0 AS value, n.status FROM published n JOIN published t ON t.w = 'then' AND n.w = 'now' AND t.agent_id = n.agent_id AND t.kpi_slug = n.kpi_slug
            WHERE n.at IS DISTINCT FROM t.at OR n.value IS DISTINCT FROM t.value OR n.status <> t.status"""


def oracle_sql() -> dict[str, str]:
    out = {
        "runs_flat": FLAT,
        "pages_read": FLAT,
        "pages_streamed": FLAT,
        "observation_faults": _with(
            """SELECT agent_id, run_id, CASE n WHEN 3 THEN 'kpi_slug,source' WHEN 4 THEN 'kpi_slug' ELSE 'value' END AS faults
            FROM (SELECT *, CAST(run_id AS BIGINT) % 10 AS n FROM extracted) WHERE n BETWEEN 1 AND 4"""
        ),
        "feedback_retry": _with("SELECT agent_id, run_id, key, round(score, 6) + 0 AS score, created_at, start_time FROM matched WHERE CAST(run_id AS BIGINT) % 2 <> 0"),
        "judge_prompts": "SELECT CAST(doc_id AS VARCHAR) AS run_id, 'Rate the toxicity of this answer from 0 to 1. Reply with the number only.' || chr(10) || chr(10) || text AS prompt FROM documents WHERE text IS NOT NULL",
        "series_derived": _with("SELECT agent_id, kpi_slug, 'day' AS granularity, TIMESTAMP '2024-01-31' AS at, round(value, 6) + 0 AS value, nc AS sample_n, nb AS population_n FROM psi", _rollups(["hour"]), SIDES),
        "week_before": _with("SELECT agent_id, kpi_slug, at, round(value, 6) + 0 AS value, sample_n, population_n FROM points WHERE at >= TIMESTAMP '2024-01-17' AND at < TIMESTAMP '2024-01-24'", _rollups(["day"])),
        "runs_upsert": f"""SELECT agent_id, run_id, 'old-' || trace_id AS trace_id, parent_run_id, upper(name) AS name, run_type, start_time, end_time, latency_ms, CASE WHEN name <> 'signup' THEN status END AS status,
            CASE WHEN name <> 'signup' THEN error END AS error, CASE WHEN name = 'signup' THEN 'm-0' ELSE model END AS model, prompt_tokens, CASE WHEN name <> 'signup' THEN completion_tokens END AS completion_tokens,
            cost_usd, TIMESTAMP '2024-02-01' AS inserted_at, CASE WHEN name = 'signup' THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-02-02' END AS updated_at FROM ({FLAT})""",
        "run_quarantine": _with("SELECT run_id, agent_id, 'latency_ms' AS faults FROM runs WHERE latency_ms < 100"),
        "observations_extracted": _with(f"SELECT {OBS} FROM extracted"),
        "feedback_matched": _with("SELECT agent_id, run_id, key, round(score, 6) + 0 AS score, created_at, start_time FROM matched"),
        "feedback_orphans": _with("SELECT agent_id, run_id, key, round(score, 6) + 0 AS score, created_at FROM feedback f WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.agent_id = f.agent_id AND r.run_id = f.run_id)"),
        "observations_all": _with(
            f"""SELECT {OBS.replace('source', chr(39) + 'imported' + chr(39) + ' AS source')}, computed_at FROM obs
            UNION ALL SELECT agent_id, run_id, 'toxicity', round(value, 6) + 0, 'imported', 1, TIMESTAMP '2024-01-01' + to_seconds(CAST(run_id AS BIGINT) * 60), TIMESTAMP '2024-01-01' + to_seconds(CAST(run_id AS BIGINT) * 60)
            FROM ({REPLIES}) WHERE outcome = 'ok'"""
        ),
        "rollup_lookback": _with(BUCKETS, more=_lookback("2024-01-30 06:00:00", "2024-01-30 13:00:00")),
        "rollup_touched": _with(
            BUCKETS,
            more={
                "late": "SELECT DISTINCT agent_id, kpi_slug, date_trunc('hour', occurred_at) AS b FROM obs WHERE source = 'imported' AND computed_at >= TIMESTAMP '2024-01-20'",
                "near_obs": "SELECT obs.* FROM obs JOIN late ON late.agent_id = obs.agent_id AND late.kpi_slug = obs.kpi_slug AND date_trunc('hour', occurred_at) = b",
                "rollups": _rollups(["hour"], "near_obs"),
            },
        ),
        "value_by_aggregation": _with("SELECT agent_id, kpi_slug, granularity, at, round(value, 6) + 0 AS value, sample_n, population_n FROM points", _rollups(["hour"])),
        "series_exact": _with(SERIES, _rollups(ALL), _series([RANGES["7d"]])),
        "series_ranges": _with(SERIES, _rollups(ALL), _series(list(RANGES.values()))),
        "series_downsampled": _with(SERIES, _rollups(["hour"]), _series([RANGES["30d"]], 100, "hour")),
        "super_buckets": _with(
            f"""SELECT agent_id, kpi_slug, granularity, at, round({VALUE}, 6) + 0 AS value, sample_n, population_n FROM (
            SELECT agent_id, kpi_slug, granularity, aggregation, to_timestamp(floor(epoch(bucket_start) / 21600) * 21600) AT TIME ZONE 'UTC' AS at, sum(count) AS count, sum(sum) AS sum, sum(distinct_count) AS distinct_count,
                   max(p50) AS p50, max(p95) AS p95, max(p99) AS p99, CAST(sum(sample_n) AS BIGINT) AS sample_n, CAST(sum(population_n) AS BIGINT) AS population_n
            FROM rollups JOIN defs USING (kpi_slug) WHERE count > 0 GROUP BY ALL)""",
            _rollups(["hour"]),
        ),
        "granularity_choice": """WITH spans AS (SELECT user_id, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS span, 50 + user_id * 10 AS points FROM events GROUP BY user_id),
            chosen AS (SELECT *, CASE WHEN span / 60 <= points THEN 'minute' WHEN span / 3600 <= points THEN 'hour' ELSE 'day' END AS granularity FROM spans),
            sized AS (SELECT *, CASE granularity WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 ELSE 86400 END AS secs FROM chosen)
            SELECT user_id, granularity, span // secs AS stored, CAST(ceil(greatest(span // points, secs) / secs) * secs AS BIGINT) AS width FROM sized""",
        "latest_reading": _with("SELECT agent_id, kpi_slug, granularity, at, round(value, 6) + 0 AS value, sample_n, population_n, raw_status, overridden FROM judged", _rollups(ALL), LATEST),
        "status_eval": _with(
            f"""SELECT agent_id, kpi_slug, at, round(value, 6) + 0 AS value, class, status, {SEVERITY.format('status')} AS severity
            FROM (SELECT agent_id, kpi_slug, at, value, {CLASS} AS class, {STATE} AS status FROM points JOIN defs USING (kpi_slug))""",
            _rollups(["hour"]),
        ),
        "hysteresis": _with(
            "SELECT j.agent_id, j.kpi_slug, j.granularity, j.at, j.raw_status, coalesce(f.settled, j.raw_status) AS status FROM judged j LEFT JOIN fold f ON f.agent_id = j.agent_id AND f.kpi_slug = j.kpi_slug AND f.i = f.n", _rollups(ALL), LATEST | SETTLED
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "agent_summary": _with("SELECT * FROM summary", _rollups(ALL), LATEST),
        "overview_totals": _with("SELECT status, count(*) AS agents FROM summary GROUP BY status", _rollups(ALL), LATEST),
        "annotations": _with(
            """SELECT agent_id, NULL::VARCHAR AS kpi_slug, 'model' AS kind, model AS label, min(start_time) AS at FROM runs WHERE start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-31' GROUP BY agent_id, model
            QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY min(start_time)) > 1
            UNION ALL
            SELECT agent_id, kpi_slug, 'version', '2', min(occurred_at) FROM extracted WHERE occurred_at >= TIMESTAMP '2024-01-20' AND occurred_at < TIMESTAMP '2024-01-31' GROUP BY agent_id, kpi_slug"""
        ),
        "trend_wow": _with(
            """SELECT kpi_slug, agent_id, granularity, at, round(value, 6) + 0 AS value, round(previous, 6) + 0 AS previous, round(delta, 6) + 0 AS delta,
            CASE WHEN direction = 'target_band' OR delta IS NULL OR delta = 0 THEN 'neutral' WHEN (direction = 'higher_is_better') = (delta > 0) THEN 'better' ELSE 'worse' END AS meaning
            FROM (SELECT n.*, direction, b.value AS previous, CASE WHEN b.value <> 0 THEN (n.value - b.value) / abs(b.value) * 100 END AS delta
                  FROM points n JOIN points b ON b.agent_id = n.agent_id AND b.kpi_slug = n.kpi_slug AND b.at + INTERVAL 7 DAY = n.at JOIN defs ON defs.kpi_slug = n.kpi_slug)""",
            _rollups(["day"]),
        ),
        "drift_psi": _with("SELECT agent_id, kpi_slug, round(value, 6) + 0 AS value, nc, nb, CAST(bins AS INTEGER) AS bins FROM psi", _rollups(["hour"]), SIDES),
        "drift_excluded": _with(
            """SELECT agent_id, 'latency_drift' AS kpi_slug, 'latency_p95' AS source_slug, count(*) FILTER (WHERE side = 'baseline' AND NOT healthy) AS excluded,
            count(*) FILTER (WHERE side = 'current') AS current_n, count(*) FILTER (WHERE side = 'baseline' AND healthy) AS baseline_n FROM sides GROUP BY agent_id""",
            _rollups(["hour"]), SIDES,
        ),
        "derived_rollup": _with(
            "SELECT agent_id, kpi_slug, 'day' AS granularity, TIMESTAMP '2024-01-31' AS bucket_start, 1::BIGINT AS count, " + ", ".join(f"round(value, 6) + 0 AS {c}" for c in ("sum", "min", "max", "p50", "p95", "p99")) + ", NULL::BIGINT AS distinct_count, nc AS sample_n, nb AS population_n FROM psi", _rollups(["hour"]), SIDES
        ),
        "unjudged_runs": _with("SELECT agent_id, run_id, start_time FROM runs r WHERE payload <> '{}' AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.kpi_slug = 'toxicity' AND o.agent_id = r.agent_id AND o.run_id = r.run_id)"),
        "judge_batch": _with("SELECT agent_id, run_id, start_time FROM runs r WHERE payload <> '{}' AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.kpi_slug = 'toxicity' AND o.agent_id = r.agent_id AND o.run_id = r.run_id) ORDER BY start_time, agent_id, run_id LIMIT 50"),
        "judge_parse": f"SELECT agent_id, run_id, round(value, 6) + 0 AS value, 'judged' AS source, 'given' AS judge_model FROM ({REPLIES}) WHERE outcome = 'ok'",
        "judge_tally": f"SELECT outcome, count(*) AS runs FROM ({REPLIES}) GROUP BY outcome",
        "threshold_override": _with("SELECT agent_id, kpi_slug, overridden, " + ", ".join(f"round({f}, 6) + 0 AS {f}" for f in LIMITS) + " FROM every", more={"every": LATEST["every"]}),
        "threshold_violations": _with(
            """SELECT agent_id, kpi_slug, fault FROM (SELECT own.agent_id, own.kpi_slug, CASE
            WHEN direction = 'higher_is_better' AND own.critical >= own.warning THEN 'order' WHEN direction = 'lower_is_better' AND own.warning >= own.critical THEN 'order'
            WHEN own.good_lo > own.good_hi THEN 'good band inverted' WHEN own.warn_lo > own.warn_hi THEN 'warning band inverted'
            WHEN own.warn_lo > own.good_lo OR own.good_hi > own.warn_hi THEN 'not nested'
            WHEN range_lo IS NOT NULL AND (least(own.warning, own.critical, own.good_lo, own.warn_lo) < range_lo OR greatest(own.warning, own.critical, own.good_hi, own.warn_hi) > range_hi) THEN 'range' END AS fault
            FROM own JOIN defs USING (kpi_slug)) WHERE fault IS NOT NULL"""
        ),
        "override_store": _with(
            "SELECT own.agent_id, own.kpi_slug, "
            + ", ".join(f"round(CASE WHEN {BAD} THEN {old} ELSE own.{f} END, 6) + 0 AS {f}" for f, old in zip(LIMITS, ("0.5", "0.25", "NULL", "NULL", "NULL", "NULL")))
            + " FROM own JOIN defs USING (kpi_slug) WHERE own.agent_id <> 'agent-3'"
        ),
        "definitions_sync": _with("SELECT kpi_slug, any_value(aggregation) AS aggregation, any_value(min_sample_n) AS min_sample_n, min(occurred_at) FILTER (WHERE kind = 'extracted') AS first_observed_at FROM defs LEFT JOIN obs USING (kpi_slug) GROUP BY kpi_slug"),
        "ingest_summary": _with(
            """SELECT agent_id, count(*) AS runs, (SELECT count(*) FROM obs o WHERE o.agent_id = r.agent_id) AS observations,
            (SELECT count(*) FROM feedback f WHERE f.agent_id = r.agent_id AND NOT EXISTS (SELECT 1 FROM runs x WHERE x.agent_id = f.agent_id AND x.run_id = f.run_id)) AS orphans, max(start_time) AS watermark
            FROM runs r GROUP BY agent_id"""
        ),
        "fleet_critical": _with("SELECT agent_id, critical, contributing FROM summary WHERE status = 'critical'", _rollups(ALL), LATEST),
        "derived_custom": _with(
            """SELECT agent_id, 'latency_drift' AS kpi_slug, round(avg(value) FILTER (WHERE side = 'current') / avg(value) FILTER (WHERE side = 'baseline') - 1, 6) + 0 AS value,
            count(*) FILTER (WHERE side = 'current') AS nc, count(*) FILTER (WHERE side = 'baseline') AS nb FROM sides WHERE healthy GROUP BY agent_id""",
            _rollups(["hour"]), SIDES,
        ),
        "partition_labels": _with(
            """SELECT CAST(isoyear(start_time) AS VARCHAR) || 'w' || lpad(CAST(weekofyear(start_time) AS VARCHAR), 2, '0') AS week, CAST(date_trunc('week', start_time) AS TIMESTAMP) AS week_start,
            CAST(date_trunc('week', start_time) AS TIMESTAMP) + INTERVAL 7 DAY AS week_end, strftime(start_time, '%Ym%m') AS month, count(*) AS runs FROM runs GROUP BY ALL"""
        ),
        "retention_runs": _with(
            """SELECT * FROM (SELECT CAST(date_trunc('week', start_time) AS TIMESTAMP) AS part_start, CAST(date_trunc('week', start_time) AS TIMESTAMP) + INTERVAL 7 DAY AS part_end,
            CAST(isoyear(start_time) AS VARCHAR) || 'w' || lpad(CAST(weekofyear(start_time) AS VARCHAR), 2, '0') AS label, count(*) AS rows FROM runs GROUP BY ALL)
            WHERE part_end <= TIMESTAMP '2024-04-20' - INTERVAL 90 DAY"""
        ),
        "retention_payload": _with("SELECT agent_id, run_id, CASE WHEN start_time < TIMESTAMP '2024-01-15' THEN '{}' ELSE payload END AS payload, start_time < TIMESTAMP '2024-01-15' AND payload <> '{}' AS trimmed FROM runs"),
        "retention_rollups": _with(
            """SELECT granularity, kpi_slug, count(*) AS buckets, CAST(sum(count) AS BIGINT) AS values FROM rollups
            WHERE bucket_start >= TIMESTAMP '2024-02-02' - to_days(CASE granularity WHEN 'minute' THEN 7 WHEN 'hour' THEN 90 ELSE 730 END) GROUP BY ALL""",
            _rollups(ALL),
        ),
        "retention_report": _with(
            """SELECT 'partitions_dropped' AS what, (SELECT count(*) FROM (SELECT DISTINCT date_trunc('week', start_time) AS w FROM runs) WHERE w + INTERVAL 7 DAY <= TIMESTAMP '2024-01-21')
              + (SELECT count(*) FROM (SELECT DISTINCT date_trunc('month', occurred_at) AS m FROM obs) WHERE m + INTERVAL 1 MONTH <= TIMESTAMP '2024-01-21') AS n
            UNION ALL SELECT 'payloads_purged', count(*) FROM runs WHERE start_time < TIMESTAMP '2024-03-21' AND payload <> '{}'
            UNION ALL SELECT 'rollups_expired', count(*) FROM rollups WHERE bucket_start < TIMESTAMP '2024-04-20' - to_days(CASE granularity WHEN 'minute' THEN 7 WHEN 'hour' THEN 90 ELSE 730 END)""",
            _rollups(ALL),
        ),
        "cursor_advance": f"""WITH seen AS (SELECT {AGENT} AS workspace_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS polled_at, CASE WHEN event_type = 'error' THEN 'feedback' ELSE 'runs' END AS stream,
              max(ts) AS watermark, CASE WHEN max(value) > 450 THEN 'timeout' END AS error FROM events GROUP BY ALL),
            news AS (SELECT workspace_id, stream, max(watermark) FILTER (WHERE error IS NULL) AS mark, max(polled_at) AS polled, arg_max(coalesce(error, ''), polled_at) AS err, max(polled_at) FILTER (WHERE error IS NULL) AS ok FROM seen GROUP BY ALL),
            counted AS (SELECT n.*, (SELECT count(*) FROM seen s WHERE s.workspace_id = n.workspace_id AND s.stream = n.stream AND s.error IS NOT NULL AND (n.ok IS NULL OR s.polled_at > n.ok)) AS bad FROM news n),
            moved AS (SELECT workspace_id, stream, CASE WHEN stream = 'runs' THEN greatest(TIMESTAMP '2024-01-10', mark) ELSE mark END AS watermark, polled AS last_polled_at, nullif(err, '') AS last_error,
              CAST(bad + CASE WHEN stream = 'runs' AND ok IS NULL THEN 2 ELSE 0 END AS INTEGER) AS consecutive_failures FROM counted)
            SELECT *, coalesce(to_timestamp(floor(epoch(watermark)) - 300) AT TIME ZONE 'UTC', TIMESTAMP '2023-11-02') AS since FROM moved
            UNION ALL SELECT workspace_id, 'runs', TIMESTAMP '2024-01-10', NULL, 'down', 2, TIMESTAMP '2024-01-09 23:55:00' FROM (SELECT DISTINCT workspace_id FROM seen) w WHERE NOT EXISTS (SELECT 1 FROM news n WHERE n.workspace_id = w.workspace_id AND n.stream = 'runs')""",
        "first_observed": _with("SELECT kpi_slug, min(occurred_at) AS first_observed_at FROM defs LEFT JOIN obs USING (kpi_slug) GROUP BY kpi_slug"),
        "coverage": _with(
            "SELECT agent_id, kpi_slug, at, sample_n, population_n, sample_n >= min_sample_n AS adequate, round(sample_n / nullif(population_n, 0), 6) AS coverage FROM points JOIN defs USING (kpi_slug)", _rollups(["day"])
        ),
        "freshness": _with("SELECT agent_id, max(start_time) AS computed_at, CAST(epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(start_time))) AS BIGINT) AS age, epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(start_time))) > 120 AS stale FROM runs GROUP BY agent_id"),
        "change_feed": _with(CHANGED, _rollups(["hour"]), STAGED),
        "series_json": _with(
            """SELECT p.agent_id, kpi_slug, CAST(count(*) AS INTEGER) AS n_points, CAST(epoch(min(at)) AS BIGINT) AS first_t, CAST(sum(epoch(at)) AS DOUBLE) AS sum_t, round(sum(value), 6) + 0 AS sum_v,
            CASE any_value(direction) WHEN 'lower_is_better' THEN 'good,warning,critical' WHEN 'higher_is_better' THEN 'critical,warning,good' ELSE 'critical,warning,good,warning,critical' END AS band_states,
            CASE any_value(direction) WHEN 'lower_is_better' THEN concat_ws(',', '-', CAST(round(any_value(warning) * 1000) AS BIGINT), CAST(round(any_value(critical) * 1000) AS BIGINT))
                WHEN 'higher_is_better' THEN concat_ws(',', '-', CAST(round(any_value(critical) * 1000) AS BIGINT), CAST(round(any_value(warning) * 1000) AS BIGINT))
                ELSE concat_ws(',', '-', CAST(round(any_value(warn_lo) * 1000) AS BIGINT), CAST(round(any_value(good_lo) * 1000) AS BIGINT), CAST(round(any_value(good_hi) * 1000) AS BIGINT), CAST(round(any_value(warn_hi) * 1000) AS BIGINT)) END AS band_starts,
            'm-2' AS marks, any_value(turned) AS sum_marks
            FROM points p JOIN defs USING (kpi_slug) JOIN (SELECT agent_id, CAST(floor(epoch(min(start_time))) AS DOUBLE) AS turned FROM runs WHERE model = 'm-2' GROUP BY agent_id) m ON m.agent_id = p.agent_id
            GROUP BY p.agent_id, kpi_slug""",
            _rollups(["day"]),
        ),
        "payload_fields": _with("SELECT agent_id, count(prompt_tokens) AS n, CAST(sum(prompt_tokens) AS BIGINT) AS total, count(*) FILTER (WHERE payload <> '{}') AS payloads FROM runs GROUP BY agent_id"),
        "streaming_rollup": _with(
            f"""SELECT agent_id, kpi_slug, bucket_start, count, {SUM_STATS}, distinct_count FROM rollups
            WHERE kpi_slug = 'latency_p95' AND bucket_start + INTERVAL 1 HOUR <= (SELECT max(start_time) - INTERVAL 6 HOUR FROM runs)""",
            _rollups(["hour"]),
        ),
        "order_delays": _with(
            f"SELECT agent_id, bucket_start, count, {SUM_STATS}, distinct_count, sample_n, population_n FROM rollups",
            more={
                "lines": """SELECT o_orderpriority AS agent_id, 'latency_p95' AS kpi_slug, o_orderdate AS start_time, o_orderdate AS occurred_at, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) * 1000.0::DOUBLE AS value
                    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
                "rollups": _rollups(["day"], "lines", "lines"),
            },
        ),
    }
    out |= {f"rollup_{g}": _with(BUCKETS, _rollups([g])) for g in GRAINS}
    out = {name: re.sub(r"\bat\b", '"at"', sql) for name, sql in out.items()}  # a keyword there

    from tidegauge import oracle_installation  # which builds on the parts above

    return out | oracle_installation.oracle_sql()
