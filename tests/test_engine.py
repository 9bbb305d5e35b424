"""Rollups, reading, drift, judging, retention on small literal rows."""

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import drift, ingest, judge, read, retention, rollup
from tidegauge.plans import kpis
from tidegauge.sources import records

OBS = "agent_id string, run_id string, kpi_slug string, kpi_version int, value double, source string, judge_model string, occurred_at timestamp, computed_at timestamp"
NOW = datetime(2026, 8, 30)


def observations(spark, rows):
    full = [("ws", str(i), slug, 1, v, "extracted", None, at, at) for i, (slug, v, at) in enumerate(rows)]
    return spark.createDataFrame(full, OBS)


def runs(spark, times, agent="ws"):
    rows = [(agent, str(i), t, 100, "success", "m-1", '{"a":1}') for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "agent_id string, run_id string, start_time timestamp, latency_ms int, status string, model string, payload string")


def hours(n, value, start=NOW - timedelta(hours=48), per=25, slug="success_rate"):
    return [(slug, value, start + timedelta(hours=h, minutes=m)) for h in range(n) for m in range(per)]


def test_rollup_orders_and_repeats(spark):
    rng = random.Random(1)
    rows = [("latency_p95", float(round(rng.random() * 1000)), NOW + timedelta(minutes=rng.randint(0, 300))) for _ in range(500)]
    obs, r = observations(spark, rows), runs(spark, [x[2] for x in rows])
    once = rollup.rollup(obs, r)
    for b in once.collect():
        assert b["min"] <= b["p50"] <= b["p95"] <= b["p99"] <= b["max"] and b["distinct_count"] > 0 and b["sample_n"] == b["population_n"]
    again = rollup.rollup(obs.orderBy(F.rand(2)), r)
    assert once.exceptAll(again).count() == 0 and again.exceptAll(once).count() == 0


def test_sampled_kpi_has_smaller_sample(spark):
    rows = hours(2, 1.0) + [("toxicity", 0.1, NOW - timedelta(hours=48))]
    r = runs(spark, [x[2] for x in rows if x[0] == "success_rate"])
    got = {(b["kpi_slug"], b["granularity"]): b for b in rollup.rollup(observations(spark, rows), r).collect()}
    assert got["toxicity", "day"]["sample_n"] == 1 and got["toxicity", "day"]["population_n"] == 50


def test_gaps_are_no_zeros(spark):
    rows = hours(5, 1.0) + hours(5, 1.0, NOW - timedelta(hours=20))
    points = read.points_of(rollup.rollup(observations(spark, rows), runs(spark, [NOW])), kpis.definitions(spark)).where("granularity = 'hour'")
    assert points.count() == 10 and points.where("value = 0").count() == 0


def test_downsampling_keeps_the_weighted_mean(spark):
    rows = [("success_rate", float(h % 2), NOW - timedelta(days=29) + timedelta(hours=h, minutes=m)) for h in range(600) for m in range(1 + h % 3)]
    rolls = rollup.rollup(observations(spark, rows), runs(spark, [NOW]), ("hour",))
    asked = spark.createDataFrame([("ws", "success_rate", NOW - timedelta(days=30), NOW, 50, "hour"), ("ws", "no_such_kpi", NOW, NOW, 5, None)], "agent_id string, kpi_slug string, from_ts timestamp, to_ts timestamp, max_points int, granularity string")
    got = read.series(rolls, asked, kpis.definitions(spark)).collect()
    assert got and all(p["downsampled"] for p in got) and len(got) <= 51
    mean = sum(p["value"] * p["sample_n"] for p in got) / sum(p["sample_n"] for p in got)
    assert mean == pytest.approx(sum(r[1] for r in rows) / len(rows), abs=1e-9)


def test_thin_hour_falls_back_to_the_day(spark):
    rows = [("success_rate", 1.0, NOW + timedelta(hours=h)) for h in range(24)]
    rolls = rollup.rollup(observations(spark, rows), runs(spark, [r[2] for r in rows]))
    agents = spark.createDataFrame([("ws",)], "agent_id string")
    got = {r["kpi_slug"]: r for r in read.latest(rolls, agents, kpis.definitions(spark)).collect()}
    assert got["success_rate"]["granularity"] == "day" and got["success_rate"]["status"] == "good"
    assert got["toxicity"]["status"] == "unknown" and got["toxicity"]["value"] is None
    assert len(got) == len(kpis.SHIPPED)


@pytest.mark.parametrize("last,want", [(1, "good"), (4, "critical")])
def test_hysteresis_window(spark, last, want):
    rows = hours(6, 1.0) + hours(last, 0.8, NOW - timedelta(hours=42))
    rolls = rollup.rollup(observations(spark, rows), runs(spark, [NOW]), ("hour",))
    agents = spark.createDataFrame([("ws",)], "agent_id string")
    got = read.latest(rolls, agents, kpis.definitions(spark), hysteresis=3).where("kpi_slug = 'success_rate'").first()
    assert got["raw_status"] == "critical" and got["status"] == want


def test_overrides_do_not_leak(spark):
    agents = spark.createDataFrame([("a",), ("b",)], "agent_id string")
    own = spark.createDataFrame([("a", "success_rate", (0.5, 0.4, None, None, None, None))], "agent_id string, kpi_slug string, thresholds struct<warning:double,critical:double,good_lo:double,good_hi:double,warn_lo:double,warn_hi:double>")
    got = {(r["agent_id"], r["kpi_slug"]): r for r in read.with_overrides(agents, kpis.definitions(spark), own).collect()}
    assert got["a", "success_rate"]["thresholds"]["warning"] == 0.5 and got["a", "success_rate"]["overridden"]
    assert got["b", "success_rate"]["thresholds"]["warning"] == 0.95 and not got["b", "success_rate"]["overridden"]


def test_roll_up_is_the_worst_contributing(spark):
    rows = [("a", "good", "normal"), ("a", "unknown", "critical"), ("b", "critical", "none"), ("b", "good", "normal"), ("c", "critical", "none"), ("d", "warning", "normal"), ("d", "unknown", "normal")]
    got = {r["agent_id"]: r for r in read.summary(spark.createDataFrame(rows, "agent_id string, status string, health string")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "unknown", "b": "good", "c": "unknown", "d": "warning"}
    assert got["b"]["critical"] == 1 and got["b"]["contributing"] == 1


def test_annotations_skip_the_first(spark):
    r = runs(spark, [NOW + timedelta(hours=h) for h in range(6)]).withColumn("model", F.when(F.col("run_id").cast("int") >= 3, "m-2").otherwise("m-1"))
    got = read.annotations(r, observations(spark, hours(1, 1.0))).collect()
    assert [(a["kind"], a["label"], a["at"]) for a in got] == [("model", "m-2", NOW + timedelta(hours=3))]


def test_merge_replaces_only_what_it_should(spark):
    old = spark.createDataFrame([("k", "first", 1.0), ("z", "kept", 5.0)], "id string, source string, value double")
    new = spark.createDataFrame([("k", "second", 2.0, 1), ("k", "third", 3.0, 2), ("n", "new", 9.0, 1)], "id string, source string, value double, at int")
    once = ingest.merge(old, new, ["id"], ["value"], "at")
    want = {("k", "first", 3.0), ("z", "kept", 5.0), ("n", "new", 9.0)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in ingest.merge(once, new, ["id"], ["value"], "at").collect()} == want
    assert {r["id"] for r in ingest.remove(once, new, ["id"]).collect()} == {"z"}


def test_feedback_rules(spark):
    body = '{"feedback":[{"run_id":"1","key":"kpi.toxicity","score":0.1},{"run_id":"1","key":"kpi.toxicity","score":0.3},{"run_id":"1","key":"other","score":1},{"run_id":"2","key":"kpi.polarity","score":null},{"run_id":"9","key":"kpi.polarity","score":0.5}]}'
    pages = spark.createDataFrame([("ws", body), ("ws", "rubbish"), ("ws", None)], "agent_id string, body string")
    flat = records.flatten_feedback(pages)
    r = runs(spark, [NOW] * 3)
    matched = ingest.imported(ingest.match(flat, r), kpis.definitions(spark)).collect()
    assert [(m["run_id"], m["kpi_slug"], m["value"], m["source"]) for m in matched] == [("1", "toxicity", 0.3, "imported")]
    assert [o["run_id"] for o in ingest.orphans(flat, r).collect()] == ["9"]


def test_run_pages_in_three_envelopes(spark):
    run = '{"id":"%s","start_time":"2026-01-01T00:00:00Z","end_time":"2026-01-01T00:00:02Z","status":"success","agent_id":"liar","extra":{"metadata":{"model":"m"}}}'
    bodies = ["[" + run % "a" + "]", '{"runs":[' + run % "b" + "]}", '{"data":[' + run % "c" + "]}", "{}", "nonsense"]
    flat = records.flatten_runs(spark.createDataFrame([("ws", b) for b in bodies], "agent_id string, body string")).collect()
    assert sorted((r["run_id"], r["agent_id"], r["latency_ms"], r["model"]) for r in flat) == [(i, "ws", 2000, "m") for i in "abc"]


def test_quarantine(spark):
    rows = [("ws", "1", NOW, 1, 1, 0.1), ("ws", "2", NOW, -1, 1, 0.1), (None, "3", None, 1, -1, 0.1)]
    df = spark.createDataFrame(rows, "agent_id string, run_id string, start_time timestamp, latency_ms int, prompt_tokens int, cost_usd double")
    good, bad = ingest.quarantine(df, ingest.run_faults())
    assert good.count() == 1 and {r["run_id"]: r["faults"] for r in bad.collect()} == {"2": ["latency_ms"], "3": ["agent_id", "start_time", "prompt_tokens"]}


def reference_psi(cur, base):
    if len(cur) < 30 or len(base) < 30 or min(base) == max(base):
        return None
    bins = max(2, min(10, min(len(cur), len(base)) // 20))
    ordered = sorted(base)
    edges = [ordered[max(0, min(len(base) - 1, math.floor(i / bins * len(base) + 0.5) - 1))] for i in range(1, bins)]
    shares = lambda xs: [max(sum(1 for x in xs if sum(e < x for e in edges) == b) / len(xs), 1e-6) for b in range(bins)]
    return sum((a - e) * math.log(a / e) for a, e in zip(shares(cur), shares(base)))


def test_psi(spark):
    base = [i / 200 for i in range(200)]
    cases = {"same": base, "near": [v + 0.1 for v in base], "far": [v + 2 for v in base], "flat": [5.0] * 40, "thin": [1.0, 2.0]}
    rows = [(k, "d", "s", side, v, True) for k, cur in cases.items() for side, vs in (("current", cur), ("baseline", base)) for v in vs]
    rows += [("constant", "d", "s", side, 1.0, True) for side in ("current", "baseline") for _ in range(50)]
    got = {r["agent_id"]: r["value"] for r in drift.psi(spark.createDataFrame(rows, "agent_id string, kpi_slug string, source_slug string, side string, value double, healthy boolean")).collect()}
    assert set(got) == {"same", "near", "far", "flat"}
    assert got["same"] < 0.01 and got["near"] < got["far"] and got["far"] > 0.25
    for k, v in got.items():
        assert v == pytest.approx(reference_psi(cases[k], base), abs=1e-9) and math.isfinite(v)


def test_incident_in_baseline_is_left_out(spark):
    start = NOW - timedelta(days=7)
    rows = [("latency_p95", 1000.0 + h % 40, start + timedelta(hours=h)) for h in range(48, 168)]
    rows += [("latency_p95", 60000.0 if 60 <= h < 80 else 1000.0 + h % 40, start + timedelta(hours=h - 72)) for h in range(120)]
    rolls = rollup.rollup(observations(spark, rows), runs(spark, [NOW]), ("hour",))
    sides = drift.windows(rolls, kpis.definitions(spark), F.lit(str(NOW)).cast("timestamp"), {"latency_drift": ("latency_p95",)}, 5, 5)
    assert drift.excluded(sides).first()["excluded"] == 20
    assert drift.psi(sides).first()["value"] < 0.25


def test_judge(spark):
    rows = [("ws", str(i), NOW + timedelta(minutes=i), p) for i, p in enumerate(['{"outputs":{"text":"fine"}}', '{"outputs":{"text":"rude"}}', "{}", '{"outputs":{}}', '{"outputs":{"text":"error"}}'])]
    r = spark.createDataFrame(rows, "agent_id string, run_id string, start_time timestamp, payload string")
    kpi = next(k for k in kpis.SHIPPED if k.slug == "toxicity")
    todo = judge.unjudged(r, observations(spark, hours(1, 1.0)), kpi)
    assert {x["run_id"] for x in todo.collect()} == {"0", "1", "3", "4"}
    assert [x["run_id"] for x in judge.oldest(todo, 2).collect()] == ["0", "1"]

    def scorer(prompts):
        return pd.DataFrame({"reply": [None if p.endswith("error") else "0.9" if p.endswith("rude") else "0.1 ok" for p in prompts], "judge_model": "j"})

    scored = judge.score(todo, kpi, scorer)
    assert {x["outcome"]: x["runs"] for x in judge.tally(scored).collect()} == {"ok": 2, "skip": 1, "failed": 1}
    done = judge.judged(scored, kpi)
    assert {(x["run_id"], x["value"]) for x in done.collect()} == {("0", 0.1), ("1", 0.9)}
    assert {x["run_id"] for x in judge.unjudged(r, done, kpi).collect()} == {"3", "4"}


def test_retention(spark):
    r = runs(spark, [NOW - timedelta(days=d) for d in (120, 92, 40, 5)])
    now = F.lit(str(NOW)).cast("timestamp")
    kept = retention.keep_partitions(r, "start_time", retention.week, now, 90)
    assert {x["run_id"] for x in kept.collect()} >= {"2", "3"} and "0" not in {x["run_id"] for x in kept.collect()}
    assert retention.expired(r, "start_time", retention.week, now, 90).agg(F.sum("rows")).first()[0] == r.count() - kept.count()
    trimmed = {x["run_id"]: (x["payload"], x["trimmed"]) for x in retention.trim_payloads(r, now).collect()}
    assert trimmed["2"] == ("{}", True) and trimmed["3"] == ('{"a":1}', False) and len(trimmed) == 4


def test_partition_labels(spark):
    df = spark.sql("select timestamp '2026-08-31' as t union all select timestamp '2027-01-01'").select(retention.week(F.col("t"))[2].alias("w"), retention.month(F.col("t"))[2].alias("m"))
    assert [tuple(r) for r in df.orderBy("w").collect()] == [("2026w36", "2026m08"), ("2026w53", "2027m01")]


def test_cursor(spark):
    schema = "workspace_id string, stream string, watermark timestamp, last_polled_at timestamp, last_error string, consecutive_failures int"
    now = spark.createDataFrame([], schema)
    seen = "workspace_id string, stream string, watermark timestamp, polled_at timestamp, error string"
    step = lambda c, *rows: ingest.advance(c, spark.createDataFrame(list(rows), seen))
    day = lambda n: NOW + timedelta(days=n)
    now = step(now, ("w", "runs", day(0), day(1), None))
    now = step(now, ("w", "runs", day(-3), day(2), None))
    assert now.first()["watermark"] == day(0)
    now = step(now, ("w", "runs", None, day(3), "down"), ("w", "runs", None, day(4), "down"))
    assert (now.first()["watermark"], now.first()["consecutive_failures"], now.first()["last_error"]) == (day(0), 2, "down")
    now = step(now, ("w", "runs", day(5), day(5), None))
    assert (now.first()["watermark"], now.first()["consecutive_failures"], now.first()["last_error"]) == (day(5), 0, None)
    assert ingest.poll_since(now, F.lit(str(NOW)).cast("timestamp")).first()["since"] == day(5) - timedelta(seconds=300)


def test_changes(spark):
    now = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("d", None)], "k string, v double")
    old = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "k string, v double")
    assert {r["k"] for r in read.changes(now, old, ["k"], ["v"]).collect()} == {"b", "d"}


def test_new_kpi_needs_one_definition(spark):
    extra = kpis.Kpi("tokens", "Tokens", "extracted", "count", "lower_is_better", "count_distinct", kpis.pair(1.0, 2.0), value=lambda: F.col("latency_ms") + 1)
    registry = (*kpis.SHIPPED, extra)
    r = runs(spark, [NOW, NOW + timedelta(minutes=1)])
    rolls = rollup.rollup(ingest.extract(r, registry), r)
    got = read.latest(rolls, r.select("agent_id").distinct(), kpis.definitions(spark, registry)).where("kpi_slug = 'tokens'").first()
    assert got["value"] == 1.0 and got["status"] == "good"
