"""Jobs over stored tables."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tidegauge.operators import ingest, rollup
from tidegauge.plans import kpis
from tidegauge.sources import store, tables
from tidegauge.streaming import ingest as streaming, jobs

NOW = datetime(2024, 1, 31)


def test_jobs_over_stored_tables(spark, small, tmp_path):
    t = streaming.Tables(str(tmp_path))
    runs = tables.runs(spark, small)
    store.upsert(runs, t.runs, ingest.RUN_KEYS, ingest.RUN_REPLACED, "start_time", "week")
    obs = ingest.extract(runs)
    streaming._store_observations(obs, t)
    streaming.refresh_rollups(spark, t, obs)
    want = rollup.rollup(obs, runs).count()
    assert spark.read.parquet(t.rollups).count() == want

    jobs.derive(spark, t, NOW)
    jobs.derive(spark, t, NOW)
    agents = runs.select("agent_id").distinct().count()
    assert spark.read.parquet(t.rollups).where("kpi_slug = 'latency_drift'").count() == agents
    jobs.roll_up(spark, t, NOW - timedelta(hours=1), "day")
    jobs.roll_up(spark, t, NOW, "day")  # derived buckets of the day survive
    assert spark.read.parquet(t.rollups).count() == want + agents

    first = jobs.refresh_overview(spark, t, NOW)
    assert first.count() == agents * len(kpis.SHIPPED)
    assert jobs.refresh_overview(spark, t, NOW).count() == 0

    report = {r["what"]: r["n"] for r in jobs.sweep(spark, t, datetime(2024, 4, 20)).collect()}
    assert report["partitions_dropped"] == 2 and report["payloads_purged"] > 0
    left = spark.read.parquet(t.runs)
    assert 0 < left.count() < runs.count() and left.where("payload != '{}'").count() == 0
    assert jobs.sweep(spark, t, datetime(2024, 4, 20)).agg(F.sum("n")).first()[0] == 0


def test_late_data_keeps_derived_buckets_and_drops_empty_days(spark, small, tmp_path):
    t = streaming.Tables(str(tmp_path))
    runs = tables.runs(spark, small)
    store.upsert(runs, t.runs, ingest.RUN_KEYS, ingest.RUN_REPLACED, "start_time", "week")
    obs = ingest.extract(runs)
    streaming._store_observations(obs, t)
    streaming.refresh_rollups(spark, t, obs)
    jobs.derive(spark, t, NOW)
    drift = spark.read.parquet(t.rollups).where("kpi_slug = 'latency_drift'").collect()
    late = obs.where(F.to_date("occurred_at") >= F.lit("2024-01-29").cast("date"))
    streaming.refresh_rollups(spark, t, late)
    assert sorted(map(str, spark.read.parquet(t.rollups).where("kpi_slug = 'latency_drift'").collect())) == sorted(map(str, drift)) and drift

    day = F.lit("2024-01-10").cast("date")
    gone = obs.where(F.to_date("occurred_at") == day)
    left = spark.read.parquet(t.observations).where(F.to_date("occurred_at") != day).drop("part")
    other = streaming.Tables(str(tmp_path / "other"))
    store.upsert(left, other.observations, ingest.OBSERVATION_KEYS, ingest.OBSERVATION_REPLACED, "occurred_at", "month")
    store.upsert(runs, other.runs, ingest.RUN_KEYS, ingest.RUN_REPLACED, "start_time", "week")
    streaming.refresh_rollups(spark, other, obs.where(F.to_date("occurred_at") != day))
    before = spark.read.parquet(other.rollups).count()
    store.overwrite_buckets(rollup.rollup(gone, runs), other.rollups)  # buckets of observations that are no longer stored
    assert spark.read.parquet(other.rollups).count() > before
    streaming.refresh_rollups(spark, other, gone)
    assert spark.read.parquet(other.rollups).count() == before


def test_versions_survive_a_crash(spark, tmp_path):
    path, schema = str(tmp_path / "v"), "k long"
    assert store.read_version(spark, path, schema).count() == 0
    store.write_version(spark.range(3).toDF("k"), path)
    (tmp_path / "v" / "version=2").mkdir()  # a version that was never finished
    assert store.read_version(spark, path, schema).count() == 3
    store.write_version(spark.range(5).toDF("k"), path)
    assert store.read_version(spark, path, schema).count() == 5 and [p.name for p in (tmp_path / "v").iterdir()] == ["version=3"]


def test_approximate_percentiles(spark, small):
    runs = tables.runs(spark, small)
    obs = ingest.extract(runs)
    exact = {tuple(r[k] for k in rollup.KEYS): r for r in rollup.rollup(obs, runs, ("day",)).collect()}
    near = rollup.rollup(obs, runs, ("day",), accuracy=1000).collect()
    assert len(near) == len(exact)
    for r in near:
        e = exact[tuple(r[k] for k in rollup.KEYS)]
        assert r["count"] == e["count"] and r["sum"] == e["sum"] and r["min"] <= r["p50"] <= r["p95"] <= r["p99"] <= r["max"]


def test_rollup_faults(spark):
    rows = [("a", "k", "hour", NOW, 1, 1), ("a", "k", "week", NOW, 1, 1), (None, "k", "day", None, -1, 2)]
    df = spark.createDataFrame(rows, "agent_id string, kpi_slug string, granularity string, bucket_start timestamp, sample_n int, population_n int")
    good, bad = ingest.quarantine(df, ingest.rollup_faults())
    assert good.count() == 1 and sorted(r["faults"] for r in bad.collect()) == [["agent_id", "bucket_start", "sample_n"], ["granularity"]]


def test_backfill_until_nothing_is_left(spark, tmp_path):
    t = streaming.Tables(str(tmp_path))
    rows = [("ws", str(i), "n", NOW + timedelta(minutes=i), 1, "success", "m", 1, None, '{"outputs":{"text":"%d"}}' % i) for i in range(7)]
    runs = spark.createDataFrame(rows, "agent_id string, run_id string, name string, start_time timestamp, latency_ms int, status string, model string, prompt_tokens int, cost_usd decimal(14,6), payload string")
    store.upsert(runs, t.runs, ingest.RUN_KEYS, ingest.RUN_REPLACED, "start_time", "week")
    kpi = next(k for k in kpis.SHIPPED if k.slug == "toxicity")
    tally = jobs.backfill(spark, t, kpi, lambda p: pd.DataFrame({"reply": "0.25", "judge_model": "j"}, index=p.index), batch=3)
    assert tally == {"ok": 7} and spark.read.parquet(t.observations).where("source = 'judged' and value = 0.25").count() == 7
