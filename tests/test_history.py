"""Sketched buckets and derived KPIs over many days."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge import installation
from tidegauge.operators import drift, ingest, rollup, sketches
from tidegauge.plans import kpis
from tidegauge.sources import store, tables
from tidegauge.streaming import changes, ingest as streaming, jobs

NOW = datetime(2024, 1, 31)


def test_sketches_are_near_and_of_bounded_size(spark):
    n = 40_000
    seen = spark.range(n).select(F.lit("a").alias("agent_id"), F.lit("k").alias("kpi_slug"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("double").alias("value"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 2).alias("occurred_at"))
    minutes = sketches.sketch(seen)
    day = sketches.merge(sketches.merge(minutes, "hour"), "day")
    sizes = day.select(F.length("quantiles").alias("q"), F.length("distincts").alias("d")).first()
    assert sizes["q"] < 8_000 and sizes["d"] < 8_000
    got, exact = sketches.read(day).first(), seen.agg(F.countDistinct("value").alias("d"), F.sum("value").alias("s")).first()
    assert (got["count"], got["sum"]) == (n, exact["s"]) and abs(got["distinct_count"] / exact["d"] - 1) < 0.06
    values = sorted(r["value"] for r in seen.select("value").collect())
    for c, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs(sum(v <= got[c] for v in values) / n - p) < 0.025


def test_sketched_rollup_has_the_buckets_of_the_exact_one(spark, small):
    runs = tables.runs(spark, small)
    seen = ingest.extract(runs)
    near = {tuple(r[k] for k in rollup.KEYS): r for r in sketches.rollup(seen, runs, ("minute", "hour", "day")).collect()}
    exact = rollup.rollup(seen, runs).collect()
    assert len(near) == len(exact)
    for e in exact:
        r = near[tuple(e[k] for k in rollup.KEYS)]
        assert all(r[c] == pytest.approx(e[c]) for c in ("count", "sum", "min", "max", "sample_n", "population_n", "distinct_count"))
        assert e["min"] <= r["p50"] <= r["p95"] <= r["p99"] <= e["max"]


def test_a_history_is_its_single_days(spark, small, tmp_path):
    t = streaming.Tables(str(tmp_path))
    runs = tables.runs(spark, small)
    seen = ingest.extract(runs)
    streaming.store_buckets(rollup.rollup(seen, runs), t)
    first, last = NOW - timedelta(days=2), NOW
    moved = kpis.Kpi("moved", "Moved", "derived", "score", "lower_is_better", "mean", kpis.pair(0.1, 0.2), depends_on=("latency_p95", "success_rate"), compute=lambda now, then: max(now["latency_p95"]) - min(then["latency_p95"]) if now.get("latency_p95") and then.get("latency_p95") else None)
    registry = (*kpis.SHIPPED, moved)
    hours = spark.read.parquet(t.rollups).drop("bucket_date")
    want = []
    for back in range(3):
        day = last - timedelta(days=back)
        values = drift.derive_registry(hours, kpis.definitions(spark, registry), store.instant(day), registry)
        want += drift.as_buckets(values, store.instant(day)).collect()
    jobs.derive_history(spark, t, first, last, registry)
    got = spark.read.parquet(t.rollups).where("kpi_slug in ('moved', 'latency_drift')").select(want[0].__fields__).collect()
    assert len(want) == 30 and len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b))


def test_changes_are_published_once_and_never_late(spark, tmp_path):
    path, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def send(step, *rows):
        at = NOW + timedelta(minutes=step)
        spark.createDataFrame([("a", k, t, v, s, at) for k, t, v, s in rows], changes.READING).coalesce(1).write.mode("append").parquet(path)
        news = changes.published(spark.readStream.schema(changes.READING).parquet(path))
        news.writeStream.foreachBatch(lambda df, _: df.withColumn("step", F.lit(step)).write.mode("append").parquet(out)).option("checkpointLocation", check).outputMode("update").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["kpi_slug"], r["value"]) for r in spark.read.schema(f"{changes.READING}, step int").parquet(out).where(F.col("step") == step).collect())

    t0, t1 = NOW - timedelta(hours=2), NOW - timedelta(hours=1)
    assert send(0, ("x", t0, 1.0, "good"), ("y", None, None, "unknown")) == [("x", 1.0), ("y", None)]
    assert send(1, ("x", t0, 1.0, "good"), ("y", None, None, "unknown")) == []
    assert send(2, ("x", t1, 2.0, "good"), ("x", t1, 2.0, "good")) == [("x", 2.0)]
    assert send(3, ("x", t0, 1.0, "good"), ("y", None, None, "unknown")) == []
    assert send(4, ("x", t1, 2.0, "critical")) == [("x", 2.0)]


def test_grades_are_read_by_the_kpi(spark):
    rows = spark.createDataFrame([("p", "grade: B, because"), ("p", "0.5"), ("p", None), (None, None)], "prompt string, reply string")
    from tidegauge.operators import judge

    assert [(r["value"], r["outcome"]) for r in judge.read_replies(rows, installation.TONE).collect()] == [(0.75, "ok"), (None, "failed"), (None, "failed"), (None, "skip")]
