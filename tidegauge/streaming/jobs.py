"""Periodic jobs over stored tables: rollup, derived, judging, overview, retention (JB2 to JB6).

Each takes the registry of KPIs where it needs one, and reads the folders only
that its window, range or clock asks for.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, time, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.functions.buckets import GRAINS, KEEP_DAYS
from tidegauge.operators import drift, judge, read, retention, rollup
from tidegauge.plans.kpis import SHIPPED, Kpi, definitions
from tidegauge.sources import store
from tidegauge.sources.scratch import discard, materialise
from tidegauge.streaming import heads
from tidegauge.streaming.ingest import Tables, _store_observations, store_buckets, with_kept

READING = ["agent_id", "kpi_slug", "granularity", "at", "value", "sample_n", "population_n", "raw_status", "status"]
OVERVIEW = "agent_id string, kpi_slug string, granularity string, at timestamp, value double, sample_n long, population_n long, raw_status string, status string, computed_at timestamp"
OVERRIDES = "agent_id string, kpi_slug string, thresholds struct<warning:double,critical:double,good_lo:double,good_hi:double,warn_lo:double,warn_hi:double>"


def _midnight(at: datetime) -> datetime:
    return datetime.combine(at.date(), time())


def roll_up(spark: SparkSession, tables: Tables, now: datetime, grain: str, accuracy: int | None = None) -> None:
    """Recompute the grain's look-back window, widened to whole days so that whole partitions are replaced (JB2)."""
    start = _midnight(now - timedelta(seconds=rollup.LOOKBACK[grain]))
    days = [start.date() + timedelta(days=i) for i in range((_midnight(now) - start).days + 1)]
    end = start + timedelta(days=len(days))
    near = store.between(spark.read.parquet(tables.observations), "occurred_at", start, end, "month")
    runs = store.between(spark.read.parquet(tables.runs), "start_time", start, end, "week")
    made = rollup.rollup(near, runs, (grain,), accuracy)
    store_buckets(with_kept(spark, tables, made, days, (grain,)), tables, [(grain, str(d)) for d in days])


def derive(spark: SparkSession, tables: Tables, as_of: datetime, kpis=SHIPPED, current_days: int = 7, baseline_days: int = 30) -> None:
    """Every derived KPI of the registry for the windows that end at ``as_of``, as day buckets (JB3)."""
    rollups = spark.read.parquet(tables.rollups)
    back = store.buckets_between(rollups, as_of - timedelta(days=current_days + baseline_days), as_of, ["hour"])
    values = drift.derive_registry(back.drop("bucket_date"), definitions(spark, kpis), store.instant(as_of), kpis, current_days, baseline_days)
    new = materialise(drift.as_buckets(values, store.instant(as_of)), "derived")
    keys = rollup.KEYS
    day = rollups.where((F.col("granularity") == "day") & (F.col("bucket_date") == as_of.date())).join(new.select(*keys), keys, "left_anti")
    store_buckets(day.select(new.columns).unionByName(new), tables)
    discard(new)


def derive_history(spark: SparkSession, tables: Tables, first: datetime, last: datetime, kpis=SHIPPED, current_days: int = 7, baseline_days: int = 30) -> None:
    """Derived KPIs as of every midnight of a span, in one plan that reads each hour once (ST7)."""
    rollups = spark.read.parquet(tables.rollups)
    back = store.buckets_between(rollups, first - timedelta(days=current_days + baseline_days), last, ["hour"]).drop("bucket_date")
    values = drift.derive_registry(back, definitions(spark, kpis), store.instant(last), kpis, current_days, baseline_days, store.instant(first))
    new = materialise(drift.as_buckets(values, F.col("as_of")), "derived")
    keys = rollup.KEYS
    days = rollups.where((F.col("granularity") == "day") & F.col("bucket_date").between(first.date(), last.date())).join(new.select(*keys), keys, "left_anti")
    store_buckets(days.select(new.columns).unionByName(new), tables)
    discard(new)


def backfill(
    spark: SparkSession, tables: Tables, kpi: Kpi, scorer: Callable[[pd.Series], pd.DataFrame], batch: int = 50,
    agent: str | None = None, start: datetime | None = None, end: datetime | None = None,
) -> dict[str, int]:
    """Judge what is unjudged, of one agent or all, in a range or ever (JB4); the tally of outcomes.

    One pass: what is unjudged in the range's folders is found once, oldest first,
    and the model gets ``batch`` prompts at a time.  A run that cannot be read, or
    on which the model fails, holds up none of the others and is tried again by the next call.
    """
    seen = store.read(spark, tables.observations, "agent_id string, run_id string, kpi_slug string, kpi_version int, occurred_at timestamp")
    runs = store.between(spark.read.parquet(tables.runs), "start_time", start, end, "week")
    seen = store.between(seen, "occurred_at", start, end, "month")
    if agent is not None:
        runs, seen = runs.where(F.col("agent_id") == agent), seen.where(F.col("agent_id") == agent)
    todo = judge.unjudged(runs, seen, kpi).repartitionByRange("start_time", "agent_id", "run_id").sortWithinPartitions("start_time", "agent_id", "run_id")
    scored = materialise(judge.score(todo, kpi, judge.in_batches(scorer, batch)), "scored")
    counts = {r["outcome"]: r["runs"] for r in judge.tally(scored).collect()}  # three outcomes
    if counts.get("ok"):
        _store_observations(judge.judged(scored, kpi), tables)
    discard(scored)
    return counts


def readings(spark: SparkSession, tables: Tables, hysteresis: int | None = None, kpis=SHIPPED) -> DataFrame:
    """State of every KPI of every agent, from the newest buckets alone (Q2)."""
    overrides = store.read(spark, tables.overrides, OVERRIDES)
    if (hysteresis or 0) * 4 > heads.KEEP:
        rollups = spark.read.parquet(tables.rollups).drop("bucket_date")
    else:
        rollups = heads.read(spark, tables.heads)
    agents = heads.read(spark, tables.heads).select("agent_id").distinct()
    return read.latest(rollups, agents, definitions(spark, kpis), overrides, hysteresis)


def refresh_overview(spark: SparkSession, tables: Tables, now: datetime, hysteresis: int | None = None, kpis=SHIPPED) -> DataFrame:
    """Publish a new snapshot of all readings; answer with those that changed (Q4, JB6, ST8).

    The snapshot is a version of its own, so a crash leaves the last one in force.
    """
    now_ = readings(spark, tables, hysteresis, kpis).select(*READING)
    snapshot = materialise(now_.withColumn("computed_at", store.instant(now)), "overview")
    before = store.read_version(spark, tables.overview, OVERVIEW)
    moved = materialise(read.changes(snapshot, before, ["agent_id", "kpi_slug"], ["at", "value", "status"]), "changes")
    store.write_version(snapshot, tables.overview)
    discard(snapshot)
    return moved


def series(spark: SparkSession, tables: Tables, requests: DataFrame, kpis=SHIPPED) -> DataFrame:
    """Points of many series (Q1), from the folders of the grains and days that the requests reach into."""
    asked = read.sized(requests, definitions(spark, kpis))
    spans = asked.groupBy("granularity").agg(F.min("from_ts").alias("a"), F.max("to_ts").alias("b")).collect()  # one row per grain
    rollups = spark.read.parquet(tables.rollups)
    keep = F.lit(False)
    for r in spans:
        keep = keep | ((F.col("granularity") == r["granularity"]) & F.col("bucket_date").between(r["a"].date(), r["b"].date()))
    return read.series(rollups.where(keep).drop("bucket_date"), requests, definitions(spark, kpis))


def _expired_periods(spark: SparkSession, path: str, now: datetime, days: int) -> list[str]:
    """Folders whose period ended before the clock (M1), by their names alone."""
    cutoff = now - timedelta(days=days)
    return [p for p in store.partitions(spark, path) if p.startswith("part=") and store.period_end(p.removeprefix("part=")) <= cutoff]


def _expired_buckets(spark: SparkSession, path: str, now: datetime) -> list[str]:
    """Folders all of whose buckets are older than their grain's clock (M3), by their names alone."""
    gone = []
    for p in store.partitions(spark, path):
        if p.count("/") != 1:  # a grain that has no days left
            continue
        grain, day = (x.split("=")[1] for x in p.split("/"))
        last = datetime.fromisoformat(day) + timedelta(days=1) - timedelta(seconds=GRAINS[grain])
        if last < now - timedelta(days=KEEP_DAYS[grain]):
            gone.append(p)
    return gone


def _trim(spark: SparkSession, tables: Tables, now: datetime) -> int:
    """Empty the payloads older than their clock; the number emptied (M2).

    Weeks that were emptied as a whole are remembered with their folder's write
    time and not read again, unless a later batch rewrote them.
    """
    cutoff = now - timedelta(days=retention.PAYLOAD_DAYS)
    done = {r["part"]: r["written"] for r in store.read_version(spark, tables.trimmed, "part string, written long").collect()}  # one row per week
    weeks = {p.removeprefix("part="): at for p, at in store.partitions(spark, tables.runs).items() if p.startswith("part=")}
    due = [w for w, at in weeks.items() if store.period_end(w) - timedelta(days=7) < cutoff and done.get(w) != at]
    if not due:
        return 0
    old = spark.read.parquet(tables.runs).where(F.col("part").isin(due))
    marked = retention.trim_payloads(old, store.instant(now))
    counts = {r["part"]: r["n"] for r in marked.groupBy("part").agg(F.count_if("trimmed").alias("n")).collect() if r["n"]}  # one row per week
    if counts:
        staged = materialise(marked.where(F.col("part").isin(list(counts))).drop("trimmed"), "trimmed")
        staged.hint("rebalance", "part").sortWithinPartitions("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(tables.runs)
        discard(staged)
    after = store.partitions(spark, tables.runs)
    whole = [(w, after[f"part={w}"]) for w in weeks if store.period_end(w) <= cutoff and f"part={w}" in after]
    store.write_version(spark.createDataFrame(whole, "part string, written long").coalesce(1), tables.trimmed)
    return sum(counts.values())


def sweep(spark: SparkSession, tables: Tables, now: datetime) -> DataFrame:
    """Apply the three retention clocks; answer with what was removed (JB5, A21).

    What is old is read from the names of folders.  Rows are read only of weeks whose
    payloads the clock has newly reached; expired buckets are counted from file footers.
    """
    dropped = 0
    for path, days in ((tables.runs, retention.RUN_DAYS), (tables.observations, retention.OBSERVATION_DAYS)):
        gone = _expired_periods(spark, path, now, days)
        store.drop_partitions(spark, path, gone)
        dropped += len(gone)
    purged = _trim(spark, tables, now)
    stale = _expired_buckets(spark, tables.rollups, now)
    expired = spark.read.option("basePath", tables.rollups).parquet(*[f"{tables.rollups}/{p}" for p in stale]).count() if stale else 0
    store.drop_partitions(spark, tables.rollups, stale)
    heads.refresh(spark, tables.rollups, tables.heads, [tuple(x.split("=")[1] for x in p.split("/")) for p in stale])
    return spark.createDataFrame([("partitions_dropped", dropped), ("payloads_purged", purged), ("rollups_expired", expired)], "what string, n long")
