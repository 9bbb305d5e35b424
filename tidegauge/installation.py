"""Registered queries that go through a whole installation: files, streams, stored tables, jobs.

The given tables become files of response bodies; two streams ingest them into
tables in scratch storage, and the periodic jobs run over these.  An installation
is made once per session and state of the given tables; queries that change it
make their own.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.functions import parse
from tidegauge.operators import drift, judge, read, sketches
from tidegauge.operators.ingest import OBSERVATION_KEYS
from tidegauge.plans import kpis
from tidegauge.sources import records, store, tables
from tidegauge.sources.scratch import scratch_path
from tidegauge.streaming import changes, cursors, ingest, jobs, matching
from tidegauge.streaming.ingest import Tables

NOW = datetime(2024, 1, 31)


def _cache_hit() -> Column:
    hit = parse.field(F.col("payload"), "extra", "metadata", "cache_hit", type="boolean")
    return F.when(hit, 1.0).when(~hit, 0.0)


def _grade(reply: Column) -> Column:
    """A grade such as ``B`` in ``grade: B, because ...`` as a score."""
    letter = F.regexp_extract(reply, "grade: ([A-D])", 1)
    return F.when(letter == "A", 1.0).when(letter == "B", 0.75).when(letter == "C", 0.5).when(letter == "D", 0.25)


def _mean(values: list[float]) -> float:
    return sum(values) / len(values)


def _moved(current: dict, baseline: dict) -> float | None:
    """How far latency moved, and success with it."""
    if not all(side.get(s) for side in (current, baseline) for s in ("latency_p95", "success_rate")):
        return None
    slower = _mean(current["latency_p95"]) / _mean(baseline["latency_p95"]) - 1
    return slower + abs(_mean(current["success_rate"]) - _mean(baseline["success_rate"]))


#: KPIs of a user's own, each one object.
CACHE_HIT = kpis.Kpi("cache_hit_rate", "Cache hit rate", "extracted", "ratio", "higher_is_better", "rate", kpis.pair(0.6, 0.3), 10, "none", (0.0, 1.0), value=_cache_hit)
TONE = kpis.Kpi("tone", "Tone", "judged", "score", "higher_is_better", "mean", kpis.pair(0.7, 0.4), 5, "none", (0.0, 1.0), prompt="Grade the tone of this answer from A to D.", parse=_grade)
MOVED = kpis.Kpi("service_moved", "Service moved", "derived", "score", "lower_is_better", "mean", kpis.pair(0.2, 0.5), health="none", depends_on=("latency_p95", "success_rate"), compute=_moved)
TWO_DRIFTS = kpis.Kpi("service_drift", "Service drift", "derived", "score", "lower_is_better", "mean", kpis.pair(0.1, 0.25), health="none", depends_on=("latency_p95", "sentiment"))
REGISTRY = (*kpis.SHIPPED, CACHE_HIT, TONE, MOVED, TWO_DRIFTS)


def grader(prompts: pd.Series) -> pd.DataFrame:
    """Stands in for a model: the grade follows from the length of the prompt, and some prompts get no answer."""
    n = prompts.str.len() % 7
    reply = n.map({0: "grade: A", 1: "grade: B, because", 2: "grade: C", 3: "grade: D", 4: "no grade", 5: None, 6: "grade: A"})
    return pd.DataFrame({"reply": reply, "judge_model": "grader"}, index=prompts.index)


def run_ingest(df: DataFrame, t: Tables) -> DataFrame:
    return ingest.ingest_runs(df, t, REGISTRY)


def feedback_ingest(df: DataFrame, t: Tables) -> DataFrame:
    return ingest.ingest_feedback(df, t, REGISTRY)


def _files(pages: DataFrame, name: str) -> str:
    path = scratch_path(pages.sparkSession, name)
    pages.select("agent_id", "body").write.partitionBy("agent_id").text(path)
    return path


def drain(spark: SparkSession, path: str, handle: Callable, t: Tables, stream: str | None) -> None:
    """One stream over files of pages, to its end."""
    ingest.start(records.stream_pages(spark, path), handle, t, scratch_path(spark, "check"), stream).awaitTermination()


#: Installations of this session, by application, tables and their state.
_MADE: dict[tuple, Tables] = {}


def made(spark: SparkSession, d: str) -> Tables:
    """Runs and feedback ingested from files by two streams, and rolled up."""
    key = (spark.sparkContext.applicationId, store.fingerprint(spark, f"{d}/events.parquet", f"{d}/labels.parquet"))
    if key not in _MADE:
        t = Tables(scratch_path(spark, "installation"))
        drain(spark, _files(tables.whole_run_pages(spark, d), "run-pages"), run_ingest, t, "runs")
        drain(spark, _files(tables.feedback_pages(spark, d), "feedback-pages"), feedback_ingest, t, "feedback")
        ingest.refresh_rollups(spark, t, spark.read.parquet(t.observations))
        _MADE[key] = t
    return _MADE[key]


def payload_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every stored run with its whole payload, fields that no column asks for among them."""
    runs = spark.read.parquet(made(spark, d).runs)
    p = F.col("payload")
    return runs.select("agent_id", "run_id", F.to_json("payload").alias("payload"), parse.field(p, "inputs", "system").alias("system"), parse.field(p, "outputs", "tools", type="array<string>")[1].alias("tool"), parse.field(p, "extra", "metadata", "user", type="long").alias("user"))


def kpi_added(spark: SparkSession, d: str) -> DataFrame:
    """Day points of a user's KPI on a payload field, through ingest and rollup."""
    rollups = spark.read.parquet(made(spark, d).rollups).where("granularity = 'day' and kpi_slug = 'cache_hit_rate'").drop("bucket_date")
    return read.points_of(rollups, kpis.definitions(spark, REGISTRY))


def feedback_files(spark: SparkSession, d: str) -> DataFrame:
    """Observations that feedback files brought, and feedback that still waits for its run."""
    t = made(spark, d)
    seen = spark.read.parquet(t.observations).where("source = 'imported'").select("agent_id", "run_id", "kpi_slug", "value", "occurred_at", "computed_at")
    waits = store.read_version(spark, t.pending, ingest.PENDING)
    key = F.when(F.col("key") == "kpi.toxicity", "toxicity").otherwise("sentiment")
    return seen.unionByName(waits.select("agent_id", "run_id", key.alias("kpi_slug"), F.col("score").alias("value"), F.lit(None).cast("timestamp").alias("occurred_at"), F.col("created_at").alias("computed_at")))


def runs_reimported(spark: SparkSession, d: str) -> DataFrame:
    """Files imported twice by a stream and once by a poll: what is stored converges (ST11)."""
    t = Tables(scratch_path(spark, "installation"))
    pages = tables.whole_run_pages(spark, d)
    path = _files(pages, "run-pages")
    for _ in range(2):
        drain(spark, path, run_ingest, t, "runs")
    ingest.poll_runs(records.read_pages(spark, path), t, NOW, REGISTRY)
    runs = spark.read.parquet(t.runs).groupBy("agent_id").agg(F.count("*").alias("runs"), F.sum("latency_ms").alias("latency"))
    seen = spark.read.parquet(t.observations).groupBy("agent_id").agg(F.count("*").alias("observations"), F.countDistinct(*OBSERVATION_KEYS).alias("distinct_observations"))
    return runs.join(seen, "agent_id")


def batches_logged(spark: SparkSession, d: str) -> DataFrame:
    """Totals of all batches by stream, from the log that each batch leaves."""
    rows = spark.read.schema(ingest.BATCH).parquet(made(spark, d).batches)
    return rows.groupBy("stream").agg(*[F.sum(c).alias(c) for c in ("records", "stored", "faulty", "observations", "orphans")], F.max("watermark").alias("watermark"))


def _down(df: DataFrame, t: Tables) -> DataFrame:
    raise ValueError("down")


def cursor_table(spark: SparkSession, d: str) -> DataFrame:
    """Cursors of the running ingest: runs fail, then come; feedback comes, then fails."""
    t = Tables(scratch_path(spark, "installation"))
    runs, feedback = _files(tables.whole_run_pages(spark, d), "run-pages"), _files(tables.feedback_pages(spark, d), "feedback-pages")
    for path, handle, stream in ((runs, _down, "runs"), (runs, run_ingest, "runs"), (feedback, feedback_ingest, "feedback"), (feedback, _down, "feedback")):
        try:
            drain(spark, path, handle, t, stream)
        except StreamingQueryException:
            if handle is not _down:
                raise
    return tables.ntz(cursors.read(spark, t.cursors).select("workspace_id", "stream", "watermark", "last_error", "consecutive_failures"))


def poll_due(spark: SparkSession, d: str) -> DataFrame:
    """Runs that the next poll reads: those from 300 s behind each workspace's watermark on."""
    t = made(spark, d)
    rows = records.flatten_runs(tables.whole_run_pages(spark, d)).select("agent_id", "run_id", "start_time")
    return tables.ntz(cursors.due(rows, cursors.read(spark, t.cursors), "runs", NOW, "start_time"))


def orphans_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Feedback met with its run by a join of two streams; what waited in vain comes out without one."""
    runs, feedback = scratch_path(spark, "runs-stream"), scratch_path(spark, "feedback-stream")
    scores = records.last_scores(tables.feedback(spark, d), "created_at")
    scores.write.parquet(feedback)
    tables.runs(spark, d).select("agent_id", "run_id", "start_time").write.parquet(runs)
    streams = [spark.readStream.schema(spark.read.parquet(p).schema).parquet(p) for p in (feedback, runs)]
    met = matching.match_streams(*streams, late="2 days", reach="1 day")
    out, check = scratch_path(spark, "met"), scratch_path(spark, "met-check")
    met.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(met.schema).parquet(out)


def derived_registry(spark: SparkSession, d: str) -> DataFrame:
    """All derived KPIs of a registry by one job; they outlive late data and a day rollup, and are in the overview."""
    base = made(spark, d)
    t = Tables(scratch_path(spark, "installation"), (("runs", base.root), ("observations", base.root)))  # only buckets change
    stored = spark.read.parquet(base.rollups).drop("bucket_date")
    ingest.store_buckets(stored, t)
    jobs.derive(spark, t, NOW, REGISTRY)
    ingest.refresh_rollups(spark, t, spark.read.parquet(t.observations).where(F.col("occurred_at") >= store.instant(datetime(2024, 1, 29))))
    jobs.roll_up(spark, t, NOW, "day")
    overview = jobs.refresh_overview(spark, t, NOW, kpis=REGISTRY)
    slugs = [k.slug for k in REGISTRY if k.kind == "derived"]
    kept = spark.read.parquet(t.rollups).where(F.col("kpi_slug").isin(slugs)).select("agent_id", "kpi_slug", "bucket_start", "count", "sum", "p95", "sample_n", "population_n")
    read_ = overview.where(F.col("kpi_slug").isin(slugs)).select("agent_id", "kpi_slug", F.col("value").alias("read_value"), "status")
    return kept.join(read_, ["agent_id", "kpi_slug"])


def overview_stored(spark: SparkSession, d: str) -> DataFrame:
    """State of every KPI of every agent, from the newest buckets that each write keeps up to date."""
    rows = jobs.readings(spark, made(spark, d))
    return rows.select("agent_id", "kpi_slug", "granularity", "at", "value", "sample_n", "population_n", "status")


def series_stored(spark: SparkSession, d: str) -> DataFrame:
    """Three days of every agent's hours from stored buckets, read from the folders of those days."""
    t = made(spark, d)
    agents = spark.read.parquet(t.rollups).where("granularity = 'day'").select("agent_id").distinct()
    slugs = F.explode(F.array(*[F.lit(k.slug) for k in kpis.SHIPPED if k.kind != "derived"]))
    asked = agents.select("agent_id", slugs.alias("kpi_slug"), store.instant(datetime(2024, 1, 20)).alias("from_ts"), store.instant(datetime(2024, 1, 23)).alias("to_ts"), F.lit(300).alias("max_points"), F.lit(None).cast("string").alias("granularity"))
    return jobs.series(spark, t, asked)


def judge_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two weeks judged by a KPI that reads grades; unreadable ones first in line hold up none."""
    t = Tables(scratch_path(spark, "installation"))
    runs = tables.answers(spark, d)
    missing = {c: F.lit(None).cast(kind) for c, kind in (("end_time", "timestamp"), ("latency_ms", "int"), ("status", "string"))}
    store.upsert(parse.as_variant(runs).withColumns(missing), t.runs, ["agent_id", "run_id", "start_time"], ["payload"], "start_time", "week")
    jobs.backfill(spark, t, TONE, grader, batch=20, start=datetime(2024, 1, 1, 1), end=datetime(2024, 1, 15))
    jobs.backfill(spark, t, TONE, grader, start=datetime(2024, 1, 1, 1), end=datetime(2024, 1, 15), agent="src3")  # nothing new to be read
    seen = spark.read.parquet(t.observations).select("agent_id", "run_id", "kpi_slug", "value", "source", "judge_model", "occurred_at")
    left = judge.unjudged(spark.read.parquet(t.runs), spark.read.parquet(t.observations), TONE)
    return seen.unionByName(left.select("agent_id", "run_id", F.lit(TONE.slug).alias("kpi_slug"), F.lit(None).cast("double").alias("value"), F.lit("unjudged").alias("source"), F.lit(None).cast("string").alias("judge_model"), F.col("start_time").alias("occurred_at")))


def changes_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Readings of the 29th, then of all data, then those again, through the change feed: what it publishes after the first."""
    base = spark.read.parquet(made(spark, d).rollups).where("granularity = 'hour'").drop("bucket_date")
    agents, defs = base.select("agent_id").distinct(), kpis.definitions(spark)
    path, out, check = scratch_path(spark, "readings"), scratch_path(spark, "published"), scratch_path(spark, "published-check")
    days = (datetime(2024, 1, 29), NOW, NOW)
    for step, day in enumerate(days):
        rows = read.latest(base.where(F.col("bucket_start") < store.instant(day)), agents, defs).select("agent_id", "kpi_slug", "at", "value", "status", store.instant(day).alias("computed_at"))
        rows.coalesce(1).write.mode("append").parquet(path)
        news = changes.published(spark.readStream.schema(changes.READING).parquet(path))
        news.writeStream.foreachBatch(lambda df, _, step=step: df.withColumn("step", F.lit(step)).write.mode("append").parquet(out)).option("checkpointLocation", check).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).where("step > 0").drop("step", "computed_at")


def drift_daily(spark: SparkSession, d: str) -> DataFrame:
    """Drift as of every midnight of twelve days, in one plan."""
    rollups = spark.read.parquet(made(spark, d).rollups).drop("bucket_date")
    drifts = [k for k in REGISTRY if k.kind == "derived" and not k.compute and len(k.depends_on) == 1]
    return drift.derive_registry(rollups, kpis.definitions(spark), store.instant(NOW), drifts, since=store.instant(datetime(2024, 1, 20)))


def _near(buckets: DataFrame, observations: DataFrame, width: str, error: float = 0.025) -> DataFrame:
    """Buckets with exact statistics, and whether the ranks of the others are within ``error`` of what they stand for."""
    keys = ["agent_id", "kpi_slug", "bucket_start"]
    rows = observations.withColumn("bucket_start", F.date_trunc(width, "occurred_at")).join(buckets.select(*keys, "p50", "p95", "p99", "distinct_count"), keys)
    near = [((F.count_if(F.col("value") < F.col(c)) / F.count("*") <= p + error) & (F.count_if(F.col("value") <= F.col(c)) / F.count("*") >= p - error)).alias(f"{c}_near") for c, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    some = (F.abs(F.max("distinct_count") / F.countDistinct("value") - 1) <= 0.06).alias("distinct_near")
    checked = rows.groupBy(*keys).agg(*near).join(rows.groupBy(*keys).agg(some), keys)
    return buckets.select(*keys, "count", "sum", "min", "max").join(checked, keys)


def sketched_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Months of sketches merged from sketched days."""
    seen = spark.read.parquet(made(spark, d).observations)
    months = sketches.merge(sketches.merge(sketches.sketch(seen, "hour"), "day"), "month")
    return _near(sketches.read(months), seen, "month")


def sketches_streamed(spark: SparkSession, d: str) -> DataFrame:
    """Days of a stream of observations as sketches of constant size; only closed windows appear."""
    path, out, check = made(spark, d).observations, scratch_path(spark, "sketches"), scratch_path(spark, "sketches-check")
    seen = spark.read.parquet(path)
    days = sketches.sketch_stream(spark.readStream.schema(seen.schema).parquet(path), "1 day")
    days.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _near(sketches.read(spark.read.schema(days.schema).parquet(out)), seen, "day")


def replays_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a stream passes on from files, then from the same files again beside new ones."""
    path, out, check = scratch_path(spark, "run-pages"), scratch_path(spark, "passed"), scratch_path(spark, "passed-check")
    pages = tables.whole_run_pages(spark, d).select("agent_id", "body")
    for step, rows in enumerate((pages.where("agent_id != 'agent-4'"), pages)):
        rows.write.mode("append").partitionBy("agent_id").text(path)
        fresh = records.new_runs(records.stream_pages(spark, path)).select("agent_id", "run_id", F.lit(step).alias("step"))
        fresh.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("step", "agent_id").agg(F.count("*").alias("runs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [payload_whole, kpi_added, feedback_files, batches_logged, runs_reimported, cursor_table, poll_due, orphans_streamed, changes_streamed, drift_daily, sketched_rollup, sketches_streamed, replays_dropped, derived_registry, overview_stored, series_stored, judge_backfill]

    def tidy(query: Callable) -> Callable:
        def run(spark: SparkSession, d: str) -> DataFrame:
            df = query(spark, d)
            return tables.ntz(df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))

        return run

    return {f.__name__: tidy(f) for f in named}
