"""From runs and feedback to observations, and keyed merges of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import parse
from tidegauge.functions.buckets import GRAINS
from tidegauge.plans.kpis import SHIPPED

RUN_KEYS = ["agent_id", "run_id", "start_time"]
RUN_REPLACED = ["end_time", "latency_ms", "status", "error", "model", "prompt_tokens", "completion_tokens", "cost_usd", "payload", "updated_at"]
#: What the first import of a run sets for good.
RUN_FIXED = ["trace_id", "parent_run_id", "name", "run_type", "inserted_at"]
OBSERVATION_KEYS = ["agent_id", "run_id", "kpi_slug", "kpi_version", "occurred_at"]
OBSERVATION_REPLACED = ["value", "computed_at"]
SOURCES = ("extracted", "judged", "imported")


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str], replaced: list[str], order: str | None = None, spread: tuple[Column, int] | None = None) -> DataFrame:
    """Upsert by key (S4, S5, S8): ``replaced`` columns from the last row, all others from the first.

    Existing rows come before incoming ones; incoming rows of one key follow
    ``order`` (a column of ``incoming`` that the result leaves out).  One
    aggregation with map-side combining; repeating it changes nothing.  With
    ``spread``, the task of a row, which its key decides, and the number of tasks,
    rows are sorted once, after the one shuffle, for where few rows share a key.
    """
    replaced = [c for c in replaced if c in existing.columns]
    fixed = [c for c in existing.columns if c not in keys and c not in replaced]
    columns = keys + fixed + replaced
    old = existing.select(*columns, F.lit(None).cast("string").alias("_o"), F.lit(0).alias("_s"))
    new = incoming.select(*columns, (F.col(order) if order else F.lit(None)).cast("string").alias("_o"), F.lit(1).alias("_s"))
    at = F.struct("_s", "_o")
    picked = [F.max_by(F.struct(*replaced), at).alias("_new")] + ([F.min_by(F.struct(*fixed), at).alias("_old")] if fixed else [])
    rows = old.unionByName(new)
    if spread:
        task, tasks = spread
        rows = rows.withColumn("_task", task).repartitionById(tasks, F.col("_task")).groupBy("_task", *keys).agg(*picked)
    else:
        rows = rows.groupBy(*keys).agg(*picked)
    return rows.select(*keys, *[F.col(f"_old.{c}").alias(c) for c in fixed], *[F.col(f"_new.{c}").alias(c) for c in replaced]).select(*existing.columns)


def remove(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Delete by key."""
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def sync_definitions(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Current definitions; when each was first observed survives."""
    seen = stored.select("kpi_slug", F.col("first_observed_at").alias("_seen"))
    return current.join(F.broadcast(seen), "kpi_slug", "left").withColumn("first_observed_at", F.col("_seen")).drop("_seen")


def first_observed(observations: DataFrame, definitions: DataFrame) -> DataFrame:
    """Where each KPI's series begins; what is already set stays."""
    begins = observations.groupBy("kpi_slug").agg(F.min("occurred_at").alias("_begins"))
    known = F.col("first_observed_at") if "first_observed_at" in definitions.columns else F.lit(None).cast("timestamp")
    return definitions.join(begins, "kpi_slug", "left").withColumn("first_observed_at", F.coalesce(known, "_begins")).drop("_begins")


def extract(runs: DataFrame, kpis=SHIPPED) -> DataFrame:
    """Observations computed from each run; a null value skips the run."""
    each = [F.struct(F.lit(k.slug).alias("kpi_slug"), F.lit(k.version).alias("kpi_version"), k.value().cast("double").alias("value")) for k in kpis if k.value]
    rows = parse.as_variant(runs).select("agent_id", "run_id", F.col("start_time").alias("occurred_at"), F.explode(F.array(*each)).alias("k"))
    rows = rows.select("agent_id", "run_id", "k.kpi_slug", "k.kpi_version", "k.value", "occurred_at").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return _observed(rows, "extracted", F.col("occurred_at"))


def _observed(rows: DataFrame, source: str, computed: Column, model: Column | None = None) -> DataFrame:
    return rows.select(
        "agent_id", "run_id", "kpi_slug", "kpi_version", "value", F.lit(source).alias("source"),
        (model if model is not None else F.lit(None)).cast("string").alias("judge_model"), "occurred_at", computed.alias("computed_at"),
    )


def match(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """Feedback with its run's start; feedback whose run has not come yet is left out."""
    return feedback.join(runs.select("agent_id", "run_id", "start_time"), ["agent_id", "run_id"])


def orphans(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """Feedback to be retried once its run arrives (J2, ST4)."""
    return feedback.join(runs.select("agent_id", "run_id"), ["agent_id", "run_id"], "left_anti")


def imported(matched: DataFrame, definitions: DataFrame) -> DataFrame:
    """Observations from matched feedback; unknown keys fall out."""
    known = definitions.where("feedback_key is not null").select(F.col("feedback_key").alias("key"), "kpi_slug", F.col("version").alias("kpi_version"))
    # one row per KPI: the registry
    rows = matched.join(F.broadcast(known), "key").withColumnRenamed("score", "value").withColumn("occurred_at", F.col("start_time"))
    return _observed(rows, "imported", F.col("created_at"))


def run_faults() -> Column:
    """Why a run may not be stored; empty if it may."""
    rules = {
        "run_id": F.col("run_id").isNull() | (F.col("run_id") == ""),
        "agent_id": F.col("agent_id").isNull(),
        "start_time": F.col("start_time").isNull(),
        "latency_ms": F.col("latency_ms") < 0,
        "prompt_tokens": F.col("prompt_tokens") < 0,
        "cost_usd": F.col("cost_usd") < 0,
    }
    return F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull())


def observation_faults() -> Column:
    """Why an observation may not be stored."""
    rules = {
        "kpi_slug": F.col("kpi_slug").isNull(),
        "value": F.col("value").isNull() | F.isnan("value"),
        "occurred_at": F.col("occurred_at").isNull(),
        "source": F.col("source").isNull() | ~F.col("source").isin(*SOURCES),
    }
    return F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull())


def rollup_faults() -> Column:
    """Why a bucket may not be stored."""
    rules = {
        "agent_id": F.col("agent_id").isNull(),
        "kpi_slug": F.col("kpi_slug").isNull(),
        "granularity": F.col("granularity").isNull() | ~F.col("granularity").isin(*GRAINS),
        "bucket_start": F.col("bucket_start").isNull(),
        "sample_n": F.col("sample_n") < 0,
        "population_n": F.col("population_n") < 0,
    }
    return F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull())


def quarantine(rows: DataFrame, faults: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without faults, and the others with their faults."""
    judged = rows.withColumn("faults", faults)
    return judged.where(F.size("faults") == 0).drop("faults"), judged.where(F.size("faults") > 0)


def advance(cursors: DataFrame, seen: DataFrame) -> DataFrame:
    """Cursor state after polls: watermarks only move on, a success clears failures (S9, ST3, ST10).

    ``seen``: workspace_id, stream, watermark, polled_at, error (null: success).
    """
    ok = F.col("error").isNull()
    keys = ["workspace_id", "stream"]
    news = seen.groupBy(*keys).agg(
        F.max(F.when(ok, F.col("watermark"))).alias("_mark"),
        F.max("polled_at").alias("_polled"),
        F.max_by("error", "polled_at").alias("_error"),
        F.max(F.when(ok, F.col("polled_at"))).alias("_ok"),
    )
    # failures after the last success, counted; one row per stream meets its polls
    bad = seen.where(~ok).select(*keys, "polled_at").join(news.select(*keys, F.col("_ok").alias("_last")), keys)
    bad = bad.where(F.col("_last").isNull() | (F.col("polled_at") > F.col("_last"))).groupBy(*keys).agg(F.count("*").alias("_since"))
    rows = cursors.join(news, keys, "full").join(bad, keys, "left")
    since = F.coalesce("_since", F.lit(0))
    before = F.when(F.col("_ok").isNull(), F.coalesce("consecutive_failures", F.lit(0))).otherwise(0)
    return rows.select(
        "workspace_id", "stream", F.greatest("watermark", "_mark").alias("watermark"), F.greatest("last_polled_at", "_polled").alias("last_polled_at"),
        F.when(F.col("_polled").isNull(), F.col("last_error")).otherwise(F.col("_error")).alias("last_error"), (before + since).cast("int").alias("consecutive_failures"),
    )


def poll_since(cursors: DataFrame, now: Column, overlap: int = 300, cold_days: int = 90) -> DataFrame:
    """Where each stream's next read begins: behind its watermark, or far back when cold (ST2)."""
    back = F.timestamp_seconds(F.unix_timestamp("watermark") - overlap)
    return cursors.withColumn("since", F.coalesce(back, F.timestamp_seconds(F.unix_timestamp(now) - cold_days * 86400)))


def batch_summary(runs: DataFrame, observations: DataFrame, lost: DataFrame, faulty: DataFrame | None = None) -> DataFrame:
    """What an ingest brought, per agent (A14, A19): runs, observations, orphans and the newest start; ``quarantined`` if ``faulty`` rows are given."""
    r = runs.groupBy("agent_id").agg(F.count("*").alias("runs"), F.max("start_time").alias("watermark"))
    o = observations.groupBy("agent_id").agg(F.count("*").alias("observations"))
    p = lost.groupBy("agent_id").agg(F.count("*").alias("orphans"))
    rows = r.join(o, "agent_id", "full").join(p, "agent_id", "full")
    counts = ["runs", "observations", "orphans"]
    if faulty is not None:
        rows = rows.join(faulty.groupBy("agent_id").agg(F.count("*").alias("quarantined")), "agent_id", "full")
        counts.append("quarantined")
    return rows.select("agent_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "watermark")
