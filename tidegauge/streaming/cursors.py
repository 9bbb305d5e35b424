"""Where each workspace's streams have come to, and how they fare (S9, ST2, ST3, ST10).

Every batch of a running ingest leaves its mark: a good one moves the watermark
on and clears failures, a failed one counts up and keeps the watermark.  Runs and
feedback are written by queries of their own, so each stream has its own table.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators import ingest
from tidegauge.sources import store
from tidegauge.sources.scratch import discard, materialise

CURSOR = "workspace_id string, stream string, watermark timestamp, last_polled_at timestamp, last_error string, consecutive_failures int"
STREAMS = ("runs", "feedback")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The cursors of all streams."""
    runs, feedback = (store.read_version(spark, f"{path}/{s}", CURSOR) for s in STREAMS)
    return runs.unionByName(feedback)


def record(seen: DataFrame, path: str, stream: str) -> None:
    """Move one stream's cursors on by ``seen`` (workspace_id, watermark, polled_at, error)."""
    spark = seen.sparkSession
    stored = store.read_version(spark, f"{path}/{stream}", CURSOR)
    now = materialise(ingest.advance(stored, seen.withColumn("stream", F.lit(stream))), "cursors")
    store.write_version(now.coalesce(1), f"{path}/{stream}")
    discard(now)


def succeeded(summary: DataFrame, path: str, stream: str, at: datetime | None = None) -> None:
    """A batch was stored; ``summary`` has a row per agent with its watermark."""
    polled = store.instant(at or datetime.now(UTC).replace(tzinfo=None))
    record(summary.select(F.col("agent_id").alias("workspace_id"), "watermark", polled.alias("polled_at"), F.lit(None).cast("string").alias("error")), path, stream)


def failed(pages: DataFrame, path: str, stream: str, error: BaseException, at: datetime | None = None) -> None:
    """A batch of ``pages`` was not stored; counts for the workspaces in it."""
    polled = store.instant(at or datetime.now(UTC).replace(tzinfo=None))
    agents = pages.select(F.col("agent_id").alias("workspace_id")).where("workspace_id is not null").distinct()
    said = str(error).strip().splitlines() or [""]
    record(agents.select("workspace_id", F.lit(None).cast("timestamp").alias("watermark"), polled.alias("polled_at"), F.lit(f"{type(error).__name__}: {said[0]}"[:500]).alias("error")), path, stream)


def due(rows: DataFrame, cursors: DataFrame, stream: str, now: datetime, ts: str) -> DataFrame:
    """Of a source's ``rows`` those that its next poll reads: from 300 s behind the watermark on, from 90 days back when cold (ST2).

    Rows without a time are read, so that their fault is seen.
    """
    since = ingest.poll_since(cursors.where(F.col("stream") == stream), store.instant(now)).select(F.col("workspace_id").alias("agent_id"), "since")
    cold = F.timestamp_seconds(F.unix_timestamp(store.instant(now)) - 90 * 86400)
    joined = rows.join(since, "agent_id", "left")
    return joined.where(F.col(ts).isNull() | (F.col(ts) >= F.coalesce("since", cold))).drop("since")
