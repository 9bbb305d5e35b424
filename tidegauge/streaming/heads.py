"""Newest buckets of every series, kept up to date with each write of buckets.

Readings ask for the newest bucket of a series, and damped ones for the last few
(four times the damping).  The heads table holds the last ``KEEP`` buckets per
(agent, KPI, grain); a write of buckets replaces those of the partitions it
rewrote.  A series that had more history than the table holds and loses buckets
is filled up from the stored history of just such series.  So a reading touches
no history, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidegauge.sources import store
from tidegauge.sources.scratch import discard, materialise

KEYS = ["agent_id", "kpi_slug", "granularity"]
#: Serves damping by up to a quarter of it.
KEEP = 48
BUCKET = "agent_id string, kpi_slug string, granularity string, bucket_start timestamp, count long, sum double, min double, max double, p50 double, p95 double, p99 double, distinct_count long, sample_n long, population_n long"
COLUMNS = [f.strip().split(" ")[0] for f in BUCKET.split(",")]


def newest(buckets: DataFrame, keep: int = KEEP) -> DataFrame:
    """The last ``keep`` buckets with values of each series; Spark drops the others before they travel."""
    back = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("bucket_start")))
    return buckets.where("count > 0").select(*COLUMNS).withColumn("back", back).where(F.col("back") <= keep).drop("back")


def _in(touched: list[tuple[str, str]]):
    return F.concat_ws("/", "granularity", F.to_date("bucket_start").cast("string")).isin([f"{g}/{d}" for g, d in touched])


def refresh(spark: SparkSession, rollups: str, heads: str, touched: list[tuple[str, str]], keep: int = KEEP) -> None:
    """Bring the table at ``heads`` up to date after (granularity, ISO day) partitions of ``rollups`` changed."""
    stored = store.read(spark, rollups, f"{BUCKET}, bucket_date date")
    if not store.has_version(spark, heads):
        store.write_version(newest(stored, keep), heads)
        return
    if not touched:
        return
    before = store.read_version(spark, heads, BUCKET)
    days, grains = sorted({d for _, d in touched}), sorted({g for g, _ in touched})
    fresh = stored.where(F.col("granularity").isin(grains) & F.col("bucket_date").isin([F.lit(d).cast("date") for d in days])).where(_in(touched)).select(*COLUMNS)
    now = materialise(newest(before.where(~_in(touched)).unionByName(fresh), keep), "heads")
    # series that were full and are not any more have older buckets
    size = lambda rows: rows.groupBy(*KEYS).agg(F.count("*").alias("n"))
    short = materialise(size(before).where(F.col("n") >= keep).join(size(now).where(F.col("n") >= keep), KEYS, "left_anti").drop("n"), "heads-short")
    if short.isEmpty():
        store.write_version(now, heads)
    else:
        again = newest(stored.join(short, KEYS, "left_semi"), keep)
        store.write_version(now.join(short, KEYS, "left_anti").select(*COLUMNS).unionByName(again), heads)
    discard(now, short)


def read(spark: SparkSession, heads: str) -> DataFrame:
    """The newest buckets, with the columns of a bucket."""
    return store.read_version(spark, heads, BUCKET)
