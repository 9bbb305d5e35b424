"""Minute, hour and day buckets from observations (A1 to A7, J4, JB2, ST6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.buckets import GRAINS, bucket_start

KEYS = ["agent_id", "kpi_slug", "granularity", "bucket_start"]
#: Seconds of late data that each grain's job looks back for.
LOOKBACK = {"minute": 900, "hour": 21600, "day": 259200}


def _per_grain(rows: DataFrame, ts: str, grains: Sequence[str]) -> DataFrame:
    """``rows`` once per grain, with ``granularity`` and ``bucket_start``."""
    named = rows.withColumn("granularity", F.explode(F.array(*map(F.lit, grains))) if len(grains) > 1 else F.lit(grains[0]))
    start = bucket_start(F.col(ts), F.col("granularity")) if len(grains) > 1 else bucket_start(F.col(ts), grains[0])
    return named.withColumn("bucket_start", start)


def _finest(grains: Sequence[str]) -> str:
    return min(grains, key=GRAINS.get)


def population(runs: DataFrame, grains: Sequence[str] = tuple(GRAINS)) -> DataFrame:
    """Runs per agent and bucket (A7), counted once in the finest grain and summed for the others."""
    base = runs.groupBy("agent_id", bucket_start(F.col("start_time"), _finest(grains)).alias("_at")).agg(F.count("*").alias("n"))
    return _per_grain(base, "_at", grains).groupBy("agent_id", "granularity", "bucket_start").agg(F.sum("n").alias("population_n"))


def rollup(observations: DataFrame, runs: DataFrame, grains: Sequence[str] = tuple(GRAINS), accuracy: int | None = None) -> DataFrame:
    """Every statistic of every bucket, with sample and population sizes.

    Values are first counted per bucket of the finest grain, which combines map-side
    and spreads a hot agent over its values.  These counts travel once more, to the
    day of their series, where the buckets of all grains are made of (value, count)
    pairs, exact percentiles among them.  An exact percentile holds a bucket's
    distinct values in one task; where days of a hot agent have too many,
    ``accuracy`` asks for approximate ones of bounded state (rank error 1 / accuracy).
    """
    finest = _finest(grains)
    base = observations.groupBy("agent_id", "kpi_slug", bucket_start(F.col("occurred_at"), finest).alias("_at"), "value").agg(F.count("*").alias("n"))
    day = ["agent_id", "kpi_slug", "_day"]
    counted = _per_grain(base.withColumn("_day", bucket_start(F.col("_at"), "day")).repartition(*day), "_at", grains).groupBy(*KEYS, "_day", "value").agg(F.sum("n").alias("n"))
    shares = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    found = [
        F.sum("n").alias("count"),
        F.sum(F.col("value") * F.col("n")).alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("*").alias("distinct_count"),
    ]
    if not accuracy:
        found.append(F.percentile("value", shares, F.col("n")).alias("p"))
    stats = counted.groupBy(*KEYS, "_day").agg(*found)
    if accuracy:
        rows = _per_grain(observations.select("agent_id", "kpi_slug", "value", "occurred_at"), "occurred_at", grains)
        near = rows.groupBy(*KEYS).agg(F.percentile_approx("value", shares, F.lit(accuracy)).alias("p"))
        stats = stats.join(near, KEYS)
    stats = stats.select(*KEYS, "count", "sum", "min", "max", *[F.col("p")[i].alias(c) for i, c in enumerate(("p50", "p95", "p99"))], "distinct_count", F.col("count").alias("sample_n"))
    return stats.join(population(runs, grains), ["agent_id", "granularity", "bucket_start"], "left").withColumn("population_n", F.coalesce("population_n", F.lit(0)))


def touched(rows: DataFrame, changed: DataFrame, ts: str, grain: str, keys: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Rows in the buckets that ``changed`` rows fall into (ST6)."""
    at = bucket_start(F.col(ts), grain)
    buckets = changed.select(*keys, at.alias("_b")).distinct()
    return rows.withColumn("_b", at).join(buckets, [*keys, "_b"], "left_semi").drop("_b")


def lookback_window(now: Column, grain: str) -> tuple[Column, Column]:
    """Bounds, aligned to whole buckets, that a grain's periodic job recomputes (JB2)."""
    width = GRAINS[grain]
    end = bucket_start(now, grain)
    return bucket_start(F.timestamp_seconds(F.unix_timestamp(now) - LOOKBACK[grain]), grain), F.timestamp_seconds(F.unix_timestamp(end) + width)


def in_window(ts: Column, bounds: tuple[Column, Column]) -> Column:
    """Half-open range."""
    return (ts >= bounds[0]) & (ts < bounds[1])


def bucket_value(aggregation: Column) -> Column:
    """A bucket's value by its KPI's aggregation (A4)."""
    mean = F.when(F.col("count") > 0, F.col("sum") / F.col("count"))
    chain = F.when(aggregation.isin("mean", "rate"), mean)
    for p in ("p50", "p95", "p99"):
        chain = chain.when(aggregation == p, F.col(p))
    return chain.when(aggregation == "count", F.col("count").cast("double")).when(aggregation == "count_distinct", F.col("distinct_count").cast("double"))


def combined_value(aggregation: Column) -> Column:
    """Value of several buckets (A5): weighted mean, largest percentile, sums."""
    mean = F.when(F.sum("count") > 0, F.sum("sum") / F.sum("count"))
    chain = F.when(aggregation.isin("mean", "rate"), mean)
    for p in ("p50", "p95", "p99"):
        chain = chain.when(aggregation == p, F.max(p))
    return chain.when(aggregation == "count", F.sum("count").cast("double")).when(aggregation == "count_distinct", F.sum("distinct_count").cast("double"))
