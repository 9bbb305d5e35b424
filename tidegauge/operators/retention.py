"""Layout by time and retention by three clocks (S10, M1 to M3, A21, JB5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions import parse
from tidegauge.functions.buckets import KEEP_DAYS

#: Days that runs, observations and payloads are kept.
RUN_DAYS, OBSERVATION_DAYS, PAYLOAD_DAYS = 90, 90, 30


def before(now: Column, days: Column | int) -> Column:
    """The instant ``days`` before now."""
    return F.timestamp_seconds(F.unix_timestamp(now) - days * 86400)


def week(ts: Column) -> tuple[Column, Column, Column]:
    """ISO week that holds ``ts``: start, end (half-open) and label such as 2026w36."""
    start = F.date_trunc("week", ts)
    label = F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("w"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return start, start + F.expr("interval 7 days"), label


def month(ts: Column) -> tuple[Column, Column, Column]:
    """Month that holds ``ts``: start, end (half-open) and label such as 2026m08."""
    start = F.date_trunc("month", ts)
    return start, F.add_months(start, 1).cast("timestamp"), F.date_format(ts, "yyyy'm'MM")


def expired(rows: DataFrame, ts: str, period, now: Column, days: int) -> DataFrame:
    """Partitions that lie wholly before the cutoff, with their row counts (M1)."""
    start, end, label = period(F.col(ts))
    parts = rows.groupBy(start.alias("part_start"), end.alias("part_end"), label.alias("label")).agg(F.count("*").alias("rows"))
    return parts.where(F.col("part_end") <= before(now, days))


def keep_partitions(rows: DataFrame, ts: str, period, now: Column, days: int) -> DataFrame:
    """Rows of the partitions that stay; one that straddles the cutoff is kept whole."""
    return rows.where(period(F.col(ts))[1] > before(now, days))


def trim_payloads(runs: DataFrame, now: Column, days: int = PAYLOAD_DAYS) -> DataFrame:
    """Old payloads emptied, rows kept; ``trimmed`` marks those that changed (M2)."""
    old = (F.col("start_time") < before(now, days)) & parse.has_payload(F.col("payload"))
    empty = F.parse_json(F.lit(parse.EMPTY)) if parse.is_variant(runs) else F.lit(parse.EMPTY)
    return runs.withColumns({"trimmed": F.coalesce(old, F.lit(False)), "payload": F.when(old, empty).otherwise(F.col("payload"))})


def keep_rollups(rollups: DataFrame, now: Column) -> DataFrame:
    """Buckets still within their grain's clock (M3)."""
    days = F.create_map(*[x for g, d in KEEP_DAYS.items() for x in (F.lit(g), F.lit(d))])
    return rollups.where(F.col("bucket_start") >= before(now, days[F.col("granularity")]))


def report(runs: DataFrame, observations: DataFrame, rollups: DataFrame, now: Column) -> DataFrame:
    """What a sweep removes: partitions, payloads, buckets."""
    parts = expired(runs, "start_time", week, now, RUN_DAYS).select("label").unionByName(expired(observations, "occurred_at", month, now, OBSERVATION_DAYS).select("label"))
    counts = [
        parts.agg(F.count("*").alias("n")).select(F.lit("partitions_dropped").alias("what"), "n"),
        trim_payloads(runs, now).agg(F.count_if("trimmed").alias("n")).select(F.lit("payloads_purged").alias("what"), "n"),
        rollups.join(keep_rollups(rollups, now), ["agent_id", "kpi_slug", "granularity", "bucket_start"], "left_anti").agg(F.count("*").alias("n")).select(F.lit("rollups_expired").alias("what"), "n"),
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
