"""Time buckets, grain choice and named ranges, as column expressions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

#: Seconds per bucket and days kept, finest grain first.
GRAINS = {"minute": 60, "hour": 3600, "day": 86400}
KEEP_DAYS = {"minute": 7, "hour": 90, "day": 730}
#: Named ranges in seconds, and the one for unknown names.
RANGES = {"1h": 3600, "24h": 86400, "7d": 604800, "30d": 2592000, "90d": 7776000}
DEFAULT_RANGE = "7d"
MAX_POINTS = 300


def bucket_start(ts: Column, grain: str | Column) -> Column:
    """Start of the bucket that holds ``ts`` (F1)."""
    if isinstance(grain, str):
        return F.date_trunc(grain, ts)
    chain = F.date_trunc("day", ts)
    for name in ("hour", "minute"):
        chain = F.when(grain == name, F.date_trunc(name, ts)).otherwise(chain)
    return chain


def super_bucket(ts: Column, seconds: Column) -> Column:
    """Start of the epoch-aligned bucket of ``seconds`` (F2)."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def seconds_of(grain: Column) -> Column:
    """Seconds per bucket of a grain."""
    return F.when(grain == "minute", 60).when(grain == "hour", 3600).otherwise(86400)


def granularity_for(start: Column, end: Column, max_points: Column) -> Column:
    """Finest grain whose buckets over a range do not exceed ``max_points``, else day."""
    span = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.when(span / 60 <= max_points, "minute").when(span / 3600 <= max_points, "hour").otherwise("day")


def bucket_count(start: Column, end: Column, grain: Column) -> Column:
    """Stored buckets that a range spans."""
    span = F.greatest(F.unix_timestamp(end) - F.unix_timestamp(start), F.lit(0))
    return F.floor(span / seconds_of(grain))


def group_seconds(start: Column, end: Column, grain: Column, max_points: Column) -> Column:
    """Width of super-buckets for a downsampled range: whole stored buckets."""
    span = F.unix_timestamp(end) - F.unix_timestamp(start)
    width = seconds_of(grain)
    quotient = span / F.greatest(max_points, F.lit(1))
    whole = F.when(quotient >= 0, F.floor(quotient)).otherwise(F.ceil(quotient))
    return F.ceil(F.greatest(whole, width) / width) * width


def named_range(name: str, now: datetime) -> tuple[datetime, datetime]:
    """Half-open bounds of a named range that ends now; unknown names mean a week."""
    return now - timedelta(seconds=RANGES.get(name, RANGES[DEFAULT_RANGE])), now


def previous_week(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The same bounds one week earlier."""
    return start - timedelta(days=7), end - timedelta(days=7)
