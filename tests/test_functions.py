"""Scalar semantics: buckets, classes, unknown rules, thresholds, parsing."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import buckets, parse, status
from tidegauge.plans import kpis

T = "struct<warning:double,critical:double,good_lo:double,good_hi:double,warn_lo:double,warn_hi:double>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(text):
    return F.lit(text).cast("timestamp")


def test_bucket_start(spark):
    at = ts("2026-08-30 13:45:37.123456")
    assert one(spark, buckets.bucket_start(at, "minute")) == datetime(2026, 8, 30, 13, 45)
    assert one(spark, buckets.bucket_start(at, "hour")) == datetime(2026, 8, 30, 13)
    assert one(spark, buckets.bucket_start(at, F.lit("day"))) == datetime(2026, 8, 30)


@pytest.mark.parametrize("hours,cap,grain", [(24, 300, "hour"), (24, 1500, "minute"), (168, 300, "hour"), (24 * 90, 300, "day"), (24 * 730, 300, "day"), (1, 300, "minute")])
def test_granularity(spark, hours, cap, grain):
    start = datetime(2026, 1, 1)
    end = start + timedelta(hours=hours)
    assert one(spark, buckets.granularity_for(ts(str(start)), ts(str(end)), F.lit(cap))) == grain


def test_group_seconds_are_whole_buckets(spark):
    a, b = ts("2024-01-01"), ts("2024-01-31")
    assert one(spark, buckets.bucket_count(a, b, F.lit("hour"))) == 720
    assert one(spark, buckets.bucket_count(b, a, F.lit("hour"))) == 0
    assert one(spark, buckets.group_seconds(a, b, F.lit("hour"), F.lit(100))) == 8 * 3600


def test_named_ranges():
    now = datetime(2024, 1, 31)
    assert buckets.named_range("24h", now) == (datetime(2024, 1, 30), now)
    assert buckets.named_range("nonsense", now) == buckets.named_range("7d", now)
    assert buckets.previous_week(datetime(2024, 1, 8), now) == (datetime(2024, 1, 1), datetime(2024, 1, 24))


@pytest.mark.parametrize(
    "direction,limits,cases",
    [
        ("higher_is_better", (0.95, 0.9, None, None, None, None), {0.95: "good", 0.94: "warning", 0.9: "warning", 0.89: "critical"}),
        ("lower_is_better", (0.1, 0.25, None, None, None, None), {0.1: "good", 0.11: "warning", 0.25: "warning", 0.26: "critical"}),
        ("target_band", (None, None, 0.3, 0.7, 0.1, 0.9), {0.3: "good", 0.7: "good", 0.2: "warning", 0.9: "warning", 0.05: "critical", 0.95: "critical"}),
    ],
)
def test_classify(spark, direction, limits, cases):
    df = spark.createDataFrame([(direction, limits, v, want) for v, want in cases.items()], f"d string, t {T}, v double, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", status.classify(F.col("d"), F.col("t"), F.col("v")).alias("got")).collect())


def test_unknown_never_good(spark):
    rows = [(None, 50, 20), (0.99, 19, 20), (0.99, None, 20), (float("nan"), 50, 0)]
    df = spark.createDataFrame([("higher_is_better", (0.95, 0.9, None, None, None, None), *r) for r in rows], f"d string, t {T}, v double, n int, m int")
    got = df.select(status.evaluate(F.col("d"), F.col("t"), F.col("m"), F.col("v"), F.col("n")).alias("s")).collect()
    assert [r["s"] for r in got] == ["unknown"] * 4
    stale = status.evaluate(F.col("d"), F.col("t"), F.lit(0), F.lit(0.99), F.lit(None).cast("int"), ts("2024-01-01 00:00:00"), 60, ts("2024-01-01 00:02:00"))
    fresh = status.evaluate(F.col("d"), F.col("t"), F.lit(0), F.lit(0.99), F.lit(None).cast("int"), ts("2024-01-01 00:01:30"), 60, ts("2024-01-01 00:02:00"))
    assert tuple(df.select(stale, fresh).first()) == ("unknown", "good")


def fold(states, required):
    settled, seen = None, []
    for s in states:
        seen.append(s)
        if settled is None:
            settled = s
        elif len(seen) >= required and len(set(seen[-required:])) == 1:
            settled = s
    return settled


def test_hysteresis_equals_the_fold(spark):
    rng = random.Random(3)
    series = [list(p) for n in range(1, 5) for p in itertools.product("gwc", repeat=n)] + [[rng.choice("gwcu") for _ in range(rng.randint(5, 14))] for _ in range(150)]
    for required in (2, 3):
        df = spark.createDataFrame([(k, i, s) for k, ss in enumerate(series) for i, s in enumerate(ss)], "k int, i int, s string")
        candidate, _ = status.settled(["k"], "i", "s", required)
        last = F.max_by("c", F.when(F.col("c").isNotNull(), F.col("i")))
        got = df.withColumn("c", candidate).groupBy("k").agg(F.coalesce(last, F.min_by("s", "i")).alias("x")).collect()
        assert {r["k"]: r["x"] for r in got} == {k: fold(ss, required) for k, ss in enumerate(series)}


def test_threshold_faults(spark):
    cases = [
        ("higher_is_better", (0.9, 0.95, None, None, None, None), "order"),
        ("higher_is_better", (0.95, 0.9, None, None, None, None), None),
        ("lower_is_better", (500.0, 100.0, None, None, None, None), "order"),
        ("lower_is_better", (None, None, 0.1, 0.2, 0.0, 0.3), "shape"),
        ("target_band", (None, None, 0.7, 0.3, 0.1, 0.9), "good band inverted"),
        ("target_band", (None, None, 0.3, 0.7, 0.9, 0.1), "warning band inverted"),
        ("target_band", (None, None, 0.0, 0.7, 0.1, 0.9), "not nested"),
        ("sideways", (1.0, 2.0, None, None, None, None), "direction"),
    ]
    df = spark.createDataFrame(cases, f"d string, t {T}, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", status.coherent(F.col("d"), F.col("t")).alias("got")).collect())
    assert one(spark, status.in_range(F.struct(*[F.lit(v).alias(f) for f, v in zip(kpis.LIMITS, (0.5, 1.2, 0.0, 0.0, 0.0, 0.0))]), F.lit(0.0), F.lit(1.0))) is False


def test_judge_replies(spark):
    for reply, want in {"0.42": 0.42, " 1 ": 1.0, "0.3 because": 0.3, "1.5": None, "I would rather not say": None, "": None, None: None, "1e-2": 0.01}.items():
        assert one(spark, parse.judge_score(F.lit(reply).cast("string"))) == want


def test_tolerant_parsing(spark):
    assert one(spark, parse.timestamp(F.lit("not a time"))) is None
    assert one(spark, parse.timestamp(F.lit("2026-08-30T13:45:37.123456Z"))) == datetime(2026, 8, 30, 13, 45, 37, 123456)
    assert one(spark, parse.latency(F.lit(None).cast("int"), ts("2026-01-01 00:00:00"), ts("2026-01-01 00:00:01.5"))) == 1500
    assert one(spark, parse.money(F.lit("dear"))) is None
    assert one(spark, parse.has_payload(F.lit("{ }"))) is False
    assert one(spark, parse.nested(F.lit('{"outputs":{"text":"hi"}}'), "outputs", "text")) == "hi"
    assert one(spark, parse.nested(F.lit('{"outputs":null}'), "outputs", "text")) is None


def test_trend_meaning(spark):
    for direction, delta, want in [("higher_is_better", 1.0, "better"), ("higher_is_better", -1.0, "worse"), ("lower_is_better", -1.0, "better"), ("target_band", 5.0, "neutral"), ("lower_is_better", 0.0, "neutral")]:
        assert one(spark, status.trend_meaning(F.lit(direction), F.lit(delta))) == want
