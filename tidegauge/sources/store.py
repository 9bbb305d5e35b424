"""Keyed upserts into partitioned Parquet tables (S4 to S6, S10), and reading of the partitions that a range needs.

A table is a folder partitioned by a time label, its files each a span of time.
An upsert looks up the incoming keys in the partitions that they touch, by key
columns alone, merges with the rows of just those files that hold any of them,
adds the result as new files and deletes those.  What a batch costs so follows
the batch, and not the table.  One writer per table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidegauge.functions import parse
from tidegauge.operators.ingest import merge
from tidegauge.operators.retention import month, week
from tidegauge.sources.scratch import discard, materialise, whole_payloads

PERIODS: dict[str, Callable[[Column], tuple[Column, Column, Column]]] = {"week": week, "month": month}


def empty(spark: SparkSession, schema) -> DataFrame:
    """No rows, of which Spark knows that there are none: of an empty list of rows it takes the size for unlimited, and shuffles what it is joined with."""
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table's rows; an absent table is empty."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return empty(spark, schema)


def label_of(day: date, period: str) -> str:
    """Label of the period that holds a day, as the layout writes it."""
    iso = day.isocalendar()
    return f"{iso.year}w{iso.week:02}" if period == "week" else f"{day.year}m{day.month:02}"


def period_end(label: str) -> datetime:
    """First instant after a period."""
    year, n = int(label[:4]), int(label[5:])
    if label[4] == "w":
        return datetime.combine(date.fromisocalendar(year, n, 1), datetime.min.time()) + timedelta(days=7)
    return datetime(year + n // 12, n % 12 + 1, 1)


def labels_between(start: datetime, end: datetime, period: str) -> list[str]:
    """Labels of the periods that the half-open range reaches into."""
    days = (end - start) // timedelta(days=1) + 2
    every = (start.date() + timedelta(days=i) for i in range(days))
    return list(dict.fromkeys(label_of(d, period) for d in every if datetime.combine(d, datetime.min.time()) < end))


def instant(at: datetime) -> Column:
    """A moment as a literal."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def between(rows: DataFrame, ts: str, start: datetime | None, end: datetime | None, period: str) -> DataFrame:
    """Rows of a table in the half-open range; literals on the partition column leave the other folders unread."""
    if start is not None and end is not None and "part" in rows.columns:
        rows = rows.where(F.col("part").isin(labels_between(start, end, period)))
    if start is not None:
        rows = rows.where(F.col(ts) >= instant(start))
    return rows if end is None else rows.where(F.col(ts) < instant(end))


def on_days(rows: DataFrame, ts: str, days: Iterable[date], period: str) -> DataFrame:
    """Rows of a table on some days, from the folders of those days only."""
    days = sorted(days)
    rows = rows.where(F.col("part").isin(sorted({label_of(d, period) for d in days}))) if "part" in rows.columns else rows
    return rows.where(F.to_date(ts).isin(days))


def buckets_between(rollups: DataFrame, start: datetime, end: datetime, grains: Iterable[str] | None = None) -> DataFrame:
    """Buckets of a half-open range, from the folders of its days and grains only."""
    last = (end - timedelta(microseconds=1)).date()
    rows = rollups.where(F.col("bucket_date").between(start.date(), last))
    if grains is not None:
        rows = rows.where(F.col("granularity").isin(*grains))
    return rows.where((F.col("bucket_start") >= instant(start)) & (F.col("bucket_start") < instant(end)))


#: A period of more files than this, below this mean size in bytes, is rewritten as a whole.
MANY_FILES, SMALL_FILE = 64, 1 << 20


def _sizes(spark: SparkSession, path: str) -> list[int]:
    """Sizes of the data files in a folder."""
    folder, fs = _folder(spark, path)
    return [s.getLen() for s in fs.listStatus(folder) if s.getPath().getName()[0] not in "._"] if fs.exists(folder) else []


def _length(spark: SparkSession, file: str) -> int:
    """Size of one file."""
    at, fs = _folder(spark, file)
    return fs.getFileStatus(at).getLen()


def _scattered(spark: SparkSession, folder: str) -> bool:
    """Whether small batches have left a folder in many small files."""
    sizes = _sizes(spark, folder)
    return len(sizes) > MANY_FILES and sum(sizes) < len(sizes) * SMALL_FILE


def _holding(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Paths of a table's files that hold rows with keys of ``new``.

    Rows meet by a hash of their keys, so that a number travels and is sorted in
    place of them; rows of two keys that share a hash only add a file to those merged.
    """
    key = F.xxhash64(*keys).alias("_key")
    held = stored.select(key, F.col("_metadata.file_path").alias("_file"))
    return held.join(new.select(key), "_key", "left_semi").select("_file").distinct()


#: Rows that a task merges, and bytes of their files.
TASK_ROWS, TASK_BYTES = 500_000, 16 << 20


def _by_time(at: Column, key: Column, edges: list[int]) -> Column:
    """Number of the span between ``edges`` that holds ``at``; rows of one instant that fills several spans are dealt among these by ``key``."""

    def pick(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(at <= edges[middle], pick(first, middle)).otherwise(pick(middle + 1, last))

    found = pick(0, len(edges))
    for e, n in Counter(edges).items():
        if n > 1:
            found = F.when(at == e, F.lit(edges.index(e)) + F.pmod(key, F.lit(n + 1)).cast("int")).otherwise(found)
    return F.coalesce(found, F.lit(0))


def _dealt(old: DataFrame, new: DataFrame, ts: str, keys: list[str], size: int) -> tuple[Column, int]:
    """The task of each row to be merged, by spans of time with about as many rows, and how many there are; ``size``: bytes of the old files.

    The spans come from the times alone; ``repartitionByRange`` would read whole rows, payloads and all, to draw its sample.
    """
    spark = new.sparkSession
    times = old.select(F.unix_micros(ts).alias("at")).unionByName(new.select(F.unix_micros(ts).alias("at")))
    rows, size = times.count(), size + sum(_length(spark, f) for f in new.inputFiles())
    least = min(spark.sparkContext.defaultParallelism, 1 + rows // 1000)
    n = max(least, -(-rows // TASK_ROWS), -(-size // TASK_BYTES) if rows else 1)
    edges = times.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 100 * n).alias("q")).first()["q"] if n > 1 else None
    return _by_time(F.unix_micros(ts), F.xxhash64(*keys), edges or []), n


def upsert(incoming: DataFrame, path: str, keys: list[str], replaced: list[str], ts: str, period: str, order: str | None = None, staged: bool = False, few: tuple[str, ...] = ()) -> None:
    """Merge rows into the table at ``path``; repeating a call changes nothing.  Payloads keep the type that the table has them in.

    Rows that are read from a scratch table as it is are ``staged`` already; keys of
    ``few`` values narrow the look-up, as the span of ``ts`` does.  A crash after the
    new files came leaves rows twice; every file that is to go holds incoming keys,
    so the repeated call merges them.
    """
    spark = incoming.sparkSession
    new = incoming.withColumn("part", PERIODS[period](F.col(ts))[2])
    new = scratch = new if staged else materialise(new, "incoming")
    kept = [c for c in new.columns if c != order]
    bounds = [F.min(F.unix_micros(ts)).alias("a"), F.max(F.unix_micros(ts)).alias("b")]
    spans = {r["part"]: r for r in new.groupBy("part").agg(*bounds, *[F.collect_set(c).alias(c) for c in few]).collect()}  # one row per period
    if spans:
        stored = read(spark, path, new.select(*kept).schema)
        fit = parse.like(new, stored.schema)
        by = ["part", *keys]
        exists = bool(stored.inputFiles())
        whole = [p for p in spans if exists and _scattered(spark, f"{path}/part={p}")]
        some = [p for p in spans if p not in whole]
        if whole:
            inside = F.col("part").isin(whole)
            old, now, size = stored.select(*kept).where(inside), fit.where(inside), sum(sum(_sizes(spark, f"{path}/part={p}")) for p in whole)
            with whole_payloads(spark):
                merge(old, now, by, replaced, order, _dealt(old, now, ts, keys, size)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
            fit, new = fit.where(~inside), new.where(~inside)
        if some:
            near = [F.col("part").isin(some), F.col(ts) >= F.timestamp_micros(F.lit(min(spans[p]["a"] for p in some))), F.col(ts) <= F.timestamp_micros(F.lit(max(spans[p]["b"] for p in some)))]
            near += [F.col(c).isin(sorted({v for p in some for v in spans[p][c]})) for c in few]
            files = _holding(stored.where(reduce(Column.__and__, near)), new, by).collect() if exists else []  # one row per file
            gone = ["/".join(r["_file"].split("/")[-2:]) for r in files]
            old = spark.read.schema(stored.schema).option("basePath", path).parquet(*[f"{path}/{f}" for f in gone]) if gone else stored.where(F.lit(False))
            size = sum(_length(spark, f"{path}/{f}") for f in gone)
            with whole_payloads(spark):
                merge(old.select(*kept), fit, by, replaced, order, _dealt(old, fit, ts, keys, size)).write.mode("append").partitionBy("part").parquet(path)
            drop_partitions(spark, path, gone)
    discard(scratch)


def overwrite_buckets(rollups: DataFrame, path: str, recomputed: Iterable[tuple[str, str]] = (), staged: bool = False) -> list[tuple[str, str]]:
    """Replace the (granularity, day) partitions that ``rollups`` holds (S6); answer with those that changed.

    Of the ``recomputed`` (granularity, ISO day) pairs, those that have no bucket any more are dropped.
    Rows that are read from a scratch table as it is are ``staged`` already.
    """
    spark = rollups.sparkSession
    recomputed = list(recomputed)
    parted = rollups.withColumn("bucket_date", F.to_date("bucket_start"))
    table = parted if staged else materialise(parted, "buckets")
    held = {(r["granularity"], str(r["bucket_date"])) for r in table.select("granularity", "bucket_date").distinct().collect()}  # one row per grain and day
    drop_partitions(spark, path, [f"granularity={g}/bucket_date={d}" for g, d in recomputed if (g, d) not in held])
    parts = ["granularity", "bucket_date"]
    table.hint("rebalance", *parts).sortWithinPartitions(*parts, "agent_id", "kpi_slug", "bucket_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("granularity", "bucket_date").parquet(path)
    discard(table)
    return sorted(held | set(recomputed))


def _folder(spark: SparkSession, path: str):
    """Hadoop's path and file system of a folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def partitions(spark: SparkSession, path: str) -> dict[str, int]:
    """Partition folders of a table, such as ``part=2024w01``, and when each was last written; no file is opened."""
    found: dict[str, int] = {}

    def walk(at: str, below: str) -> None:
        folder, fs = _folder(spark, at)
        if fs.exists(folder):
            for s in fs.listStatus(folder):
                name = s.getPath().getName()
                if s.isDirectory() and "=" in name:
                    found[below + name] = s.getModificationTime()
                    walk(f"{at}/{name}", f"{below}{name}/")

    walk(path, "")
    return {p: at for p, at in found.items() if not any(q.startswith(f"{p}/") for q in found)}


def drop_partitions(spark: SparkSession, path: str, parts: list[str]) -> None:
    """Delete whole partition folders of a table (M1), or files of them; nothing else is touched."""
    for part in parts:
        folder, fs = _folder(spark, f"{path}/{part}")
        fs.delete(folder, True)


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """Sizes and write times of the files below some paths: changes with what they hold."""
    out = []
    for path in paths:
        folder, fs = _folder(spark, path)
        files = fs.listStatus(folder) if fs.exists(folder) else []
        out.append((path, tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files))))
    return tuple(out)


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the finished versions below ``path``, and of all."""
    root, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    every = sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))
    return [v for v in every if fs.exists(_folder(spark, f"{path}/version={v}/_SUCCESS")[0])], every


def read_version(spark: SparkSession, path: str, schema) -> DataFrame:
    """The newest finished version of a table that is replaced as a whole; empty if there is none."""
    done, _ = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={done[-1]}") if done else empty(spark, schema)


def has_version(spark: SparkSession, path: str) -> bool:
    """Whether there is a finished version."""
    return bool(_versions(spark, path)[0])


def write_version(rows: DataFrame, path: str) -> None:
    """Write the table's next version, then drop the others: a crash in between leaves the last one in force."""
    spark = rows.sparkSession
    _, every = _versions(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/version={(every[-1] if every else 0) + 1}")
    drop_partitions(spark, path, [f"version={v}" for v in every])
