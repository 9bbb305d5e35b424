"""Scratch tables in the folder that all executors share.

Jobs that need a cut in lineage write a Parquet table here and read it back,
so the work survives lost executors.  The folder is the one the cluster names
in ``spark.checkpoint.dir``; a folder of our own is used only where that
setting is absent and the master is local (tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Where the tables lie that are still in use.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-tidegauge-", dir="/tmp")
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def whole_payloads(spark: SparkSession) -> Iterator[None]:
    """Parquet that is written meanwhile holds each VARIANT in one piece: taken apart into columns it would be put together again by every reader of the whole."""
    key = "spark.sql.variant.inferShreddingSchema"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the scratch folder and read it back."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with whole_payloads(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once nothing reads them any more."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, on whatever store it lies."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(context._jsc.hadoopConfiguration())
    return fs.exists(folder) and fs.getFileStatus(folder).isDirectory()
