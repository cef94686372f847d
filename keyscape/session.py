"""Durable intermediates: cut lineage in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: What has been written, by application.
_written: dict[str, list[str]] = {}
_tables: dict[str, str] = {}


def durable_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts: ``spark.checkpoint.dir`` as the session has it.

    Only a ``local`` master, where every task shares this machine's disk, may
    fall back to a temporary folder. On a cluster the setting is required.
    """
    path = spark.conf.get(_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                f"set {_CONF} to storage that every executor can reach"
            )
        path = tempfile.mkdtemp(prefix="keyscape-")
        spark.conf.set(_CONF, path)
    return path.rstrip("/")


def _paths(spark: SparkSession) -> list[str]:
    return _written.setdefault(spark.sparkContext.applicationId, [])


@contextmanager
def _setting(spark: SparkSession, name: str, inside: str, default: str) -> Iterator[None]:
    before = spark.conf.get(name, default)
    spark.conf.set(name, inside)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _shuffles_end_with_query(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries run inside delete their shuffle files when they end. Otherwise these stay until
    the driver's JVM happens to collect their plans, and add up over the steps of a job."""
    return _setting(spark, _CLEANUP, "true", "false")


def joins_as_dealt(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries run inside join tables as they are dealt, if by some of the keys of the join;
    otherwise Spark deals them again by all of its keys."""
    return _setting(spark, _ALL_KEYS, "false", "true")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a Parquet table and read it back.

    The result does not depend on executors that may be lost, is computed only
    once however often it is used, and has exact size statistics for planning. Its shuffle
    files go when it is written.
    """
    spark = df.sparkSession
    path = f"{durable_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_end_with_query(spark):
        df.write.parquet(path)
    _paths(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_dealt(df: DataFrame, label: str, keys: list[str], buckets: int) -> DataFrame:
    """``materialize`` as a table dealt to ``buckets`` by ``keys``, one file each: later joins
    and aggregations on them don't move its rows. ``df`` should come dealt the same way, so
    that every task writes one bucket.

    The table's entry in the catalogue is dropped with its files by ``run_scope``.
    """
    spark = df.sparkSession
    path = f"{durable_dir(spark)}/{label}-{uuid.uuid4().hex}"
    name = f"keyscape_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    with _shuffles_end_with_query(spark):
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    _paths(spark).append(path)
    _tables[path] = name
    return spark.table(name)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, what ``materialize`` has written inside. DataFrames made
    inside must be written or collected before."""
    written = _paths(spark)
    mark = len(written)
    try:
        yield
    finally:
        paths, written[mark:] = written[mark:], []
        conf = spark._jsc.hadoopConfiguration()
        for path in paths:
            if path in _tables:
                spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
