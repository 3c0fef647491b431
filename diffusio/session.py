"""Session helpers: the shared folder, written tables in it, and the package on executors."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch, where the session has Spark's default of 10,000: texts have kilobytes each, and a task holds
#: several copies of a batch.
BATCH_ROWS, _BATCH = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests) is a temporary folder made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-diffusio-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage, so that a lost executor costs tasks of one step only, and
    lets several readers share one computation. options: those of the Parquet writer.
    """
    return _kept(df, _path(df.sparkSession, name), **options)


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is written within it is deleted at its end, so results have to be written elsewhere or read by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            deleted(spark, path)


@contextmanager
def outside() -> Iterator[None]:
    """What is written within it belongs to no scope: it is kept for longer, as the edges of a graph are."""
    held, _SCOPES[:] = _SCOPES[:], []
    try:
        yield
    finally:
        _SCOPES[:] = held


def _path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def _kept(df: DataFrame, path: str, **options: str) -> DataFrame:
    df.write.options(**options).parquet(path)
    _freed(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a written table from which shuffle files are freed when it is written.
FREED_BYTES = 1 << 23


def _freed(spark: SparkSession, path: str) -> None:
    """Let Spark delete shuffle files that no plan needs any more: it does so for plans that the driver's JVM has collected.

    Else an iteration keeps those of all its steps on disk until the driver's heap happens to be full. Those of the
    last job stay until the next one.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength() >= FREED_BYTES:
        gc.collect()
        spark._jvm.System.gc()


class Bucketed(NamedTuple):
    """A written table in buckets, for joins by its keys, and the same files read without them.

    Spark takes the union of two scans by bucket as still dealt by the keys and leaves an exchange out
    that is needed, so only ``plain`` is handed out.
    """

    rows: DataFrame
    plain: DataFrame


def bucketed(df: DataFrame, name: str, *keys: str, dealt: bool = False) -> Bucketed:
    """Write df as written() does, dealt into buckets by keys.

    Joins and groups by the keys read the buckets as they are: df isn't shuffled again. The
    catalog knows the table for the moment only in which its plan is made. dealt: df comes from
    such buckets by the same keys, without a shuffle since, and isn't dealt anew.
    """
    spark, n = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"{name}_{uuid.uuid4().hex}".replace("-", "_"), _path(spark, name)
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).option("path", path).saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external one: its files stay
    _freed(spark, path)
    return Bucketed(rows, spark.read.schema(df.schema).parquet(path))


class Steps:
    """The states of an iteration: each is written, and the one before the last is deleted.

    The last but one is kept so that a job which still reads it can recover.
    """

    def __init__(self, keep: int = 2):
        self.keep, self._paths = keep, []

    def written(self, df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, dict[str, Any]]:
        """The written state, and aggregates of it that the same job computes."""
        path, seen = _path(df.sparkSession, name), None
        if aggregates:
            seen = Observation()
            df = df.observe(seen, *[v.alias(k) for k, v in aggregates.items()])
        out = _kept(df, path)
        self._paths.append(path)
        if len(self._paths) > self.keep:
            deleted(df.sparkSession, self._paths.pop(0))
        return out, (seen.get if seen is not None else {})

    def gone(self, spark: SparkSession) -> None:
        """Delete those that are left."""
        while self._paths:
            deleted(spark, self._paths.pop())


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (``addPyFile``), and see to small Arrow batches."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-ship-")), "diffusio.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("diffusio", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
