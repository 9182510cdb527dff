"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir`` with its scheme, so that Spark and ``pyarrow.fs`` mean one place by it;
    a folder of our own only where it is unset and all tasks run in this process (local tests)."""
    global _own_root
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        fs, path = _path(spark, found)
        return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="kinetra-")
        _forget_at_exit(spark, _own_root)
    return _own_root


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, where: str) -> None:
    fs, path = _path(spark, where)
    fs.delete(path, True)


def _forget_at_exit(spark: SparkSession, where: str) -> None:
    def drop() -> None:
        try:
            remove(spark, where)
        except Exception:  # the JVM may be gone by now
            pass

    atexit.register(drop)


def bound_batches(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """Makes the session send Python workers small Arrow batches, so that very long texts can't fill a worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: Spark's setting by which an execution's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_here(spark: SparkSession):
    """While a table is written, whose plan is not run again, its shuffle files go with the execution."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Scratch:
    """Parquet tables of one operator call; ``table`` writes and rereads, ``drop`` frees early."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_root(spark)}/kinetra-{name}-{uuid.uuid4().hex}"
        self.count = 0
        _forget_at_exit(spark, self.root)

    def folder(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def table(self, df: DataFrame) -> DataFrame:
        where = self.folder()
        with shuffles_end_here(self.spark):
            df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._kinetra_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Frees tables that are not read again. Spark lets go of the plans, broadcasts and shuffles that made them when the driver
        collects its garbage, which after many small rounds may be late; so it is asked to."""
        for df in tables:
            remove(self.spark, df._kinetra_path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
