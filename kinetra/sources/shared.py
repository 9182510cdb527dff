"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place, with its scheme, under ``spark.checkpoint.dir``; only where that is unset and all tasks run in this
    process, under a temporary folder of our own. It goes with that folder, which the cluster cleans."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="kinetra-motion-")
        root = _own
    return qualified(spark, f"{root.rstrip('/')}/kinetra-{name}-{uuid.uuid4().hex}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark names it."""
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return named.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


@lru_cache(maxsize=64)
def _store(root: str) -> tuple[pafs.FileSystem, str]:
    fs, inner = pafs.FileSystem.from_uri(root)
    return fs, inner.rstrip("/")


def arrow_path(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a qualified path, and the path within it; names may hold blanks and percent signs."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, _, rest = path.partition("://")
    authority, slash, inner = rest.partition("/")
    fs, root = _store(f"{scheme}://{authority}")
    return fs, root + slash + inner


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written and reread: made once, whoever reads it, and safe when an executor is lost."""
    where = shared_folder(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
