"""A Spark data source for motion files: ``spark.read.format("motion")``.

Files are listed once, filters on names are pushed into the listing, and files are dealt to partitions by size. What a
query does not ask for is not read: a query of names alone opens no file, one of hierarchies reads each file's head, and
only ``root`` and ``joints`` make it parse motion. Files are opened through ``pyarrow.fs``; ``bvh.scan`` reads stores that only
Spark reaches.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from kinetra.sources import bvh

#: Bytes of files that a partition is planned with, and bytes that are read at a time for a head.
PARTITION_BYTES, HEAD_BYTES = 64 << 20, 64 << 10
#: ``bytes`` is a file's size, ``bytes_read`` what this query read of it.
SCHEMA = bvh.SCHEMA + ", path string, bytes long, bytes_read long"
_NAMES = {"clip_id", "path", "bytes", "bytes_read"}
_MOTION = {"root", "joints"}


def _tests(f: ds.Filter):
    """A filter on clip_id as a test of a stem, or None where the source can't apply it."""
    if getattr(f, "attribute", None) != ("clip_id",):
        return None
    value = getattr(f, "value", None)
    kinds = {
        ds.EqualTo: lambda s: s == value,
        ds.EqualNullSafe: lambda s: s == value,
        ds.In: lambda s: s in value,
        ds.IsNotNull: lambda s: True,
        ds.IsNull: lambda s: False,
        ds.StringStartsWith: lambda s: s.startswith(value),
        ds.StringEndsWith: lambda s: s.endswith(value),
        ds.StringContains: lambda s: value in s,
        # Spark compares strings as UTF-8 bytes
        ds.GreaterThan: lambda s: s.encode() > value.encode(),
        ds.GreaterThanOrEqual: lambda s: s.encode() >= value.encode(),
        ds.LessThan: lambda s: s.encode() < value.encode(),
        ds.LessThanOrEqual: lambda s: s.encode() <= value.encode(),
    }
    return kinds.get(type(f))


class MotionFiles(ds.DataSource):
    """Options: ``path`` (a folder, or several split by commas), ``pattern``, ``recursive``, ``skip_errors``, ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "motion"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MotionReader:
        return MotionReader(schema, self.options)


class Files(ds.InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(files)
        self.files = files


class MotionReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options) -> None:
        self.columns = schema.names
        self.folders = [x for x in options.get("path", "").split(",") if x]
        if not self.folders:
            raise ValueError("motion files need a path")
        flag = lambda name: options.get(name, "false").lower() == "true"
        self.pattern, self.recursive, self.skip = options.get("pattern", "*.bvh"), flag("recursive"), flag("skip_errors")
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))
        if unknown := set(self.columns) - {"error", *_NAMES, *bvh.KINDS}:
            raise ValueError(f"motion files have no columns {sorted(unknown)}")
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            own = f.child if isinstance(f, ds.Not) else f
            if _tests(own) is None:
                yield f
            else:
                self.filters.append(f)

    def keeps(self, stem: str) -> bool:
        return all((not _tests(f.child)(stem)) if isinstance(f, ds.Not) else _tests(f)(stem) for f in self.filters)

    def partitions(self) -> list[Files]:
        """Files that pass, largest first to the emptiest of as many partitions as their bytes make."""
        found: list[tuple[str, int]] = []
        for folder in self.folders:
            fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
            prefix = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
            for info in fs.get_file_info(pafs.FileSelector(root, recursive=self.recursive)):
                if info.type == pafs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern) and self.keeps(_stem(info.base_name)):
                    found.append((prefix + info.path, info.size))
        groups = max(1, min(len(found), -(-sum(n for _, n in found) // self.size)))
        dealt: list[list[tuple[str, int]]] = [[] for _ in range(groups)]
        loads = [0] * groups
        for path, n in sorted(found, key=lambda x: (-x[1], x[0])):
            at = loads.index(min(loads)) if groups <= 1000 else len(dealt[0]) % groups
            dealt[at].append((path, n))
            loads[at] += n + 4096
        return [Files(sorted(g)) for g in dealt]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        asked = set(self.columns)
        for path, size in partition.files:
            stem, error, clip, read = _stem(path.rpartition("/")[2]), None, {}, 0
            if not asked <= _NAMES:
                fs, own = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
                try:
                    with fs.open_input_stream(own) as file:
                        if asked & _MOTION:
                            data = file.read()
                            read = len(data)
                            clip = bvh.parse_arrays(data.decode())
                        else:
                            text, read = _head(file)
                            clip = bvh.parse_head(text)[0]
                except (ValueError, IndexError) as e:
                    if not self.skip:
                        raise ValueError(f"{stem}: {e}") from e
                    error = str(e)
            yield bvh.one_row(stem, error, clip, self.columns, path=path, bytes=size, bytes_read=read)


def _stem(name: str) -> str:
    return name.rpartition(".")[0] if "." in name else name


def _head(file) -> tuple[str, int]:
    """The text up to where the numbers begin, and the bytes that were read for it."""
    data = b""
    while True:
        more = file.read(HEAD_BYTES)
        data += more
        text = data.decode(errors="ignore")
        found = bvh._MOTION.search(text)
        if found and (found.end() < len(text) or not more) or not more:  # a number may go on in the next piece
            return text, len(data)


def motion_files(spark: SparkSession, folder: str, columns: str | None = None, **options) -> DataFrame:
    """Rows of the files in ``folder``: the columns of a schema such as ``"clip_id string, names array<string>"``, all by default.

    Only what the columns need is read, so ask for those that are used; options are those of ``MotionFiles``. Filters on clip_id
    are applied before a file is opened. With columns of heads alone, ``error`` tells of broken heads only."""
    spark.dataSource.register(MotionFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("motion").schema(columns or SCHEMA)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(folder)


def heads(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Hierarchies, frame counts and times of the files, as ``bvh.skeletons`` and the audit take them; no motion is parsed."""
    return motion_files(spark, folder, "clip_id string, error string, " + ", ".join(x for x in bvh.SCHEMA.split(", ") if x.split()[0] not in {"clip_id", "error", *_MOTION}), **options)
