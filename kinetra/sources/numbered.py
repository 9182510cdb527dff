"""Clips by number: clustered frames, a row group for each clip, and an index from numbers to files and row groups.

Clips are numbered in the order of clip_id and dealt to files of so many clips. One item reads one row group of one file, besides
the file's footer; the index is itself cut by number, so that a lookup reads a few rows of it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions.arrays import as_array
from kinetra.plans.feed import normalize_index
from kinetra.schema import STATIC_FEATURES, present
from kinetra.sources.shared import written

#: Clips of a file, rows of a part of the index, and clips that are numbered in one group.
FILE_CLIPS, INDEX_ROWS, RANGE_CLIPS = 256, 4096, 100_000


def numbers(clips: DataFrame) -> DataFrame:
    """``clip_id, number``: clips in the order of clip_id, from 0, without gaps. Ranges of clip_id are counted side by side."""
    ids = clips.select("clip_id").distinct()
    ranges = max(1, ids.count() // RANGE_CLIPS)
    held = written(ids.repartitionByRange(ranges, "clip_id").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy("clip_id")) - 1
    return held.withColumn("_own", own).join(before, "_range").select("clip_id", (F.col("_own") + F.col("_before")).cast("long").alias("number"))


def write(frames: DataFrame, clips: DataFrame, folder: str, file_clips: int = FILE_CLIPS) -> DataFrame:
    """Writes ``folder/frames`` (a file for each ``file_clips`` clips, a row group for each clip) and ``folder/index``; returns the
    index: ``number, clip_id, path, row_group, n_frames`` and the other columns of ``clips``.

    Clips without frames keep their number and have no row group. The streams of a clip fit a task. Only files that finished
    tasks name are in the index, so tasks that ran twice leave nothing behind in it."""
    spark = frames.sparkSession
    streams = [*present(frames.columns), *(c for c in STATIC_FEATURES if c in frames.columns)]
    known = written(numbers(clips), "numbers")
    held = frames.select("clip_id", "t", *streams).join(known, "clip_id").withColumn("file", F.floor(F.col("number") / file_clips).cast("long"))
    ordered = held.repartition("file").sortWithinPartitions("file", "number", "t")
    fs, root = _open(folder)
    fs.create_dir(f"{root}/frames", recursive=True)

    def run(batches):
        fs, root = _open(folder)
        writer, sink, file, groups, waiting, token = None, None, None, [], [], uuid.uuid4().hex

        def path() -> str:
            return f"frames/{file:08d}-{token}.parquet"

        def close_clip():
            nonlocal writer, sink
            if not waiting:
                return
            clip = pa.Table.from_batches(waiting).combine_chunks()
            if writer is None:
                sink = fs.open_output_stream(f"{root}/{path()}", compression=None)
                writer = pq.ParquetWriter(sink, clip.schema.remove(clip.schema.get_field_index("file")), compression="zstd")
            writer.write_table(clip.drop_columns(["file"]), row_group_size=max(1, clip.num_rows))
            groups.append((clip.column("number")[0].as_py(), path(), len([g for g in groups if g[1] == path()]), clip.num_rows))
            waiting.clear()

        def close_file():
            nonlocal writer, sink
            close_clip()
            if writer is not None:
                writer.close()
                sink.close()
            writer = sink = None

        for b in batches:
            number, own = b.column("number").to_numpy(), b.column("file").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for a, z in zip(cuts, cuts[1:]):
                if waiting and waiting[-1].column("number")[0].as_py() != number[a]:
                    close_clip()
                if own[a] != file:
                    close_file()
                    file = int(own[a])
                waiting.append(b.slice(a, z - a))
        close_file()
        if groups:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*groups), (pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["number", "path", "row_group", "n_frames"])

    made = written(ordered.mapInArrow(run, "number long, path string, row_group int, n_frames long"), "groups")
    extra = [c for c in clips.columns if c not in ("clip_id", "n_frames", "number", "path", "row_group")]
    index = known.join(made, "number", "left").join(clips.select("clip_id", *extra).dropDuplicates(["clip_id"]), "clip_id")
    index = index.select("number", "clip_id", "path", "row_group", F.coalesce("n_frames", F.lit(0).cast("long")).alias("n_frames"), *extra, F.floor(F.col("number") / INDEX_ROWS).cast("long").alias("part"))
    index.repartition("part").sortWithinPartitions("part", "number").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index").drop("part")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path.rstrip("/"))


class _Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, file) -> None:
        self.file, self.bytes, self.closed = file, 0, False

    def read(self, n: int = -1) -> bytes:
        out = self.file.read(n) if n is not None and n >= 0 else self.file.read()
        self.bytes += len(out)
        return out

    def __getattr__(self, name: str):
        return getattr(self.file, name)


class NumberedClips:
    """Clips of a folder by number, as a trainer reads them: ``clips[i]``, negative numbers from the end, ``len(clips)``.

    ``bytes_read`` counts what was read of data files since it was set."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = _open(folder)
        self.bytes_read = 0
        parts = [int(f.base_name.removeprefix("part=")) for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/index")) if f.base_name.startswith("part=")]
        self._held: tuple[int, dict[int, dict]] = (-1, {})
        self.size = max(self._part(max(parts))) + 1 if parts else 0

    def __len__(self) -> int:
        return self.size

    def _part(self, part: int) -> dict[int, dict]:
        if self._held[0] != part:
            files = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/index/part={part}"))
            rows = [r for f in files if f.path.endswith(".parquet") for r in pq.ParquetFile(self.fs.open_input_file(f.path)).read().to_pylist()]
            self._held = (part, {r["number"]: r for r in rows})
        return self._held[1]

    def entry(self, i: int) -> dict:
        """The index row of clip i."""
        i = normalize_index(i, self.size)
        return self._part(i // INDEX_ROWS)[i]

    def __getitem__(self, i: int) -> dict:
        """The clip's index row and its streams as arrays with frames first; no streams where it has no frames."""
        entry = self.entry(i)
        out = {k: v for k, v in entry.items() if k not in ("path", "row_group")}
        if entry["path"] is None:
            return out
        with self.fs.open_input_file(f"{self.root}/{entry['path']}") as raw:
            counted = _Counted(raw)
            table = pq.ParquetFile(pa.PythonFile(counted, mode="r")).read_row_group(entry["row_group"])
            self.bytes_read += counted.bytes
        if table.num_rows != entry["n_frames"] or table.column("clip_id")[0].as_py() != entry["clip_id"]:
            raise ValueError(f"clip {i}: the index and {entry['path']} disagree")
        return out | {c: as_array(table.column(c)) for c in table.column_names if c not in ("clip_id", "t", "number")}

    def __iter__(self):
        return (self[i] for i in range(self.size))
