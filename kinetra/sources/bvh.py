"""Motion files: hierarchy and channels of BVH text, parsed by executors into one row per file.

Files are listed, and filtered by name, before any is read. Tasks list and open them through ``pyarrow.fs``, so that the driver
holds no list of files, and tasks are as many as bytes need, not as there are files. A store that only Spark reaches is
listed and opened by Spark's own reader, whose list of files lies in the driver. A file is one row, since its frames are
one block of text.
"""

from __future__ import annotations

import math
import os
import re
import uuid
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.functions.arrays import as_lists
from kinetra.sources.shared import arrow_path, qualified, written

SCHEMA = (
    "clip_id string, error string, frame_time double, n_frames int, names array<string>, parents array<int>, joint_idx array<int>, "
    "offsets array<array<double>>, euler_orders array<string>, joint_names array<string>, root array<array<double>>, joints array<array<array<double>>>"
)


#: Where the hierarchy ends: the number of frames and their time.
_MOTION = re.compile(r"\bMOTION\s+Frames:\s*(\S+)\s+Frame\s+Time:\s*(\S+)")


def parse_head(text: str) -> tuple[dict, list[list[str]], int]:
    """(what a file tells but its motion, each joint's channels, where the numbers begin)."""
    found = _MOTION.search(text)
    tokens = (text[: found.start()] + " MOTION" if found else text).split()
    at = 0

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("the file ends early")
        at += 1
        return tokens[at - 1]

    def expect(word: str) -> None:
        if (got := take()) != word:
            raise ValueError(f"{word} is expected, not {got}")

    names, parents, joint_idx, offsets, orders, channels = [], [], [], [], [], []
    expect("HIERARCHY")
    stack: list[int] = []
    while True:
        word = take()
        if word in ("ROOT", "JOINT", "End"):
            if word == "ROOT" and names or word != "ROOT" and not stack:
                raise ValueError(f"{word} out of place")
            parents.append(stack[-1] if stack else -1)
            name = take()
            if word == "End":
                names.append(f"{names[stack[-1]]}_end")
                joint_idx.append(-1)
            else:
                names.append(name)
                joint_idx.append(sum(j >= 0 for j in joint_idx))
            expect("{")
            stack.append(len(names) - 1)
            expect("OFFSET")
            offsets.append([float(take()) for _ in range(3)])
        elif word == "CHANNELS":
            own = [take() for _ in range(int(take()))]
            order = "".join(c[0] for c in own if c.endswith("rotation"))
            if sorted(order) != ["X", "Y", "Z"]:
                raise ValueError(f"joint {names[stack[-1]]} has rotation channels {order}")
            orders.append(order)
            channels.append(own)
        elif word == "}":
            if not stack:
                raise ValueError("} out of place")
            stack.pop()
        elif word == "MOTION":
            break
        else:
            raise ValueError(f"unknown word {word}")
    if stack or not names or len(channels) != sum(j >= 0 for j in joint_idx):
        raise ValueError("the hierarchy is not whole")
    if not found:
        raise ValueError("the file ends early")
    out = {"frame_time": float(found[2]), "n_frames": int(found[1]), "names": names, "parents": parents, "joint_idx": joint_idx, "offsets": offsets, "euler_orders": orders, "joint_names": [n for n, j in zip(names, joint_idx) if j >= 0]}
    return out, channels, found.end()


def parse_arrays(text: str) -> dict:
    """Hierarchy and motion of one file, with ``root`` (F, 3) and ``joints`` (F, J, 3) as arrays. Angles become radians, in each
    joint's own channel order; positions become x, y, z. A broken file raises ValueError."""
    out, channels, at = parse_head(text)
    frames, width = out["n_frames"], sum(map(len, channels))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        try:
            values = np.fromstring(text[at:], float, sep=" ")
        except (DeprecationWarning, ValueError) as e:
            raise ValueError("motion holds something that is no number") from e
    if len(values) != frames * width:
        raise ValueError(f"{frames} frames of {width} channels are expected, not {len(values)} numbers")
    values = values.reshape(frames, width)
    root, joints, col = np.zeros((frames, 3)), np.empty((frames, len(channels), 3)), 0
    for j, own in enumerate(channels):
        turn = 0
        for c in own:
            if c.endswith("rotation"):
                joints[:, j, turn] = values[:, col] * (math.pi / 180)
                turn += 1
            elif j == 0:
                root[:, "XYZ".index(c[0])] = values[:, col]
            col += 1
    return out | {"root": root, "joints": joints}


def parse(text: str) -> dict:
    """``parse_arrays`` with plain lists."""
    return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in parse_arrays(text).items()}


#: Arrow types of a file's columns, without clip_id and error.
_NUMBERS, _WORDS = pa.list_(pa.float64()), pa.list_(pa.string())
KINDS = {"frame_time": pa.float64(), "n_frames": pa.int32(), "names": _WORDS, "parents": pa.list_(pa.int32()), "joint_idx": pa.list_(pa.int32()), "offsets": pa.list_(_NUMBERS), "euler_orders": _WORDS, "joint_names": _WORDS, "root": pa.list_(_NUMBERS), "joints": pa.list_(pa.list_(_NUMBERS))}


def one_row(clip_id: str, error: str | None, clip: dict, columns: list[str], **more) -> pa.RecordBatch:
    """A file's row; its frames go to Arrow as they lie in memory."""
    own = {"clip_id": pa.array([clip_id], pa.string()), "error": pa.array([error], pa.string()), **{k: pa.array([v]) for k, v in more.items()}}
    for k, kind in KINDS.items():
        if k in columns and k not in own:
            v = clip.get(k)
            own[k] = as_lists(v[None]) if isinstance(v, np.ndarray) else pa.array([v], kind)
    return pa.RecordBatch.from_arrays([own[c] for c in columns], columns)


def write(path: str, clip: dict) -> None:
    """The reverse of ``parse``, for exports and tests; one file, on the driver."""
    lines = ["HIERARCHY"]
    children: dict[int, list[int]] = {}
    for n, p in enumerate(clip["parents"]):
        children.setdefault(p, []).append(n)

    def node(n: int, pad: str) -> None:
        j = clip["joint_idx"][n]
        kind = "ROOT" if clip["parents"][n] < 0 else "JOINT" if j >= 0 else "End"
        lines.extend([f"{pad}{kind} {clip['names'][n] if j >= 0 else 'Site'}", pad + "{", f"{pad}\tOFFSET " + " ".join(map(repr, map(float, clip["offsets"][n])))])
        if j >= 0:
            turn = [f"{a}rotation" for a in clip["euler_orders"][j]]
            own = [*(["Xposition", "Yposition", "Zposition"] if kind == "ROOT" else []), *turn]
            lines.append(f"{pad}\tCHANNELS {len(own)} " + " ".join(own))
        for c in children.get(n, []):
            node(c, pad + "\t")
        lines.append(pad + "}")

    node(0, "")
    lines += ["MOTION", f"Frames: {clip['n_frames']}", f"Frame Time: {clip['frame_time']!r}"]
    for r, j in zip(clip["root"], clip["joints"]):
        lines.append(" ".join(map(repr, [*map(float, r), *(math.degrees(x) for row in j for x in row)])))
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")


def write_texts(texts: DataFrame, folder: str, suffix: str = ".bvh") -> str:
    """Writes a file ``<clip_id><suffix>`` for each row of ``texts(clip_id, value)``, by executors, and returns the folder. A task
    that runs again writes the same files again, each in one go."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for stem, text in zip(b.column("clip_id").to_pylist(), b.column("value")):
                part = f"{root}/.{stem}-{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write((text.as_py() or "").encode())
                fs.move(part, f"{root}/{stem}{suffix}")
            yield pa.RecordBatch.from_arrays([b.column("clip_id")], ["clip_id"])

    texts.select("clip_id", "value").mapInArrow(run, "clip_id string").write.format("noop").mode("overwrite").save()
    return folder


def stem_of(name: Column) -> Column:
    """A file's name without its ending."""
    return F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)


#: Bytes of files that a task is planned with; a file counts as so many more, for opening it.
PARTITION_BYTES, FILE_BYTES = 16 << 20, 4 << 10
#: Names that end so are unpacked by Spark's codecs alone.
SPARK_CODECS = (".deflate", ".lz4", ".snappy")
#: Tasks that list sub-folders.
FOLDER_TASKS = 1000


def by_tasks(spark: SparkSession, folder: str, pattern: str = "*.bvh") -> str | None:
    """The qualified name of a folder that tasks can list and open, else None: globs, single files, packed files that only Spark
    unpacks, and stores that Arrow does not open, or whose times it tells in whole seconds (HDFS)."""
    if any(c in folder for c in "*?[]{}\\") or pattern.endswith(SPARK_CODECS):
        return None
    where = qualified(spark, folder)
    try:
        fs, inner = arrow_path(where)
        return where if fs.type_name != "hdfs" and fs.get_file_info(inner).type == pafs.FileType.Directory else None
    except (OSError, ValueError, pa.ArrowException):
        return None


def _inside(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, whether it is a folder, bytes, nanoseconds of the last change) of what Spark would see in a folder. Local folders are
    read a name at a time, however many there are."""
    fs, inner = arrow_path(folder)
    if fs.type_name == "local":
        with os.scandir(inner) as found:
            for e in found:
                try:
                    stat = e.stat()
                except FileNotFoundError:  # gone since
                    continue
                if _seen(e.name):
                    yield e.name, e.is_dir(), stat.st_size, stat.st_mtime_ns
    else:
        for i in fs.get_file_info(pafs.FileSelector(inner)):
            if _seen(i.base_name):
                yield i.base_name, i.type == pafs.FileType.Directory, i.size or 0, i.mtime_ns or 0


def _seen(name: str) -> bool:
    """Spark leaves out hidden names."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


_ENTRY = pa.schema([("name", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("below", pa.bool_())])


def _entries(folders: DataFrame, deep: bool) -> DataFrame:
    """What lies in the folders: files with bytes, and sub-folders named key=value (``below``), or, if ``deep``, the files in these."""

    def walk(folder: str) -> Iterator[tuple]:
        for name, below, size, changed in _inside(folder):
            path = f"{folder.rstrip('/')}/{name}"
            if below and "=" in name:
                if deep:
                    yield from walk(path)
                else:
                    yield name, path, None, None, True
            elif not below and size > 0:
                yield name, path, size, changed // 1_000_000 * 1000, False  # to the millisecond, as Spark tells it

    def run(batches):
        for b in batches:
            for folder in b.column("path").to_pylist():
                held: list[tuple] = []
                for entry in walk(folder):
                    held.append(entry)
                    if len(held) == 10_000:
                        yield batch(held)
                        held = []
                yield batch(held)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ENTRY)], schema=_ENTRY)

    return folders.select("path").mapInArrow(run, "name string, path string, bytes long, modified timestamp, below boolean")


def listing(spark: SparkSession, folder: str, pattern: str = "*.bvh") -> DataFrame:
    """``clip_id, path, bytes, modified`` of the files, of which none is opened, as they are now; those in sub-folders named key=value are
    among them. A task lists the folder into a table, others the sub-folders."""
    where = by_tasks(spark, folder, pattern)
    if where is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        return files.select(stem_of(F.element_at(F.split("path", "/"), -1)).alias("clip_id"), "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    found = written(_entries(spark.createDataFrame([(where,)], "path string").coalesce(1), deep=False), "names")
    below = found.where("below")
    if n := below.count():
        inner = written(_entries(below.repartition(min(n, FOLDER_TASKS), "path"), deep=True), "names")
        found = found.unionByName(inner)
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()  # as Spark's pathGlobFilter reads it
    return found.where(~F.col("below") & F.col("name").rlike(f"(?s)^(?:{glob})\\z")).select(stem_of(F.col("name")).alias("clip_id"), "path", "bytes", "modified")


def scan(spark: SparkSession, folder: str | list[str] | DataFrame, pattern: str = "*.bvh", keep: Callable[[Column], Column] | None = None, skip_errors: bool = False) -> DataFrame:
    """One row per file of a folder, of a list of files, or of a table of files that tasks can open (``listing``), see ``SCHEMA``;
    ``clip_id`` is the file's name without its ending.

    ``keep(stem)`` is a condition on names; files it leaves out are not parsed. A broken file raises, or, with
    ``skip_errors``, stays as a row with ``error`` alone (``good`` leaves such rows out).
    """
    if isinstance(folder, str) and by_tasks(spark, folder, pattern):
        folder = listing(spark, folder, pattern)
    if isinstance(folder, DataFrame):
        return parse_files(folder if keep is None else folder.where(keep(F.col("clip_id"))), skip_errors)
    listed = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)  # no other file is opened
    stem = stem_of(F.col("_metadata.file_name"))
    files = listed.select(stem.alias("clip_id"), F.col("value"))
    if keep is not None:
        files = files.where(keep(stem))

    return parse_rows(files, skip_errors)


def parse_files(files: DataFrame, skip_errors: bool = False) -> DataFrame:
    """``files(clip_id, path, bytes)`` to rows of ``SCHEMA``; each is opened by the task that parses it."""
    columns = ["clip_id", "error", *KINDS]
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(files.sparkSession.sparkContext.defaultParallelism, -(-(total + n * FILE_BYTES) // PARTITION_BYTES))))

    def run(parts):
        for part in parts:
            for stem, path in zip(part.column("clip_id").to_pylist(), part.column("path").to_pylist()):
                fs, inner = arrow_path(path)
                with fs.open_input_stream(inner) as file:
                    data = file.read()
                yield _parsed_row(stem, data.decode, columns, skip_errors)

    return files.select("clip_id", "path").repartition(tasks, "path").mapInArrow(run, SCHEMA)


def parse_rows(files: DataFrame, skip_errors: bool = False) -> DataFrame:
    """``files(clip_id, value)``, a file's whole text each, to rows of ``SCHEMA``, one file at a time."""
    columns = ["clip_id", "error", *KINDS]

    def run(parts):
        for part in parts:
            for stem, text in zip(part.column("clip_id").to_pylist(), part.column("value")):
                yield _parsed_row(stem, text.as_py, columns, skip_errors)

    return files.select("clip_id", "value").mapInArrow(run, SCHEMA)


def _parsed_row(stem: str, text: Callable[[], str], columns: list[str], skip_errors: bool) -> pa.RecordBatch:
    try:
        error, clip = None, parse_arrays(text())
    except (ValueError, IndexError) as e:
        if not skip_errors:
            raise ValueError(f"{stem}: {e}") from e
        error, clip = str(e), {}
    return one_row(stem, error, clip, columns)


class _ParseMotion:
    """Table function over a table of ``clip_id, value``: a row of ``SCHEMA`` for each; broken texts have ``error`` alone."""

    def eval(self, texts: pa.RecordBatch) -> Iterator[pa.Table]:
        columns = ["clip_id", "error", *KINDS]
        for stem, text in zip(texts.column("clip_id").to_pylist(), texts.column("value")):
            try:
                error, clip = None, parse_arrays(text.as_py() or "")
            except (ValueError, IndexError) as e:
                error, clip = str(e), {}
            yield pa.Table.from_batches([one_row(stem, error, clip, columns)])


def register_parser(spark: SparkSession, name: str = "parse_motion") -> str:
    """Makes the parser a table function of the session's SQL: ``SELECT ... FROM parse_motion(TABLE(texts))``, where the table has
    ``clip_id`` and ``value``, a file's whole text. Files go through Arrow batches; one text is parsed at a time."""
    spark.udtf.register(name, F.arrow_udtf(_ParseMotion, returnType=SCHEMA))
    return name


def require_files(clips: DataFrame, folder: str) -> None:
    if clips.select("clip_id").isEmpty():
        raise FileNotFoundError(f"no motion files in {folder}")


def good(clips: DataFrame) -> DataFrame:
    return clips.where("error is null")


def warn_skipped(clips: DataFrame) -> None:
    """Warns of files that could not be read, and names up to five."""
    bad = clips.where("error is not null")
    few = bad.orderBy("clip_id").select("clip_id", "error").limit(5).collect()
    if few:
        warnings.warn(f"{bad.count()} files are skipped, e.g. " + "; ".join(f"{r['clip_id']}: {r['error']}" for r in few), stacklevel=3)


def frames(clips: DataFrame, *keep: str) -> DataFrame:
    """Frame rows ``clip_id, t, root_pos, joint_rot`` with Euler angles in radians, each joint's in its clip's own channel
    order, and the columns ``keep`` of the clip on each."""
    rows = good(clips).select("clip_id", *keep, F.posexplode(F.arrays_zip("root", "joints")).alias("t", "f"))
    return rows.select("clip_id", "t", F.col("f.root").alias("root_pos"), F.col("f.joints").alias("joint_rot"), *keep)


def skeletons(clips: DataFrame) -> DataFrame:
    """The skeleton table of all clips, keyed by ``skeleton`` = clip_id."""
    rows = good(clips).select("clip_id", "euler_orders", F.posexplode(F.arrays_zip("names", "parents", "joint_idx", "offsets")).alias("node", "n"))
    none = lambda c: F.when(F.col(c) >= 0, F.col(c))
    off = lambda i: F.col("n.offsets")[i]
    return rows.select(F.col("clip_id").alias("skeleton"), "node", F.col("n.names").alias("name"), none("n.parents").alias("parent"), none("n.joint_idx").alias("joint_idx"), off(0).alias("off_x"), off(1).alias("off_y"), off(2).alias("off_z"), F.when(F.col("n.joint_idx") >= 0, F.col("euler_orders")[F.greatest(F.col("n.joint_idx"), F.lit(0))]).alias("euler_order"))
