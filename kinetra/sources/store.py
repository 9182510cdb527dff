"""Datasets on disk: Parquet tables of clips, frames, statistics, audit and metadata; ``.npz`` and HDF5 import and export."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetra.schema import STATIC_FEATURES, STREAMS

HDF5 = (".hdf5", ".h5")
ARCHIVES = (".npz", *HDF5)
SUFFIXES = (".npz", ".hdf5", ".h5", ".parquet", "")


def check_suffix(path: str) -> str:
    """The kind of store a path names, before any work is done."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"a dataset ends in one of {', '.join(s or '(none)' for s in SUFFIXES)}, not {suffix}")
    if suffix in HDF5:
        try:
            import h5py  # noqa: F401
        except ImportError as e:
            raise ImportError("HDF5 datasets need h5py") from e
    return suffix


@dataclass
class MotionDataset:
    """Tables of a dataset and its metadata (representation, centering, skeleton info, audit ...)."""

    frames: DataFrame
    clips: DataFrame
    stats: DataFrame
    meta: dict = field(default_factory=dict)
    audit: DataFrame | None = None


def part_folder(path: str, table: str, part: int) -> str:
    """Where a table's rows of one build lie: the first build's in ``<table>``, those of later ones in ``<table>-1`` and so on."""
    return f"{path}/{table}" + (f"-{part}" if part else "")


def save_frames(frames: DataFrame, path: str, part: int = 0) -> DataFrame:
    """Frames clustered by clip, so that one clip's are read from few row groups; returns what was written."""
    where = part_folder(path, "frames", part)
    frames.sortWithinPartitions("clip_id", "t").write.mode("overwrite").parquet(where)
    return frames.sparkSession.read.parquet(where)


def save(dataset: MotionDataset, path: str, frames: bool = True) -> None:
    """A folder of Parquet tables, or an archive where ``path`` ends like one. ``frames`` is off where ``save_frames`` has
    written them."""
    kind = check_suffix(path)
    if kind in ARCHIVES:
        return save_archive(dataset, path)
    spark = dataset.frames.sparkSession
    if frames:
        save_frames(dataset.frames, path)
    dataset.clips.write.mode("overwrite").parquet(f"{path}/clips")
    dataset.stats.write.mode("overwrite").parquet(f"{path}/stats")
    if dataset.audit is not None:
        dataset.audit.write.mode("overwrite").parquet(f"{path}/audit")
    save_meta(spark, dataset.meta, path)


def save_meta(spark: SparkSession, meta: dict, path: str) -> None:
    """Written last: it says how many builds the dataset has, so rows of one that did not finish are not read."""
    spark.createDataFrame([(json.dumps(meta),)], "json string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/meta").first()["json"])


def read_parts(spark: SparkSession, path: str, table: str, parts: int) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*(part_folder(path, table, k) for k in range(parts)))


def normalize_info(info: dict) -> dict:
    """Keys that older datasets lack become None, except those that are optional by design."""
    keys = ("num_joints", "joint_names", "edges", "euler_orders", "lr_pairs", "lr_mapping", "num_nodes", "node_names", "node_edges", "node_lr_pairs", "end_site_indices", "fk_topology", "mismatched_end_site_pairs", "world_up", "rest_forward", "rest_up")
    return {k: info.get(k) for k in keys} | info


def load(spark: SparkSession, path: str) -> MotionDataset:
    if check_suffix(path) in ARCHIVES:
        return load_archive(spark, path)
    meta = load_meta(spark, path)
    parts = meta.get("parts", 1)
    frames = legacy_columns(read_parts(spark, path, "frames", parts))
    if "skeleton_info" in meta:
        meta["skeleton_info"] = normalize_info(meta["skeleton_info"])
    if meta.get("representation") == "quat" and "joint_quats" not in frames.columns and meta.get("include_quaternions"):
        frames = frames.withColumn("joint_quats", F.col("joint_rot"))  # stored once
    held = read_parts(spark, path, "audit", parts) if meta.get("has_audit") else None
    return MotionDataset(frames, read_parts(spark, path, "clips", parts), spark.read.parquet(part_folder(path, "stats", parts - 1)), meta, held)


def legacy_columns(frames: DataFrame) -> DataFrame:
    """``joint_data`` is an old name of ``joint_rot``."""
    if "joint_data" not in frames.columns:
        return frames
    if "joint_rot" in frames.columns:
        return frames.withColumn("joint_rot", F.coalesce("joint_rot", "joint_data")).drop("joint_data")
    return frames.withColumnRenamed("joint_data", "joint_rot")


def save_archive(dataset: MotionDataset, path: str) -> None:
    """One NumPy or HDF5 file, made on the driver: for small datasets that leave the cluster."""
    out = archive_arrays(dataset)
    if check_suffix(path) in HDF5:
        write_hdf5(path, out)
    else:
        np.savez_compressed(path, **out)


save_npz = save_archive


def write_hdf5(path: str, arrays: dict) -> None:
    """Arrays of a clip go to its group ``clip_<i>``, texts are stored as UTF-8, single values as attributes."""
    import h5py

    with h5py.File(path, "w") as file:
        for name, value in arrays.items():
            clip = re.fullmatch(r"(clip_\d+)_(\w+)", name)
            group, own = (file.require_group(clip[1]), clip[2]) if clip else (file, name)
            if np.ndim(value) == 0:
                group.attrs[own] = "" if value is None else value
            elif np.asarray(value).dtype.kind == "U":
                group.create_dataset(own, data=[str(x) for x in value], dtype=h5py.string_dtype("utf-8"))
            else:
                group.create_dataset(own, data=np.asarray(value), compression="gzip")


def read_hdf5(path: str) -> dict:
    import h5py

    out: dict = {}
    with h5py.File(path, "r") as file:
        groups = [("", file), *((f"{k}_", v) for k, v in file.items() if re.fullmatch(r"clip_\d+", k))]
        for prefix, group in groups:
            out |= {f"{prefix}{k}": np.asarray(v) for k, v in group.attrs.items()}
            for k, v in group.items():
                if not re.fullmatch(r"clip_\d+", k):
                    data = v[()]
                    out[f"{prefix}{k}"] = np.array([x.decode() if isinstance(x, bytes) else str(x) for x in data]) if data.dtype.kind in "OS" else data
    return out


def archive_arrays(dataset: MotionDataset) -> dict:
    """The arrays of an archive by name."""
    columns = [c for c in (*STREAMS, *STATIC_FEATURES) if c in dataset.frames.columns]
    clips = sorted(r["clip_id"] for r in dataset.clips.select("clip_id").collect())
    number = {c: i for i, c in enumerate(clips)}
    out: dict = {"num_clips": len(clips), "filenames": np.array(clips), "representation": dataset.meta.get("representation"), "center_root": bool(dataset.meta.get("center_root"))}
    rows = F.array_sort(F.collect_list(F.struct("t", *columns)))
    for r in dataset.frames.groupBy("clip_id").agg(rows.alias("rows")).toLocalIterator():
        for c in columns:
            out[f"clip_{number[r['clip_id']]}_{c}"] = np.array([x[c] for x in r["rows"]])
    for block, prefix in (("features", ""), ("positions", "position_")):
        s = [r for r in dataset.stats.where(F.col("block") == block).orderBy("dim").collect()]
        if s:
            out |= {f"{prefix}mean": np.array([r["mean"] for r in s]), f"{prefix}std": np.array([r["std"] for r in s]), f"{prefix}constant_channels": np.array([r["constant"] for r in s])}
    if "label" in dataset.clips.columns:
        labels = {r["clip_id"]: r["label"] for r in dataset.clips.collect()}
        out["labels"] = np.array([labels[c] for c in clips], np.int64)
    out["skeleton_info_json"] = json.dumps(dataset.meta.get("skeleton_info", {}))
    uniformity = dict(dataset.meta.get("uniformity", {}))
    if dataset.audit is not None:  # names of clips by value, as the archive holds all clips anyway
        for r in dataset.audit.groupBy("axis", "value").agg(F.array_sort(F.collect_list("clip_id")).alias("stems")).collect():
            uniformity[r["axis"]] = {**uniformity.get(r["axis"], {}), r["value"]: r["stems"]}
    out["uniformity_json"] = json.dumps(uniformity)
    if dataset.meta.get("position_centering"):
        out["position_centering"] = dataset.meta["position_centering"]
    return out


def load_archive(spark: SparkSession, path: str) -> MotionDataset:
    if check_suffix(path) in HDF5:
        held = read_hdf5(path)
    else:
        with np.load(path, allow_pickle=False) as raw:
            held = {k: raw[k] for k in raw.files}
    names = [str(x) for x in held["filenames"]] if "filenames" in held else [str(i) for i in range(int(held["num_clips"]))]
    rows, have = [], set()
    for i, name in enumerate(names):
        clip = {c: held[f"clip_{i}_{c}"] for c in (*STREAMS, "joint_data", *STATIC_FEATURES) if f"clip_{i}_{c}" in held}
        if "joint_data" in clip:
            clip.setdefault("joint_rot", clip.pop("joint_data"))
        have |= clip.keys()
        rows += [{"clip_id": name, "t": t, **{c: v[t].tolist() for c, v in clip.items()}} for t in range(len(clip["root_pos"]))]
    kinds = {"root_pos": "array<double>", "foot_contacts": "array<int>"}
    schema = "clip_id string, t int, " + ", ".join(f"{c} {kinds.get(c, 'array<array<double>>')}" for c in (*STREAMS, *STATIC_FEATURES) if c in have)
    frames = spark.createDataFrame(rows, schema)
    labels = held.get("labels")
    clips = spark.createDataFrame([(n, None if labels is None else int(labels[i])) for i, n in enumerate(names)], "clip_id string, label long")
    stats = []
    for block, prefix in (("features", ""), ("positions", "position_")):
        if f"{prefix}mean" in held:
            flat = held.get(f"{prefix}constant_channels")
            stats += [(block, d, float(m), float(s), None if flat is None else bool(flat[d])) for d, (m, s) in enumerate(zip(held[f"{prefix}mean"], held[f"{prefix}std"]))]
    meta = {"representation": str(held.get("representation", "")) or None, "center_root": bool(held.get("center_root", False)), "position_centering": str(held["position_centering"]) if "position_centering" in held else None}
    if "skeleton_info_json" in held:
        meta["skeleton_info"] = normalize_info(json.loads(str(held["skeleton_info_json"])))
    if "uniformity_json" in held:
        meta["uniformity"] = json.loads(str(held["uniformity_json"]))
    return MotionDataset(frames, clips, spark.createDataFrame(stats, "block string, dim int, mean double, std double, constant boolean"), meta)
