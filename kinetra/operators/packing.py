"""Packing frames into flat, (T, V, C) and (C, T, V) tensors, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.operators.temporal import materialize
from kinetra.schema import DEFAULT_STREAMS, LAYOUTS, channel_count, check_root_channels, split_root, width_of


def flat_row(streams) -> Column:
    """The streams of a frame end to end, in the order given."""
    return F.concat(*(F.col(s) if s == "root_pos" else F.flatten(s) for s in streams))


def vertex_rows(streams, representation: str = "6d") -> Column:
    """(V, C) of a frame: the root, if asked for, is vertex 0; per-vertex streams share the channel axis."""
    root, rest = split_root(streams)
    widths = [width_of(s, representation) for s in rest]
    total = channel_count(root, widths)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    body = None
    for s in rest:
        body = F.col(s) if body is None else F.zip_with(body, F.col(s), lambda a, b: F.concat(a, b))
    if body is not None and sum(widths) < total:
        body = F.transform(body, lambda v: F.concat(v, zeros(total - sum(widths))))
    if not root:
        return body
    first = F.array(F.concat(F.col("root_pos"), zeros(total - 3)) if total > 3 else F.col("root_pos"))
    return first if body is None else F.concat(first, body)


def pack_flat(frames: DataFrame, streams=DEFAULT_STREAMS, centering: str | None = "world", center: bool = True) -> DataFrame:
    """``clip_id, t, data array<double>``."""
    return materialize(frames, streams, centering, center).select("clip_id", "t", flat_row(streams).alias("data"))


def pack_tvc(frames: DataFrame, streams=DEFAULT_STREAMS, representation: str = "6d", centering: str | None = "world", center: bool = True) -> DataFrame:
    """``clip_id, t, data array<array<double>>``: a (V, C) matrix per frame."""
    return materialize(frames, streams, centering, center).select("clip_id", "t", vertex_rows(streams, representation).alias("data"))


def clip_arrays(packed: DataFrame, *keep: str) -> DataFrame:
    """``clip_id, data``: the frames' data in the order of t. One clip is one row, as its tensor is."""
    rows = F.array_sort(F.collect_list(F.struct("t", "data")))
    return packed.groupBy("clip_id", *keep).agg(F.transform(rows, lambda r: r["data"]).alias("data"))


def to_ctv(data: Column) -> Column:
    """(T, V, C) -> (C, T, V)."""
    return F.transform(F.sequence(F.lit(0), F.size(data[0][0]) - 1), lambda c: F.transform(data, lambda frame: F.transform(frame, lambda v: v[c])))


def pack_ctv(frames: DataFrame, streams=DEFAULT_STREAMS, representation: str = "6d", centering: str | None = "world", center: bool = True) -> DataFrame:
    """``clip_id, data array<array<array<double>>>``."""
    clips = clip_arrays(pack_tvc(frames, streams, representation, centering, center))
    return clips.select("clip_id", to_ctv(F.col("data")).alias("data"))


def pack(frames: DataFrame, layout: str = "flat", **how) -> DataFrame:
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}")
    return {"flat": lambda representation="6d", **k: pack_flat(frames, **k), "tvc": lambda **k: pack_tvc(frames, **k), "ctv": lambda **k: pack_ctv(frames, **k)}[layout](**how)


def unpack_flat(packed: DataFrame, root_channels: int = 3, joint_channels: int = 3) -> DataFrame:
    """Frame rows of the default streams; a width that does not divide into joints is refused by the plan."""
    check_root_channels(root_channels)
    if joint_channels < 1:
        raise ValueError("joint_channels is at least 1")
    rest = F.size("data") - root_channels
    bad = F.raise_error(F.lit("the columns after the root do not divide into joints"))
    joints = F.when((rest < 0) | (rest % joint_channels != 0), bad).when(rest == 0, F.array().cast("array<array<double>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest((rest / joint_channels).cast("int") - 1, F.lit(0))), lambda j: F.slice("data", root_channels + 1 + j * joint_channels, joint_channels))
    )
    return packed.select("clip_id", "t", F.slice("data", 1, root_channels).alias("root_pos"), joints.alias("joint_rot"))


def unpack_tvc(packed: DataFrame, root_channels: int = 3) -> DataFrame:
    check_root_channels(root_channels)
    return packed.select("clip_id", "t", F.slice(F.col("data")[0], 1, root_channels).alias("root_pos"), F.slice("data", 2, F.greatest(F.size("data") - 1, F.lit(0))).alias("joint_rot"))


def unpack_ctv(packed: DataFrame, root_channels: int = 3) -> DataFrame:
    channels = F.sequence(F.lit(0), F.size("data") - 1)
    frame = lambda t: F.transform(F.sequence(F.lit(0), F.size(F.col("data")[0][0]) - 1), lambda v: F.transform(channels, lambda c: F.col("data")[c][t][v]))
    frames = F.transform(F.sequence(F.lit(0), F.size(F.col("data")[0]) - 1), frame)
    return unpack_tvc(packed.select("clip_id", F.posexplode(frames).alias("t", "data")), root_channels)


def cells(frames: DataFrame, stream: str) -> DataFrame:
    """``clip_id, t, v, c, value``: one row per number of a stream."""
    if stream == "root_pos":
        return frames.select("clip_id", "t", F.lit(0).alias("v"), F.posexplode(stream).alias("c", "value"))
    rows = frames.select("clip_id", "t", F.posexplode(stream).alias("v", "_x"))
    return rows.select("clip_id", "t", "v", F.posexplode("_x").alias("c", "value"))
