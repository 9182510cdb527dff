"""Centring, derivatives and sequence lengths over frame rows.

Each operator shuffles by clip once (a window over ``clip_id``) and is otherwise an explode or an
expression: windows and resampling send each frame to the outputs that need it, so there are no joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions.rotations import map2, slerp
from kinetra.schema import DERIVED, check_streams, present, require_centering


def clip_window():
    return Window.partitionBy("clip_id")


def in_order():
    return Window.partitionBy("clip_id").orderBy("t")


def is_nested(stream: str) -> bool:
    return stream != "root_pos"


def zip_stream(stream: str, a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` over two values of one stream, number by number."""
    if not is_nested(stream):
        return map2(a, b, f)
    return F.zip_with(a, b, lambda p, q: map2(p, q, f))


def map_stream(stream: str, a: Column, f: Callable[[Column], Column]) -> Column:
    if not is_nested(stream):
        return F.transform(a, f)
    return F.transform(a, lambda p: F.transform(p, f))


def lerp(stream: str, a: Column, b: Column, alpha: Column) -> Column:
    return zip_stream(stream, a, b, lambda x, y: (1 - alpha) * x + alpha * y)


def frame_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("clip_id").agg(F.count("*").cast("int").alias("n_frames"))


# ---- centring and derivatives -----------------------------------------------------------------


def center_root(frames: DataFrame, centering: str | None = None) -> DataFrame:
    """Puts the first frame's root at the origin; ``world`` and ``first`` positions move along,
    ``skeleton`` positions stay, and positions of unknown centering are refused."""
    require_centering(centering)
    positions = [s for s in ("joint_pos", "node_pos") if s in frames.columns]
    if positions and centering is None:
        raise ValueError("clips with positions need a known position centering to be centred")
    origin = F.first("root_pos").over(in_order())
    out = frames.withColumn("_origin", origin)
    moved = {"root_pos": map2(F.col("root_pos"), F.col("_origin"), lambda a, b: a - b)}
    if centering != "skeleton":
        for s in positions:
            moved[s] = F.transform(s, lambda p: map2(p, F.col("_origin"), lambda a, b: a - b))
    return out.withColumns(moved).drop("_origin")


def derive(frames: DataFrame, streams) -> DataFrame:
    """Adds derived streams: differences of order 1 or 2 between frames, 0 where a frame before is lacking."""
    wanted = [s for s in streams if s in DERIVED]
    out = frames
    for s in wanted:
        base, order = DERIVED[s]
        one, two = F.lag(base, 1).over(in_order()), F.lag(base, 2).over(in_order())
        held = out.withColumns({"_one": one, "_two": two} if order == 2 else {"_one": one})
        if order == 1:
            change = zip_stream(base, F.col(base), F.col("_one"), lambda a, b: a - b)
        else:
            first = zip_stream(base, F.col(base), F.col("_one"), lambda a, b: a - 2 * b)
            change = zip_stream(base, first, F.col("_two"), lambda a, b: a + b)
        zero = map_stream(base, F.col(base), lambda v: v * 0)
        out = held.withColumn(s, F.when(F.row_number().over(in_order()) <= order, zero).otherwise(change)).drop("_one", "_two")
    return out


def materialize(frames: DataFrame, streams, centering: str | None = "world", center: bool = False) -> DataFrame:
    """``clip_id, t`` and the streams asked for, centred if asked, then derived; nothing later derives again."""
    check_streams(streams, frames.columns, centering)
    base = center_root(frames, centering) if center else frames
    return derive(base, streams).select("clip_id", "t", *streams)


def joint_velocities(frames: DataFrame, frame_time: float | Column, stream: str = "joint_pos") -> DataFrame:
    """Adds ``velocities``: central differences over time, one-sided at the ends, 0 for a lone frame. ``frame_time`` may
    be a column, constant in a clip."""
    n = F.count("*").over(clip_window())
    before, after = F.coalesce(F.lag(stream).over(in_order()), F.col(stream)), F.coalesce(F.lead(stream).over(in_order()), F.col(stream))
    steps = F.when((F.col("t") == 0) | (F.col("t") == n - 1), F.lit(1.0)).otherwise(F.lit(2.0))
    held = frames.withColumns({"_a": before, "_b": after, "_s": steps * frame_time})
    return held.withColumn("velocities", zip_stream(stream, F.col("_b"), F.col("_a"), lambda b, a: (b - a) / F.col("_s"))).drop("_a", "_b", "_s")


def foot_contacts(frames: DataFrame, feet: list[int], up: int | Column, max_height: float | Column, max_speed: float | Column) -> DataFrame:
    """Adds ``foot_contacts array<int>``: 1 where a foot is low over the clip's lowest foot and slow between frames. The
    up axis (0 to 2) and the limits may be columns, constant in a clip."""
    if not feet:
        return frames.withColumn("foot_contacts", F.array().cast("array<int>"))
    height = lambda j: F.get(F.col("joint_pos")[j], up if isinstance(up, Column) else F.lit(up))
    heights = F.array(*(height(j) for j in feet))
    floor = F.min(F.array_min(heights)).over(clip_window())
    before = F.coalesce(F.lag("joint_pos").over(in_order()), F.col("joint_pos"))
    held = frames.withColumns({"_floor": floor, "_before": before})
    step = lambda j: F.sqrt(sum((F.pow(F.col("joint_pos")[j][i] - F.col("_before")[j][i], F.lit(2.0)) for i in range(3)), F.lit(0.0)))
    one = lambda j: ((height(j) - F.col("_floor") <= max_height) & (step(j) <= max_speed)).cast("int")
    return held.withColumn("foot_contacts", F.array(*(one(j) for j in feet))).drop("_floor", "_before")


# ---- windows and lengths ----------------------------------------------------------------------


def sliding_windows(frames: DataFrame, size: int, stride: int = 1, short: str = "skip") -> DataFrame:
    """Each frame once for each window that has it: adds ``window`` (from 0) and ``o``, its place in it.

    A clip of T frames has (T - size) // stride + 1 windows; an incomplete one at the end is left out. A clip shorter than a
    window has no row, or, with ``short="refuse"``, is refused by name when the plan runs."""
    if short not in ("skip", "refuse"):
        raise ValueError("short clips are skipped or refused")
    if short == "refuse":
        n, said = F.count("*").over(clip_window()), F.concat(F.lit("clip "), F.col("clip_id").cast("string"), F.lit(f" is shorter than a window of {size} frames"))
        frames = frames.withColumn("t", F.when(n < size, F.raise_error(said).cast("int")).otherwise(F.col("t")))
    if size < 1 or stride < 1:
        raise ValueError("window size and stride are at least 1")
    last = F.floor((F.count("*").over(clip_window()) - size) / stride)
    low = F.greatest(F.lit(0), F.ceil((F.col("t") - size + 1) / stride))
    high = F.least(last, F.floor(F.col("t") / stride))
    held = frames.withColumns({"_low": low.cast("int"), "_high": high.cast("int")}).where("_low <= _high")
    out = held.withColumn("window", F.explode(F.sequence("_low", "_high")))
    return out.withColumn("o", (F.col("t") - F.col("window") * stride).cast("int")).drop("_low", "_high")


def _streams(df: DataFrame) -> list[str]:
    return [c for c in (*present(df.columns), *DERIVED) if c in df.columns]


def standardize(frames: DataFrame, length: int, method: str = "pad", pad_value: float = 0.0) -> DataFrame:
    """Clips of exactly ``length`` frames, with ``length`` the number of real ones: cut at the end and
    padded (pad), cut to the middle and padded (crop), or resampled along straight lines (resample_linear)."""
    if length < 1:
        raise ValueError("a target length is at least 1")
    if method == "resample_linear":
        return resample(frames, F.lit(length)).withColumn("length", F.lit(length))
    if method not in ("pad", "crop"):
        raise ValueError(f"unknown method {method!r}")
    n = F.count("*").over(clip_window())
    start = F.greatest(F.lit(0), F.floor((n - length) / 2)) if method == "crop" else F.lit(0)
    held = frames.withColumns({"_n": n, "_start": start.cast("int")}).withColumn("t", (F.col("t") - F.col("_start")).cast("int"))
    held = held.where(F.col("t").between(0, length - 1))
    kept = held.withColumn("length", F.least("_n", F.lit(length)).cast("int"))
    fill = {s: map_stream(s, F.col(s), lambda v: v * 0 + F.lit(float(pad_value))) for s in _streams(frames)}
    last = kept.where((F.col("t") == F.col("_n") - 1) & (F.col("_n") < length))
    pads = last.withColumns(fill).withColumn("t", F.explode(F.sequence(F.col("_n").cast("int"), F.lit(length - 1))))
    return kept.unionByName(pads).drop("_n", "_start")


def resample_pairs(frames: DataFrame, target: Column) -> DataFrame:
    """Rows of clips of ``target`` frames (a column, constant in a clip), evenly spaced over the same time: each has its two source
    frames, the later one's streams as ``_next_<stream>``, and ``_alpha``, its place between them.

    Output k lies between frames l = min(k (F-1) // (T-1), F-2) and l+1; each frame sends itself and the
    next to its outputs. One target frame is the first frame; a single source frame repeats.
    """
    streams = _streams(frames)
    held = frames.withColumns({"_n": F.count("*").over(clip_window()), "_m": target.cast("long"), **{f"_next_{s}": F.coalesce(F.lead(s).over(in_order()), F.col(s)) for s in streams}})
    f, m, t = F.col("_n") - 1, F.col("_m") - 1, F.col("t").cast("long")
    low = F.when((f == 0) | (m <= 0), F.lit(0)).otherwise(F.ceil(t * m / F.greatest(f, F.lit(1))))
    high = F.when(f == 0, m).when(m <= 0, F.when(t == 0, 0).otherwise(-1)).when(t == f, F.lit(-1)).when(t == f - 1, m).otherwise(F.ceil((t + 1) * m / F.greatest(f, F.lit(1))) - 1)
    # exact whole-number bounds: k belongs to t when t (T-1) <= k (F-1) < (t+1) (T-1)
    sent = held.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).where("_low <= _high").withColumn("_k", F.explode(F.sequence("_low", "_high")))
    alpha = F.when((f == 0) | (m <= 0), F.lit(0.0)).otherwise((F.col("_k") * f - t * m) / F.greatest(m, F.lit(1)).cast("double"))
    return sent.withColumn("_alpha", alpha).withColumn("t", F.col("_k").cast("int")).drop("_n", "_m", "_k", "_low", "_high")


def resample(frames: DataFrame, target: Column, rotations: str | None = None) -> DataFrame:
    """Clips of ``target`` frames, see ``resample_pairs``. Streams go along straight lines; with ``rotations="quat"``, joint_rot
    along the shortest arc."""
    out, new = resample_pairs(frames, target), {}
    for s in _streams(frames):
        if s == "joint_rot" and rotations == "quat":
            new[s] = F.zip_with(s, f"_next_{s}", lambda p, q: slerp(p, q, F.col("_alpha")))
        else:
            new[s] = lerp(s, F.col(s), F.col(f"_next_{s}"), F.col("_alpha"))
    return out.withColumns(new).drop("_alpha", *(f"_next_{s}" for s in new))


# ---- uniform temporal sampling ----------------------------------------------------------------


def temporal_indices(clips: DataFrame, length: int, mode: str = "train", draw: Callable[[Column], Column] | None = None, start_draw: Column | None = None, with_counts: bool = False) -> DataFrame:
    """``clips(clip_id, n_frames, ...)`` -> rows ``clip_id, i, idx`` of ``length`` sampled frames (and ``n_frames``, which
    spares ``sample_frames`` from counting again).

    Long clips (2 lengths or more) take one frame of each of ``length`` segments; clips between one and
    two lengths take a run with gaps put in; short clips a run from a random start (from 0 in test mode),
    which may pass the end and is taken modulo the clip's length by ``sample_frames``. ``draw(i)`` and
    ``start_draw`` are uniforms in [0, 1): columns, so any table or hash can be the source of chance.
    """
    if length < 1:
        raise ValueError("a clip length is at least 1")
    if mode not in ("train", "test"):
        raise ValueError("mode is train or test")
    draw = draw or (lambda i: unit_hash(F.lit("sample"), F.col("clip_id"), i) if mode == "train" else portable_hash(F.lit("test"), i))
    start_draw = start_draw if start_draw is not None else draw(F.lit(-1))
    n, size = F.col("n_frames"), F.lit(length)
    i = F.sequence(F.lit(0), F.lit(length - 1))
    start = F.floor(start_draw * n) if mode == "train" else F.lit(0)
    short = F.transform(i, lambda k: start + k)
    segment = lambda k: F.floor(k * n / size)
    long = F.transform(i, lambda k: segment(k) + F.floor(draw(k) * (segment(k + 1) - segment(k))))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), size), lambda k: F.struct(draw(k).alias("u"), k.alias("k"))))
    gaps = F.transform(F.slice(order, 1, F.greatest(n - size, F.lit(0)).cast("int")), lambda s: s["k"])
    dense = F.transform(i, lambda k: k + F.size(F.filter(gaps, lambda g: g <= k)))
    chosen = F.when(n < size, short.cast("array<bigint>")).when(n < 2 * size, dense.cast("array<bigint>")).otherwise(long.cast("array<bigint>"))
    return clips.where("n_frames > 0").select("clip_id", *(["n_frames"] if with_counts else []), F.posexplode(chosen).alias("i", "idx"))


def temporal_samples(clips: DataFrame, length: int, num_samples: int = 1, mode: str = "train", key: Column | None = None) -> DataFrame:
    """``num_samples`` independent draws of ``temporal_indices``, told apart by ``sample`` (from 0). In test mode they are
    different from each other, and the same in every call."""
    if num_samples < 1:
        raise ValueError("at least one sample is asked for")
    who = [F.lit("sample"), key if key is not None else F.lit(0), F.col("clip_id")] if mode == "train" else [F.lit("test")]
    out = None
    for k in range(num_samples):
        one = temporal_indices(clips, length, mode, lambda i: unit_hash(*who, F.lit(k), i)).withColumn("sample", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def sample_frames(frames: DataFrame, indices: DataFrame) -> DataFrame:
    """Frames at ``idx`` modulo the clip's length, in the order of ``i`` (which becomes ``t``). A column ``sample`` of the
    indices, which tells several draws apart, is kept."""
    keep = [c for c in ("sample",) if c in indices.columns]
    if "n_frames" not in indices.columns:
        indices = indices.join(frame_counts(frames), "clip_id")
    at = indices.select("clip_id", *keep, F.col("i").cast("int").alias("_i"), F.pmod("idx", F.col("n_frames")).cast("int").alias("t"))
    return frames.join(at, ["clip_id", "t"]).withColumn("t", F.col("_i")).drop("_i")


def unit_hash(*parts: Column) -> Column:
    """A uniform number in [0, 1) of 53 bits, hashed from the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def portable_hash(*parts: Column) -> Column:
    """A uniform number in [0, 1) of 52 bits, from the md5 of the parts joined by colons: other engines give the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def apply_temporal(frames: DataFrame, length: int | None, how: str = "pad", draw: Callable[[Column], Column] | None = None) -> DataFrame:
    """One rule for all streams of a clip, with ``length`` the number of valid frames. ``draw(i)`` is the uniform number
    by which ``resample`` picks frame i (see ``temporal_indices``)."""
    if how not in ("pad", "crop", "resample", "resample_deterministic"):
        raise ValueError(f"unknown temporal rule {how!r}")
    if length is None:
        if how != "pad":
            raise ValueError(f"{how} needs a target length")
        return frames.withColumn("length", F.count("*").over(clip_window()).cast("int"))
    if how in ("pad", "crop"):
        return standardize(frames, length, how)
    clips = frame_counts(frames)
    if how == "resample":
        picks = temporal_indices(clips, length, "train", draw or (lambda i: unit_hash(F.lit(0), F.col("clip_id"), i)), with_counts=True)
    else:
        picks = temporal_indices(clips, length, "test", with_counts=True)
    return sample_frames(frames, picks).withColumn("length", F.lit(length))
