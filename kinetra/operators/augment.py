"""Augmentation steps as transforms of frame rows. Chance comes in as columns, never from a global state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetra.functions import rotations as R
from kinetra.operators.temporal import clip_window, lerp, resample, resample_pairs
from kinetra.schema import check_drop_rate, check_factor, check_sigma, parse_axis, present, require_representation

#: draw(stream-like key, v, c) -> a standard normal column, a function of clip_id, t, v and c.
Draw = Callable[[str, Column, Column], Column]


def positions(frames: DataFrame) -> list[str]:
    return [s for s in ("joint_pos", "node_pos") if s in frames.columns]


def _need(frames: DataFrame, stream: str, step: str) -> None:
    if stream not in frames.columns:
        raise ValueError(f"{step} needs clips with {stream}")


def _need_repr(frames: DataFrame, representation: str | None, step: str) -> None:
    if "joint_rot" in frames.columns:
        if representation is None:
            raise ValueError(f"{step} needs the representation of joint_rot")
        require_representation(representation)


def rotate_vertical(frames: DataFrame, *, angle, up_axis: str, representation: str | None = None, degrees: bool = False, euler_orders=None) -> DataFrame:
    """Turns the clip about the up axis through the world's origin: root and positions by the matrix, and of
    the rotations the root joint's only. ``angle`` is a number or a column (constant in a clip)."""
    axis, sign = parse_axis(up_axis)
    _need_repr(frames, representation, "rotate_vertical")
    a = angle if isinstance(angle, Column) else F.lit(float(angle))
    a = (F.radians(a) if degrees else a) * sign
    held = frames.withColumns({"_c": F.cos(a), "_s": F.sin(a)})
    i, j = (axis + 1) % 3, (axis + 2) % 3

    def turn(p: Column, at: int = 0) -> list[Column]:
        out = [p[at], p[at + 1], p[at + 2]]
        out[i], out[j] = F.col("_c") * p[at + i] - F.col("_s") * p[at + j], F.col("_s") * p[at + i] + F.col("_c") * p[at + j]
        return out

    new = {"root_pos": F.array(*turn(F.col("root_pos")))}
    for s in positions(frames):
        new[s] = F.transform(s, lambda p: F.array(*turn(p)))
    if "joint_rot" in frames.columns:
        order = euler_orders if euler_orders is None or isinstance(euler_orders, str) else euler_orders[0]
        if representation == "6d":
            first = lambda x: F.array(*turn(x), *turn(x, 3))
        else:
            q = R.axis_quat(axis, F.atan2("_s", "_c"))
            first = lambda x: R.from_quat(R.quat_multiply(q, R.to_quat(x, representation, order)), representation, order)
        bad = F.raise_error(F.lit("a clip without joints has no root joint to turn"))
        # bound, so that rotations which an earlier step works out are worked out once
        whole = lambda rot: F.when(F.size(rot) == 0, bad).otherwise(F.concat(F.array(R.bind(rot[0], first)), F.slice(rot, 2, F.greatest(F.size(rot) - 1, F.lit(0)))))
        new["joint_rot"] = R.bind(F.col("joint_rot"), whole)
    return held.withColumns(new).drop("_c", "_s")


def swap(data: Column, pairs: list[tuple[int, int]]) -> Column:
    """Left and right vertices exchanged; pairs that share a vertex are applied in order."""
    if not pairs:
        return data
    order: dict[int, int] = {}
    for a, b in pairs:
        order[a], order[b] = order.get(b, b), order.get(a, a)
    table = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return R.bind(data, lambda d: F.transform(F.sequence(F.lit(0), F.size(d) - 1), lambda i: d[F.coalesce(F.element_at(table, i), i)]))


def mirror(frames: DataFrame, *, lateral_axis: str, lr_joint_pairs=None, lr_node_pairs=None, representation: str | None = None, euler_orders=None) -> DataFrame:
    """Mirrors across the plane whose normal is the lateral axis: negates that component, swaps left and right,
    and reflects rotations. A list of pairs may be empty, but must be given for the streams at hand."""
    axis, _ = parse_axis(lateral_axis)
    _need_repr(frames, representation, "mirror")
    if lr_joint_pairs is None and ("joint_rot" in frames.columns or "joint_pos" in frames.columns):
        raise ValueError("mirror needs lr_joint_pairs for joint streams")
    if lr_node_pairs is None and "node_pos" in frames.columns:
        raise ValueError("mirror needs lr_node_pairs for node_pos")
    flip = lambda p: F.array(*(-p[k] if k == axis else p[k] for k in range(3)))
    new = {"root_pos": flip(F.col("root_pos"))}
    for s in positions(frames):
        new[s] = swap(F.transform(s, flip), lr_joint_pairs if s == "joint_pos" else lr_node_pairs)
    out = frames.withColumns(new)
    if "joint_rot" not in frames.columns:
        return out
    sign = [-1.0 if k == axis else 1.0 for k in range(3)]
    if representation == "6d":  # element (i, j) of the matrix changes sign by both of its axes
        turned = F.transform("joint_rot", lambda x: F.array(*(x[3 * j + i] * (sign[i] * sign[j]) for j in range(2) for i in range(3))))
    else:
        q = R.convert_joints(F.col("joint_rot"), representation, "quat", euler_orders)
        mirrored = F.transform(q, lambda x: F.array(x[0], *(x[k + 1] if k == axis else -x[k + 1] for k in range(3))))
        return _back(out.withColumn("joint_rot", mirrored), lr_joint_pairs, representation, euler_orders)
    return out.withColumn("joint_rot", swap(turned, lr_joint_pairs))


def _back(frames: DataFrame, pairs, representation: str, euler_orders) -> DataFrame:
    """Swaps quaternions, then converts, so that each joint keeps its own Euler order."""
    swapped = frames.withColumn("joint_rot", swap(F.col("joint_rot"), pairs))
    return swapped.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), "quat", representation, euler_orders))


def rotation_noise(frames: DataFrame, *, sigma, draw: Draw, representation: str | None = None, degrees: bool = False, euler_orders=None, refresh: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A turn about a random axis by a normal angle, before each rotation. Clips with positions need
    ``refresh``, which makes them anew from the rotations (see ``skeleton.refresh_positions``)."""
    check_sigma(sigma)
    _need(frames, "joint_rot", "rotation noise")
    _need_repr(frames, representation, "rotation noise")
    if positions(frames) and refresh is None:
        raise ValueError("rotation noise leaves positions stale: a skeleton to refresh them by is asked for")
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    s = F.radians(s) if degrees else s

    def noise(v: Column) -> Column:
        axis = F.array(*(draw("axis", v, F.lit(c)) for c in range(3)))

        def quat(a: Column) -> Column:
            size = F.when(R.norm(a, 3) < 1e-15, R.D(1)).otherwise(R.norm(a, 3))
            half = draw("angle", v, F.lit(0)) * s / 2
            return R.bind(size, lambda n: R.bind(half, lambda h: F.array(F.cos(h), *(F.sin(h) * a[c] / n for c in range(3)))))

        return R.bind(axis, quat)

    q = R.convert_joints(F.col("joint_rot"), representation, "quat", euler_orders)
    held = frames.withColumn("joint_rot", q)
    held = held.withColumn("joint_rot", F.transform("joint_rot", lambda x, v: R.normalize(R.quat_multiply(noise(v), x))))
    out = held.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), "quat", representation, euler_orders))
    return refresh(out) if positions(frames) else out


def root_noise(frames: DataFrame, *, sigma, draw: Draw, centering: str | None = None) -> DataFrame:
    """Adds one normal vector per frame to the root; positions in world or first centring move with it."""
    check_sigma(sigma)
    if positions(frames) and centering is None:
        raise ValueError("root noise on clips with positions needs their centering")
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    held = frames.withColumn("_d", F.array(*(draw("root", F.lit(0), F.lit(c)) * s for c in range(3))))
    new = {"root_pos": R.map2(F.col("root_pos"), F.col("_d"), lambda a, b: a + b)}
    if centering != "skeleton":
        for p in positions(frames):
            new[p] = F.transform(p, lambda x: R.map2(x, F.col("_d"), lambda a, b: a + b))
    return held.withColumns(new).drop("_d")


def position_noise(frames: DataFrame, stream: str, *, sigma, draw: Draw) -> DataFrame:
    """Normal jitter on every joint or node; clips with rotations are refused, since both would disagree."""
    check_sigma(sigma)
    _need(frames, stream, "position noise")
    if "joint_rot" in frames.columns:
        raise ValueError("position noise would part positions from rotations")
    if len(positions(frames)) > 1:
        raise ValueError("position noise would part joint and node positions")
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    jitter = F.transform(stream, lambda p, v: F.array(*(p[c] + draw(stream, v, F.lit(c)) * s for c in range(3))))
    return frames.withColumn(stream, jitter)


def joint_position_noise(frames: DataFrame, *, sigma, draw: Draw) -> DataFrame:
    return position_noise(frames, "joint_pos", sigma=sigma, draw=draw)


def node_position_noise(frames: DataFrame, *, sigma, draw: Draw) -> DataFrame:
    return position_noise(frames, "node_pos", sigma=sigma, draw=draw)


def speed(frames: DataFrame, *, factor, representation: str | None = None, euler_orders=None) -> DataFrame:
    """Plays the clip ``factor`` times as fast: max(2, F / factor rounded half to even) frames over the same
    motion. Clips under 2 frames stay. ``factor`` is a number or a column (constant in a clip)."""
    check_factor(factor)
    _need_repr(frames, representation, "speed")
    target = _frames_at(factor)
    if "joint_rot" not in frames.columns:
        return resample(frames, target)
    held = frames.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), representation, "quat", euler_orders))
    out = resample(held, target, "quat")
    return out.withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), "quat", representation, euler_orders))


def _frames_at(factor) -> Column:
    n = F.count("*").over(clip_window())
    return F.when(n < 2, n).otherwise(F.greatest(F.lit(2), F.rint(n / (factor if isinstance(factor, Column) else F.lit(float(factor)))).cast("long")))


def speed_pairs(frames: DataFrame, factor) -> DataFrame:
    """The frames that ``speed`` lies between, still to be blended (quaternions along the shortest arc)."""
    return resample_pairs(frames, _frames_at(factor))


def dropout(frames: DataFrame, *, rate, draw: Column, representation: str | None = None, euler_orders=None) -> DataFrame:
    """Drops frames whose uniform ``draw`` is under ``rate`` (never the first and last) and fills them in
    between the kept ones; kept frames are unchanged."""
    check_drop_rate(rate)
    _need_repr(frames, representation, "dropout")
    streams = present(frames.columns)
    n = F.count("*").over(clip_window())
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    keep = (draw >= r) | (F.col("t") == 0) | (F.col("t") == n - 1) | (n < 2)
    held = frames.withColumn("_keep", keep)
    if "joint_rot" in streams:
        held = held.withColumn("_q", R.convert_joints(F.col("joint_rot"), representation, "quat", euler_orders))
    values = {s: "_q" if s == "joint_rot" else s for s in streams}
    mark = F.when(F.col("_keep"), F.struct(F.col("t").alias("t"), *(F.col(c).alias(s) for s, c in values.items())))
    past = Window.partitionBy("clip_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("clip_id").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    held = held.withColumn("_mark", mark).withColumns({"_l": F.last("_mark", True).over(past), "_r": F.first("_mark", True).over(later)})
    alpha = (F.col("t") - F.col("_l.t")) / F.greatest(F.col("_r.t") - F.col("_l.t"), F.lit(1)).cast("double")
    held = held.withColumn("_alpha", alpha)
    new = {}
    for s in streams:
        a, b = F.col(f"_l.{s}"), F.col(f"_r.{s}")
        if s == "joint_rot":
            filled = R.convert_joints(F.zip_with(a, b, lambda p, q: R.slerp(p, q, F.col("_alpha"))), "quat", representation, euler_orders)
        else:
            filled = lerp(s, a, b, F.col("_alpha"))
        new[s] = F.when(F.col("_keep"), F.col(s)).otherwise(filled)
    return held.withColumns(new).drop("_keep", "_q", "_mark", "_l", "_r", "_alpha")


def as_float(frames: DataFrame, like: DataFrame) -> DataFrame:
    """Streams with the number types that they have in ``like``: work is done in double, float goes back to float."""
    types = dict(like.dtypes)
    return frames.withColumns({s: F.col(s).cast(types[s]) for s in present(frames.columns) if s in types})


def as_double(frames: DataFrame) -> DataFrame:
    return frames.withColumns({s: F.col(s).cast("array<double>" if s == "root_pos" else "array<array<double>>") for s in present(frames.columns)})
