"""Bringing clips to common axes, frame rates and Euler orders.

Turning the world moves roots, positions and root rotations; turning the rest pose moves offsets and is undone
in the rotations, so that no joint moves in space.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.functions import rotations as R
from kinetra.operators.augment import positions
from kinetra.operators.temporal import clip_window, resample
from kinetra.schema import parse_axis


def axis_turn(source: str, target: str) -> list[list[float]]:
    """The rotation by a quarter or half turn that takes one axis to another."""
    (a, s), (b, t) = parse_axis(source), parse_axis(target)
    if a == b:
        if s == t:
            return np.eye(3).tolist()
        other = (a + 1) % 3
        return [[float((-1 if i != other else 1) * (i == j)) for j in range(3)] for i in range(3)]
    m = np.zeros((3, 3))
    m[b, a], m[a, b] = s * t, -s * t
    k = 3 - a - b
    m[k, k] = 1
    return m.tolist()


def _by_axis(column: Column, target: str, f) -> Column:
    """``f(matrix)`` chosen by each row's own source axis; null axes stay."""
    out = None
    for sign in "+-":
        for x in "xyz":
            v = f(axis_turn(sign + x, target))
            out = F.when(column == sign + x, v) if out is None else out.when(column == sign + x, v)
    return out


def _matrix_quat(m) -> list[float]:
    w = np.array(m)
    q = np.array([1 + np.trace(w), w[2, 1] - w[1, 2], w[0, 2] - w[2, 0], w[1, 0] - w[0, 1]])
    if np.linalg.norm(q) < 1e-9:  # half a turn
        q = np.array([0.0, *np.sqrt(np.maximum(0, (np.diag(w) + 1) / 2))])
    return (q / np.linalg.norm(q)).tolist()


def turn_world(frames: DataFrame, target_up: str, source_up: str = "world_up") -> DataFrame:
    """Quaternion clips with a column of their up axis, turned so that ``target_up`` is up in all."""
    axis = F.col(source_up)
    new = {"root_pos": F.coalesce(_by_axis(axis, target_up, lambda m: R.apply_matrix(m, F.col("root_pos"))), F.col("root_pos"))}
    for s in positions(frames):
        new[s] = F.coalesce(_by_axis(axis, target_up, lambda m: F.transform(s, lambda p: R.apply_matrix(m, p))), F.col(s))
    if "joint_rot" in frames.columns:
        root = F.col("joint_rot")[0]
        turned = F.coalesce(_by_axis(axis, target_up, lambda m: R.quat_multiply(F.array(*map(R.D, _matrix_quat(m))), root)), root)
        new["joint_rot"] = F.concat(F.array(turned), F.slice("joint_rot", 2, F.greatest(F.size("joint_rot") - 1, F.lit(0))))
    return frames.withColumns(new | {source_up: F.when(axis.isNotNull(), target_up)})


def turn_rest_offsets(nodes: DataFrame, source: str, target: str) -> DataFrame:
    m = axis_turn(source, target)
    p = F.array("off_x", "off_y", "off_z")
    held = nodes.withColumn("_p", R.apply_matrix(m, p))
    return held.withColumns({f"off_{a}": F.col("_p")[i] for i, a in enumerate("xyz")}).drop("_p")


def turn_offsets(offsets: Column, source: Column, target: str) -> Column:
    """array<array<double>> of bone offsets, turned from each row's own axis; null axes leave them as they are."""
    return F.coalesce(_by_axis(source, target, lambda m: F.transform(offsets, lambda p: R.apply_matrix(m, p))), offsets)


def turn_rest_rotations(frames: DataFrame, source: str | Column, target: str) -> DataFrame:
    """Quaternions under the turned rest pose: the root's R becomes R Q', others Q R Q'. The source axis may be a
    column; where it is null, rotations stay."""
    if isinstance(source, Column):
        q = F.coalesce(_by_axis(source, target, lambda m: F.array(*map(R.D, _matrix_quat(m)))), F.array(*map(R.D, (1, 0, 0, 0))))
    else:
        q = F.array(*map(R.D, _matrix_quat(axis_turn(source, target))))
    held = frames.withColumn("_turn", q).withColumn("_back", F.array(F.col("_turn")[0], *(-F.col("_turn")[i] for i in (1, 2, 3))))
    turned = F.transform("joint_rot", lambda x, j: F.when(j == 0, R.quat_multiply(x, F.col("_back"))).otherwise(R.quat_multiply(R.quat_multiply(F.col("_turn"), x), F.col("_back"))))
    return held.withColumn("joint_rot", turned).drop("_turn", "_back")


def target_frames(n: Column, frame_time: Column, target_fps: float) -> Column:
    """As many frames as fit the clip's duration at the target rate."""
    return F.when(n < 2, n).otherwise(F.greatest(F.lit(2), F.rint((n - 1) * frame_time * target_fps).cast("long") + 1))


def to_fps(frames: DataFrame, target_fps: float, frame_time: Column) -> DataFrame:
    """Quaternion clips resampled to a frame rate: as many frames as fit the clip's duration."""
    return resample(frames, target_frames(F.count("*").over(clip_window()), frame_time, target_fps), "quat" if "joint_rot" in frames.columns else None)


def to_euler_order(frames: DataFrame, source_orders, target: str) -> DataFrame:
    """Euler clips with another channel order; the rotations stay the same."""
    q = R.convert_joints(F.col("joint_rot"), "euler", "quat", source_orders)
    return frames.withColumn("joint_rot", q).withColumn("joint_rot", R.convert_joints(F.col("joint_rot"), "quat", "euler", target))
