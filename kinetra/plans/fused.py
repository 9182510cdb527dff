"""Runs of pipeline steps compiled into one Arrow pass over a batch's flat buffers.

Steps that look at one frame at a time (turning, mirroring, rotation and root noise, conversions, and the blending of two
frames that a change of speed ends with) become a list of operations on arrays; gates, angles and the hashes that noise
goes on from are columns of the batch. The expression path of ``augment`` does the same and stays the fallback.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.functions import kernels as K
from kinetra.functions.arrays import as_array, as_lists
from kinetra.operators import augment
from kinetra.schema import check_factor, parse_axis, present, require_representation

Arrays = dict[str, np.ndarray]
#: arrays, columns -> nothing: an operation changes ``arrays`` in place.
Operation = Callable[[Arrays, Arrays], None]


class Program:
    """Operations waiting for one pass, and the columns that they read."""

    def __init__(self) -> None:
        self.operations: list[Operation] = []
        self.columns: dict[str, Column] = {}

    def column(self, value) -> str | float:
        """The name of a column of numbers, or the number itself."""
        if not isinstance(value, Column):
            return float(value)
        name = f"_fused_{len(self.columns)}"
        self.columns[name] = value
        return name

    def flush(self, frames: DataFrame) -> DataFrame:
        """``frames`` with the waiting operations applied; nothing is left waiting."""
        if not self.operations:
            return frames
        operations, columns = self.operations, self.columns
        self.__init__()
        names = [c for c in frames.columns if not c.startswith("_next_") and c != "_alpha"]
        streams, params = present(names), [*columns, *(c for c in ("_alpha", "_noise") if c in frames.columns)]
        pairs = [f"_next_{s}" for s in streams if f"_next_{s}" in frames.columns]
        held = frames.withColumns(columns)

        def run(batches):
            for batch in batches:
                for part in _alike(batch, streams):
                    arrays = {s: as_array(part.column(s)) for s in [*streams, *pairs]}
                    values = {c: part.column(c) if c == "_noise" else part.column(c).to_numpy(zero_copy_only=False) for c in params}
                    for step in operations:
                        step(arrays, values)
                    yield pa.RecordBatch.from_arrays([as_lists(arrays[c]) if c in streams else part.column(c) for c in names], names)

        kinds = dict(frames.dtypes)
        return held.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def _alike(batch: pa.RecordBatch, streams: list[str]) -> list[pa.RecordBatch]:
    """The batch, cut where clips with other numbers of vertices come together."""
    if not batch.num_rows:
        return []
    sizes = [pc.list_value_length(batch.column(s)).to_numpy(zero_copy_only=False) for s in streams]
    change = np.flatnonzero(np.any([np.diff(x) != 0 for x in sizes], axis=0)) + 1
    cuts = [0, *change.tolist(), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _value(values: Arrays, x: str | float, rows: np.ndarray) -> np.ndarray:
    return values[x][rows].astype(float) if isinstance(x, str) else np.full(len(rows), x)


def _rows(values: Arrays, gate: str | float, n: int) -> np.ndarray:
    """The frames whose gate is open."""
    return np.flatnonzero(values[gate].astype(bool)) if isinstance(gate, str) else np.arange(n)


def _noise(values: Arrays, rows: np.ndarray) -> np.ndarray:
    """A generator's numbers of these frames; those of closed gates may have another width."""
    return as_array(values["_noise"].take(pa.array(rows)))


def convert(program: Program, source: str, target: str, orders) -> None:
    def step(arrays: Arrays, values: Arrays) -> None:
        for s in ("joint_rot", "_next_joint_rot"):
            if s in arrays:
                arrays[s] = K.convert(arrays[s], source, target, orders)

    program.operations.append(step)


def rotate_vertical(program: Program, gate: Column, now: str | None, *, angle, up_axis: str, degrees: bool = False, representation=None, euler_orders=None) -> None:
    axis, sign = parse_axis(up_axis)
    if isinstance(angle, Column):
        angle = F.radians(angle) if degrees else angle
    elif degrees:
        angle = np.radians(angle)
    open_, turn = program.column(gate), program.column(angle)
    i, j = (axis + 1) % 3, (axis + 2) % 3

    def step(arrays: Arrays, values: Arrays) -> None:
        rows = _rows(values, open_, len(arrays["root_pos"]))
        if not len(rows):
            return
        a = _value(values, turn, rows) * sign
        c, s = np.cos(a), np.sin(a)

        def turned(p: np.ndarray) -> np.ndarray:
            own_c, own_s = (x.reshape(-1, *([1] * (p.ndim - 2))) for x in (c, s))
            out = p.copy()
            out[..., i], out[..., j] = own_c * p[..., i] - own_s * p[..., j], own_s * p[..., i] + own_c * p[..., j]
            return out

        for name in ("root_pos", "joint_pos", "node_pos"):
            if name in arrays:
                arrays[name][rows] = turned(arrays[name][rows])
        if "joint_rot" in arrays:
            rot = arrays["joint_rot"]
            if not rot.shape[1]:
                raise ValueError("a clip without joints has no root joint to turn")
            first = rot[rows, 0]
            if now == "6d":
                rot[rows, 0] = np.concatenate([turned(first[:, :3]), turned(first[:, 3:])], 1)
            else:
                q, half = np.zeros((len(rows), 4)), np.arctan2(s, c) / 2
                q[:, 0], q[:, 1 + axis] = np.cos(half), np.sin(half)
                rot[rows, 0] = K.multiply(q, first)

    program.operations.append(step)


def _swapped(x: np.ndarray, pairs) -> np.ndarray:
    order: dict[int, int] = {}
    for a, b in pairs or ():
        order[a], order[b] = order.get(b, b), order.get(a, a)
    return x[:, [order.get(v, v) for v in range(x.shape[1])]] if order else x


def mirror(program: Program, gate: Column, now: str | None, *, lateral_axis: str, lr_joint_pairs=None, lr_node_pairs=None, representation=None, euler_orders=None) -> None:
    axis, _ = parse_axis(lateral_axis)
    open_ = program.column(gate)
    sign = np.array([-1.0 if k == axis else 1.0 for k in range(3)])

    def step(arrays: Arrays, values: Arrays) -> None:
        rows = _rows(values, open_, len(arrays["root_pos"]))
        if not len(rows):
            return
        for name, pairs in (("root_pos", None), ("joint_pos", lr_joint_pairs), ("node_pos", lr_node_pairs)):
            if name in arrays:
                moved = arrays[name][rows] * sign
                arrays[name][rows] = moved if name == "root_pos" else _swapped(moved, pairs)
        if "joint_rot" in arrays:
            kept = np.concatenate([sign[0] * sign, sign[1] * sign]) if now == "6d" else np.concatenate([[1.0], -sign])
            arrays["joint_rot"][rows] = _swapped(arrays["joint_rot"][rows] * kept, lr_joint_pairs)

    program.operations.append(step)


def _sigma(sigma, degrees: bool = False):
    if isinstance(sigma, Column):
        return F.radians(sigma) if degrees else sigma
    return np.radians(sigma) if degrees else sigma


def rotation_noise(program: Program, gate: Column, now: str | None, *, sigma, draws, degrees: bool = False, representation=None, euler_orders=None) -> None:
    """``draws`` are hash draws, whose numbers go on from hashes in the plan, or draws of a generator in ``_noise``."""
    open_, size = program.column(gate), program.column(_sigma(sigma, degrees))
    seeds = {(w, s): program.column(draws.seed_of(s, w)) for w in ("axis", "angle") for s in ("a", "b")} if hasattr(draws, "seed_of") else None

    def step(arrays: Arrays, values: Arrays) -> None:
        rows = _rows(values, open_, len(arrays["root_pos"]))
        if not len(rows):
            return
        rot = arrays["joint_rot"]
        n = rot.shape[1]
        if seeds:
            axis, angle = (K.normals(values[seeds[w, "a"]][rows], values[seeds[w, "b"]][rows], n, c) for w, c in (("axis", 3), ("angle", 1)))
        else:
            noise = _noise(values, rows)
            at = noise.shape[1] * 3 // 4
            axis, angle = noise[:, : 3 * n].reshape(-1, n, 3), noise[:, at : at + n, None]
        length = np.sqrt((axis * axis).sum(-1, keepdims=True))
        half = angle * _value(values, size, rows)[:, None, None] / 2
        q = np.concatenate([np.cos(half), np.sin(half) * axis / np.where(length < 1e-15, 1, length)], -1)
        rot[rows] = K.unit(K.multiply(q, rot[rows]))

    program.operations.append(step)


def root_noise(program: Program, gate: Column, now: str | None, *, sigma, draws, centering: str | None = None) -> None:
    open_, size = program.column(gate), program.column(_sigma(sigma))
    seeds = [program.column(draws.seed_of(s, "root")) for s in ("a", "b")] if hasattr(draws, "seed_of") else None

    def step(arrays: Arrays, values: Arrays) -> None:
        rows = _rows(values, open_, len(arrays["root_pos"]))
        if not len(rows):
            return
        moved = K.normals(values[seeds[0]][rows], values[seeds[1]][rows], 1, 3)[:, 0] if seeds else _noise(values, rows)[:, :3]
        moved = moved * _value(values, size, rows)[:, None]
        arrays["root_pos"][rows] += moved
        if centering != "skeleton":
            for name in ("joint_pos", "node_pos"):
                if name in arrays:
                    arrays[name][rows] += moved[:, None]

    program.operations.append(step)


def blend(program: Program, quaternions: bool) -> None:
    """Frames between a frame and the next one, by ``_alpha``: what ``temporal.resample_pairs`` leaves to do."""

    def step(arrays: Arrays, values: Arrays) -> None:
        alpha = values["_alpha"].astype(float)
        for name in [s for s in arrays if not s.startswith("_next_")]:
            a, b = arrays[name], arrays.pop(f"_next_{name}")
            own = alpha.reshape(-1, *([1] * (a.ndim - 1)))
            arrays[name] = K.slerp(a, b, own) if quaternions and name == "joint_rot" else (1 - own) * a + own * b

    program.operations.append(step)


# ---- whole tables -----------------------------------------------------------------------------


def convert_frames(frames: DataFrame, source: str, target: str, orders=None) -> DataFrame:
    """``frames`` with joint_rot in another representation, in one Arrow pass; ``rotations.convert_joints`` is the same as an
    expression, and takes Euler orders that differ from row to row."""
    for r in (source, target):
        require_representation(r)
    if source == target:
        return frames
    if "euler" in (source, target) and orders is None:
        raise ValueError("Euler angles need their orders")
    program = Program()
    convert(program, source, target, orders)
    return augment.as_float(program.flush(augment.as_double(frames)), frames)


def change_speed(frames: DataFrame, factor, representation: str | None = None, orders=None) -> DataFrame:
    """``augment.speed`` with the blending of frames in Arrow passes."""
    check_factor(factor)
    program, rotations = Program(), "joint_rot" in frames.columns
    if rotations and representation is None:
        raise ValueError("speed needs the representation of joint_rot")
    if rotations:
        convert(program, require_representation(representation), "quat", orders)
    out = augment.speed_pairs(program.flush(augment.as_double(frames)), factor)
    blend(program, rotations)
    if rotations:
        convert(program, "quat", representation, orders)
    return augment.as_float(program.flush(out), frames)
