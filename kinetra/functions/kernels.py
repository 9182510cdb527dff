"""Rotations of whole Arrow batches at once: the same definitions as the Column expressions, over arrays (..., C)."""

from __future__ import annotations

import math

import numpy as np

from kinetra.functions.arrays import sixd_to_matrix
from kinetra.schema import check_euler_order

U = np.uint64
# The five primes of XXH64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = map(U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def unit(q: np.ndarray) -> np.ndarray:
    size = np.sqrt((q * q).sum(-1, keepdims=True))
    if (size == 0).any():
        raise ValueError("a rotation of length zero")
    return q / size


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = np.moveaxis(a, -1, 0), np.moveaxis(b, -1, 0)
    return np.stack([
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3],
        p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
        p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1],
        p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
    ], -1)


def quat_to_rows(q: np.ndarray) -> np.ndarray:
    """Matrices as 9 numbers, row by row."""
    w, x, y, z = np.moveaxis(unit(q), -1, 0)
    return np.stack([
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ], -1)


def rows_to_quat(m: np.ndarray) -> np.ndarray:
    """With w >= 0, from the largest of the four squared components; of equals, the first."""
    r = np.moveaxis(m, -1, 0)
    trace = r[0] + r[4] + r[8]
    case = np.argmax(np.stack([trace, r[0], r[4], r[8]]), 0)
    a, b, c, d, e, f = r[7] - r[5], r[2] - r[6], r[3] - r[1], r[1] + r[3], r[2] + r[6], r[5] + r[7]
    made = [(1 + trace, a, b, c), (a, 1 + r[0] - r[4] - r[8], d, e), (b, d, 1 - r[0] + r[4] - r[8], f), (c, e, f, 1 - r[0] - r[4] + r[8])]
    q = np.stack([np.choose(case, [made[k][i] for k in range(4)]) for i in range(4)], -1)
    q = unit(q)
    return np.where(q[..., :1] < 0, -q, q)


def quat_to_axisangle(q: np.ndarray) -> np.ndarray:
    u = unit(q)
    u = np.where(u[..., :1] < 0, -u, u)
    s = np.sqrt((u[..., 1:] ** 2).sum(-1, keepdims=True))
    k = np.where(s < 1e-12, 2.0, 2 * np.arctan2(s, u[..., :1]) / np.where(s < 1e-12, 1, s))
    return u[..., 1:] * k


def axisangle_to_quat(v: np.ndarray) -> np.ndarray:
    angle = np.sqrt((v * v).sum(-1, keepdims=True))
    k = np.where(angle < 1e-12, 0.5, np.sin(angle / 2) / np.where(angle < 1e-12, 1, angle))
    return unit(np.concatenate([np.cos(angle / 2), v * k], -1))


def euler_to_quat(e: np.ndarray, order: str) -> np.ndarray:
    out = None
    for i, letter in enumerate(check_euler_order(order)):
        q = np.zeros((*e.shape[:-1], 4))
        q[..., 0], q[..., 1 + "XYZ".index(letter)] = np.cos(e[..., i] / 2), np.sin(e[..., i] / 2)
        out = q if out is None else multiply(out, q)
    return out


def rows_to_euler(m: np.ndarray, order: str) -> np.ndarray:
    i, j, k = ("XYZ".index(x) for x in check_euler_order(order))
    e = 1.0 if (j - i) % 3 == 1 else -1.0
    at = lambda a, b: m[..., 3 * a + b]
    sine = np.clip(e * at(i, k), -1, 1)
    locked = np.abs(sine) > 1 - 1e-9
    first = np.where(locked, np.arctan2(e * at(k, j), at(j, j)), np.arctan2(-e * at(j, k), at(k, k)))
    last = np.where(locked, 0.0, np.arctan2(-e * at(i, j), at(i, i)))
    return np.stack([first, np.arcsin(sine), last], -1)


def _by_order(x: np.ndarray, orders, width: int, f) -> np.ndarray:
    """``f(joints, order)`` for the joints (axis 1) of each order."""
    if orders is None:
        raise ValueError("Euler angles need their orders")
    if isinstance(orders, str) or len(set(orders)) == 1:
        return f(x, orders if isinstance(orders, str) else orders[0])
    if len(orders) < x.shape[1]:
        raise ValueError(f"{len(orders)} Euler orders for {x.shape[1]} joints")
    out = np.empty((*x.shape[:-1], width))
    for o in set(orders[: x.shape[1]]):
        at = [n for n, own in enumerate(orders[: x.shape[1]]) if own == o]
        out[:, at] = f(x[:, at], o)
    return out


def convert(x: np.ndarray, source: str, target: str, orders=None) -> np.ndarray:
    """Rotations (F, J, C) from one representation to another."""
    if source == target:
        return x
    flat = lambda m: m.reshape(*m.shape[:-2], 9)
    six = lambda m: m[..., [0, 3, 6, 1, 4, 7]]
    if source in ("6d", "rotmat") and target in ("6d", "rotmat", "euler"):
        if source == "6d" and ((x[..., :3] ** 2).sum(-1) == 0).any():
            raise ValueError("a rotation of length zero")
        m = flat(sixd_to_matrix(x)) if source == "6d" else x
        return _by_order(m, orders, 3, rows_to_euler) if target == "euler" else six(m) if target == "6d" else m
    if source == "euler":
        q = _by_order(x, orders, 4, euler_to_quat)
    else:
        q = {"quat": lambda: x, "6d": lambda: rows_to_quat(flat(sixd_to_matrix(x))), "rotmat": lambda: rows_to_quat(x), "axisangle": lambda: axisangle_to_quat(x)}[source]()
    if target == "euler":
        return _by_order(quat_to_rows(q), orders, 3, rows_to_euler)
    return {"quat": lambda: q, "6d": lambda: six(quat_to_rows(q)), "rotmat": lambda: quat_to_rows(q), "axisangle": lambda: quat_to_axisangle(q)}[target]()


def slerp(a: np.ndarray, b: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """The shorter way between unit quaternions; straight and renormalised where they almost agree."""
    dot = (a * b).sum(-1, keepdims=True)
    other = np.where(dot < 0, -b, b)
    size = np.abs(dot)
    w = np.arccos(np.clip(size, -1, 1))
    near = size > 0.9995
    sine = np.where(near, 1.0, np.sin(w))
    out = (np.sin((1 - alpha) * w) * a + np.sin(alpha * w) * other) / sine
    close = near[..., 0] & (alpha[..., 0] != 0) & (alpha[..., 0] != 1)
    if close.any():
        step = np.broadcast_to(alpha, (*close.shape, 1))[close]
        out[close] = unit(a[close] + step * (other[close] - a[close]))
    out = np.where(alpha == 0, a, out)
    return np.where(alpha == 1, b, out)


def hash_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of a long that goes on from another hash, as Spark's ``xxhash64`` chains its columns."""
    turn = lambda x, n: (x << U(n)) | (x >> U(64 - n))
    h = (seed + _P5 + U(8)) ^ (turn(value * _P2, 31) * _P1)
    h = turn(h, 27) * _P1 + _P4
    h = (h ^ (h >> U(33))) * _P2
    h = (h ^ (h >> U(29))) * _P3
    return h ^ (h >> U(32))


def normals(a: np.ndarray, b: np.ndarray, vertices: int, channels: int) -> np.ndarray:
    """(F, V, C) standard normals by Box-Muller from the hashes of each frame's place, gone on with vertex and channel."""

    def units(seed: np.ndarray) -> np.ndarray:
        of_vertex = hash_long(np.arange(vertices, dtype=U)[None, :], seed.view(U)[:, None])
        return (hash_long(np.arange(channels, dtype=U)[None, None, :], of_vertex[:, :, None]) >> U(11)).astype(float) / float(1 << 53)

    return np.sqrt(-2 * np.log(1 - units(a))) * np.cos(2 * math.pi * units(b))


