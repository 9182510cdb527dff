"""NumPy twins of the rotation expressions, for Arrow batches and for tests, and arrays to and from Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kinetra.schema import check_euler_order


def euler_to_matrix(e: np.ndarray, order: str) -> np.ndarray:
    """Angles (..., 3) -> matrices (..., 3, 3), the intrinsic product in the order's letters."""
    out = None
    for i, letter in enumerate(check_euler_order(order)):
        k = "XYZ".index(letter)
        a, b = (k + 1) % 3, (k + 2) % 3
        m = np.zeros((*e.shape[:-1], 3, 3))
        m[..., k, k] = 1
        m[..., a, a] = m[..., b, b] = np.cos(e[..., i])
        m[..., b, a] = np.sin(e[..., i])
        m[..., a, b] = -m[..., b, a]
        out = m if out is None else out @ m
    return out


def quat_to_matrix(q: np.ndarray) -> np.ndarray:
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    w, x, y, z = np.moveaxis(q, -1, 0)
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return np.stack([np.stack(r, -1) for r in rows], -2)


def sixd_to_matrix(d: np.ndarray) -> np.ndarray:
    a = d[..., :3] / np.linalg.norm(d[..., :3], axis=-1, keepdims=True)
    b = d[..., 3:] - (a * d[..., 3:]).sum(-1, keepdims=True) * a
    b = b / np.linalg.norm(b, axis=-1, keepdims=True)
    return np.stack([a, b, np.cross(a, b)], -1)


def axisangle_to_matrix(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v, axis=-1, keepdims=True)
    safe = np.where(angle < 1e-12, 1, angle)
    s = np.where(angle < 1e-12, 0.5, np.sin(angle / 2) / safe)
    return quat_to_matrix(np.concatenate([np.cos(angle / 2), v * s], -1))


def to_matrix(x: np.ndarray, representation: str, orders=None) -> np.ndarray:
    """Rotations (..., J, C) -> (..., J, 3, 3); orders is one string or one for each joint."""
    if representation == "euler":
        if orders is None:
            raise ValueError("Euler angles need their orders")
        orders = [orders] * x.shape[-2] if isinstance(orders, str) else list(orders)
        out = np.empty((*x.shape[:-1], 3, 3))
        for o in set(orders):
            at = [i for i, own in enumerate(orders) if own == o]
            out[..., at, :, :] = euler_to_matrix(x[..., at, :], o)
        return out
    if representation == "rotmat":
        return x.reshape(*x.shape[:-1], 3, 3)
    return {"quat": quat_to_matrix, "6d": sixd_to_matrix, "axisangle": axisangle_to_matrix}[representation](x)


def forward_kinematics(root: np.ndarray, local: np.ndarray, offsets: np.ndarray, parent: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """Node positions (F, N, 3) from root positions (F, 3) and local matrices (F, J, 3, 3).

    Parents come before children; ``joint[n]`` is -1 at end sites; the root stands at ``root``; ``offsets`` are
    (N, 3), or (F, N, 3) where frames belong to different skeletons.
    """
    n = len(parent)
    where = np.zeros((len(root), n, 3))
    turn = np.zeros((len(root), n, 3, 3))
    for i in range(n):
        own = local[:, joint[i]] if joint[i] >= 0 else np.eye(3)
        if parent[i] < 0:
            where[:, i], turn[:, i] = root, own
        else:
            p = parent[i]
            where[:, i] = where[:, p] + (turn[:, p] @ offsets[..., i, :, None])[..., 0]
            turn[:, i] = turn[:, p] @ own
    return where


def as_array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """list<double> or list<list<double>> of equal lengths -> (F, ...)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    shape, flat = [len(column)], column
    while pa.types.is_list(flat.type) or pa.types.is_large_list(flat.type):
        sizes = np.unique(flat.value_lengths().to_numpy(zero_copy_only=False))
        if len(sizes) > 1 or flat.null_count:
            raise ValueError("frames of different widths")
        shape.append(int(sizes[0]) if len(sizes) else 0)
        flat = flat.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(shape)


def as_lists(values: np.ndarray) -> pa.Array:
    """The reverse of ``as_array``."""
    out = pa.array(np.ascontiguousarray(values, float).ravel())
    for depth in range(values.ndim - 1, 0, -1):
        n = int(np.prod(values.shape[:depth]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * values.shape[depth]), out)
    return out
