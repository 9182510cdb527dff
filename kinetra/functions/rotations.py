"""Rotation maths as Column expressions over array<double>.

Quaternions are w, x, y, z (Hamilton); matrices are 9 numbers, row by row; 6d is the matrix' first two
columns; axis-angle is axis times radians; Euler angles are radians, intrinsic, in the order's letters.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetra.schema import EULER_ORDERS, check_euler_order, require_representation

D = lambda x: F.lit(float(x))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once per row, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def vec(*parts: Column) -> Column:
    return F.array(*parts)


def map2(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def norm(a: Column, n: int) -> Column:
    return F.sqrt(sum((a[i] * a[i] for i in range(1, n)), a[0] * a[0]))


def normalize(q: Column, n: int = 4) -> Column:
    """The vector over its length; a zero vector is refused when the plan runs."""
    size = lambda v: F.when(norm(v, n) == 0, F.raise_error(F.lit("a rotation of length zero"))).otherwise(norm(v, n))
    return bind(q, lambda v: bind(size(v), lambda s: vec(*(v[i] / s for i in range(n)))))


def quat_multiply(a: Column, b: Column) -> Column:
    return bind(a, lambda p: bind(b, lambda q: vec(
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3],
        p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
        p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1],
        p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
    )))


def quat_to_rotmat(q: Column) -> Column:
    def matrix(u: Column) -> Column:
        w, x, y, z = (u[i] for i in range(4))
        return vec(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    return bind(normalize(q), matrix)


def rotmat_to_quat(m: Column) -> Column:
    """The quaternion with w >= 0, from the largest of the four squared components."""

    def quat(r: Column) -> Column:
        trace = r[0] + r[4] + r[8]
        case = {
            "w": vec(1 + trace, r[7] - r[5], r[2] - r[6], r[3] - r[1]),
            "x": vec(r[7] - r[5], 1 + r[0] - r[4] - r[8], r[1] + r[3], r[2] + r[6]),
            "y": vec(r[2] - r[6], r[1] + r[3], 1 - r[0] + r[4] - r[8], r[5] + r[7]),
            "z": vec(r[3] - r[1], r[2] + r[6], r[5] + r[7], 1 - r[0] - r[4] + r[8]),
        }
        big = F.greatest(trace, r[0], r[4], r[8])
        chosen = F.when(big == trace, case["w"]).when(big == r[0], case["x"]).when(big == r[4], case["y"]).otherwise(case["z"])
        return bind(normalize(chosen), lambda q: F.when(q[0] < 0, F.transform(q, lambda v: -v)).otherwise(q))

    return bind(m, quat)


def rotmat_to_6d(m: Column) -> Column:
    return bind(m, lambda r: vec(r[0], r[3], r[6], r[1], r[4], r[7]))


def sixd_to_rotmat(d: Column) -> Column:
    """Gram-Schmidt on the two columns; the third is their cross product."""

    def second(a: Column, v: Column) -> Column:
        dot = a[0] * v[3] + a[1] * v[4] + a[2] * v[5]
        return normalize(vec(v[3] - dot * a[0], v[4] - dot * a[1], v[5] - dot * a[2]), 3)

    def matrix(a: Column, b: Column) -> Column:
        return vec(
            a[0], b[0], a[1] * b[2] - a[2] * b[1],
            a[1], b[1], a[2] * b[0] - a[0] * b[2],
            a[2], b[2], a[0] * b[1] - a[1] * b[0],
        )

    return bind(d, lambda v: bind(normalize(vec(v[0], v[1], v[2]), 3), lambda a: bind(second(a, v), lambda b: matrix(a, b))))


def quat_to_axisangle(q: Column) -> Column:
    def out(u: Column) -> Column:
        s = F.sqrt(u[1] * u[1] + u[2] * u[2] + u[3] * u[3])
        return bind(F.when(s < 1e-12, D(2)).otherwise(2 * F.atan2(s, u[0]) / s), lambda k: vec(u[1] * k, u[2] * k, u[3] * k))

    return bind(normalize(q), lambda u: bind(F.when(u[0] < 0, F.transform(u, lambda v: -v)).otherwise(u), out))


def axisangle_to_quat(a: Column) -> Column:
    def out(v: Column) -> Column:
        angle = norm(v, 3)
        k = F.when(angle < 1e-12, D(0.5)).otherwise(F.sin(angle / 2) / angle)
        return bind(k, lambda s: normalize(vec(F.cos(angle / 2), v[0] * s, v[1] * s, v[2] * s)))

    return bind(a, out)


def axis_quat(axis: int, angle: Column) -> Column:
    part = lambda i: F.sin(angle / 2) if i == axis else D(0)
    return vec(F.cos(angle / 2), part(0), part(1), part(2))


def euler_to_quat(e: Column, order: str) -> Column:
    a, b, c = ("XYZ".index(x) for x in check_euler_order(order))
    return bind(e, lambda v: quat_multiply(quat_multiply(axis_quat(a, v[0]), axis_quat(b, v[1])), axis_quat(c, v[2])))


def rotmat_to_euler(m: Column, order: str) -> Column:
    """Angles with the middle one in [-pi/2, pi/2]; where it is at an end, the last is 0."""
    i, j, k = ("XYZ".index(x) for x in check_euler_order(order))
    e = 1.0 if (j - i) % 3 == 1 else -1.0
    at = lambda r, a, b: r[3 * a + b]

    def out(r: Column) -> Column:
        sine = F.least(F.greatest(e * at(r, i, k), D(-1)), D(1))
        locked = F.abs(sine) > 1 - 1e-9
        first = F.when(locked, F.atan2(e * at(r, k, j), at(r, j, j))).otherwise(F.atan2(-e * at(r, j, k), at(r, k, k)))
        last = F.when(locked, D(0)).otherwise(F.atan2(-e * at(r, i, j), at(r, i, i)))
        return vec(first, F.asin(sine), last)

    return bind(m, out)


def rotmat_to_axisangle(m: Column) -> Column:
    return quat_to_axisangle(rotmat_to_quat(m))


def slerp(a: Column, b: Column, alpha: Column, shortest: bool = True) -> Column:
    """The way between unit quaternions, by default the shorter; straight and renormalised where they almost agree."""

    def out(p: Column, q: Column) -> Column:
        dot = sum((p[i] * q[i] for i in range(1, 4)), p[0] * q[0])
        size = (lambda d: F.abs(d)) if shortest else (lambda d: d)
        other = (lambda d: F.when(d < 0, F.transform(q, lambda v: -v)).otherwise(q)) if shortest else (lambda d: q)
        return bind(dot, lambda d: bind(other(d), lambda r: bind(F.acos(F.greatest(F.least(size(d), D(1)), D(-1))), lambda w: F.when(
            size(d) > 0.9995, normalize(map2(p, r, lambda x, y: x + alpha * (y - x)))
        ).otherwise(map2(p, r, lambda x, y: (F.sin((1 - alpha) * w) * x + F.sin(alpha * w) * y) / F.sin(w))))))

    return F.when(alpha == 0, a).when(alpha == 1, b).otherwise(bind(a, lambda p: bind(b, lambda q: out(p, q))))


def to_quat(x: Column, representation: str, order: str | None = None) -> Column:
    r = require_representation(representation)
    if r == "euler":
        if order is None:
            raise ValueError("Euler angles need their orders")
        return euler_to_quat(x, order)
    return {"quat": lambda: x, "6d": lambda: rotmat_to_quat(sixd_to_rotmat(x)), "axisangle": lambda: axisangle_to_quat(x), "rotmat": lambda: rotmat_to_quat(x)}[r]()


def from_quat(q: Column, representation: str, order: str | None = None) -> Column:
    r = require_representation(representation)
    if r == "euler":
        if order is None:
            raise ValueError("Euler angles need their orders")
        return rotmat_to_euler(quat_to_rotmat(q), order)
    return {"quat": lambda: q, "6d": lambda: rotmat_to_6d(quat_to_rotmat(q)), "axisangle": lambda: quat_to_axisangle(q), "rotmat": lambda: quat_to_rotmat(q)}[r]()


def convert(x: Column, source: str, target: str, order: str | None = None) -> Column:
    """One rotation from one representation to another; equal representations give a copy."""
    if source == target:
        require_representation(source)
        return x
    if source in ("6d", "rotmat") and target in ("6d", "rotmat", "euler"):  # no need of a quaternion
        m = sixd_to_rotmat(x) if source == "6d" else x
        if target == "euler":
            return rotmat_to_euler(m, order or _no_order())
        return rotmat_to_6d(m) if target == "6d" else m
    return from_quat(to_quat(x, source, order), target, order)


def _no_order():
    raise ValueError("Euler angles need their orders")


def convert_joints(joints: Column, source: str, target: str, orders=None) -> Column:
    """All joints of a frame. Euler orders are one string for all joints, a list with one for each, or a column of such
    lists, where rows differ."""
    if "euler" not in (source, target) or source == target:
        return F.transform(joints, lambda x: convert(x, source, target))
    if orders is None:
        raise ValueError("Euler angles need their orders")
    if not isinstance(orders, Column) and (isinstance(orders, str) or len(set(orders)) == 1):
        one = orders if isinstance(orders, str) else orders[0]
        return F.transform(joints, lambda x: convert(x, source, target, one))
    pick, known = (orders, EULER_ORDERS) if isinstance(orders, Column) else (F.array(*(F.lit(o) for o in orders)), sorted(set(orders)))

    def by_order(x: Column, i: Column) -> Column:
        out = None
        for o in known:
            value = convert(x, source, target, o)
            out = F.when(pick[i] == o, value) if out is None else out.when(pick[i] == o, value)
        return out

    return F.transform(joints, by_order)


def apply_matrix(m, p: Column) -> Column:
    """A constant 3 x 3 matrix times a vector."""
    row = lambda r: sum((D(r[i]) * p[i] for i in range(1, 3)), D(r[0]) * p[0])
    return vec(*(row(r) for r in m))


def axis_matrix(axis: int, angle: float) -> list[list[float]]:
    c, s = math.cos(angle), math.sin(angle)
    a, b = (axis + 1) % 3, (axis + 2) % 3
    m = [[float(i == j) for j in range(3)] for i in range(3)]
    m[a][a], m[a][b], m[b][a], m[b][b] = c, -s, s, c
    return m
