"""Rotations and rigid transforms as closed-form array expressions.

Matrices are row-major arrays (9 or 16 doubles), quaternions are wxyz, rot6d is
the first two columns, Euler angles are yaw, pitch, roll of R = Rz Ry Rx.  The
matrix is the pivot between all representations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaitworks.functions import vectors as V
from gaitworks.functions.vectors import bound, let


def _at(v: Column, n: int) -> list[Column]:
    return [F.get(v, i) for i in range(n)]


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def unit(v: Sequence[Column]) -> list[Column]:
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return [x / n for x in v]


@bound
def quat_to_matrix(q: Column) -> Column:
    """Any-norm wxyz quaternion; the zero quaternion is the identity."""

    def made(u):
        w, x, y, z = _at(u, 4)
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
        )

    n = F.sqrt(F.aggregate(q, F.lit(0.0), lambda acc, x: acc + x * x))
    normal = F.when(n > 0, F.transform(q, lambda x: x / n)).otherwise(V.literal([1, 0, 0, 0]))
    return let(normal, made)


def matrix_to_quat(m: Column) -> Column:
    """Largest-component branch, sign chosen so that w >= 0."""

    def made(r):
        a = _at(r, 9)
        sq = [1 + a[0] + a[4] + a[8], 1 + a[0] - a[4] - a[8], 1 - a[0] + a[4] - a[8], 1 - a[0] - a[4] + a[8]]
        s = [2 * F.sqrt(F.greatest(x, F.lit(1e-30))) for x in sq]
        rows = [
            (s[0] / 4, (a[7] - a[5]) / s[0], (a[2] - a[6]) / s[0], (a[3] - a[1]) / s[0]),
            ((a[7] - a[5]) / s[1], s[1] / 4, (a[1] + a[3]) / s[1], (a[2] + a[6]) / s[1]),
            ((a[2] - a[6]) / s[2], (a[1] + a[3]) / s[2], s[2] / 4, (a[5] + a[7]) / s[2]),
            ((a[3] - a[1]) / s[3], (a[2] + a[6]) / s[3], (a[5] + a[7]) / s[3], s[3] / 4),
        ]
        top = F.greatest(*sq)
        pick = F.when(sq[0] == top, F.array(*rows[0])).when(sq[1] == top, F.array(*rows[1])).when(sq[2] == top, F.array(*rows[2])).otherwise(F.array(*rows[3]))
        return let(pick, lambda q: F.when(F.get(q, 0) < 0, F.transform(q, lambda x: -x)).otherwise(q))

    return let(m, made)


def matrix_to_rot6d(m: Column) -> Column:
    return V.permute(m, [0, 3, 6, 1, 4, 7])


@bound
def rot6d_from_unit_quat(q: Column) -> Column:
    w, x, y, z = _at(q, 4)
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y),
        2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x),
    )


@bound
def rot6d_to_matrix(v: Column) -> Column:
    """Gram-Schmidt on the two columns, the third is their cross product."""
    a, b = _at(v, 3), [F.get(v, i) for i in (3, 4, 5)]

    def second(xa):
        x = _at(xa, 3)
        d = dot(x, b)
        return let(F.array(*unit([bi - d * xi for bi, xi in zip(b, x)])), lambda yb: third(xa, yb))

    def third(xa, yb):
        x, y = _at(xa, 3), _at(yb, 3)
        z = cross(x, y)
        return F.array(x[0], y[0], z[0], x[1], y[1], z[1], x[2], y[2], z[2])

    return let(F.array(*unit(a)), second)


@bound
def euler_to_matrix(e: Column) -> Column:
    """(yaw, pitch, roll) -> Rz(yaw) Ry(pitch) Rx(roll)."""
    y, p, r = _at(e, 3)
    cy, sy, cp, sp, cr, sr = F.cos(y), F.sin(y), F.cos(p), F.sin(p), F.cos(r), F.sin(r)
    return F.array(
        cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr,
        sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr,
        -sp, cp * sr, cp * cr,
    )


def matrix_to_euler(m: Column) -> Column:
    """(yaw, pitch, roll); at the pitch singularity roll is set to 0."""

    def made(r):
        a = _at(r, 9)
        flat = F.sqrt(a[0] * a[0] + a[3] * a[3])
        pitch = F.atan2(-a[6], flat)
        ok = flat >= 1e-6
        yaw = F.when(ok, F.atan2(a[3], a[0])).otherwise(F.atan2(-a[1], a[4]))
        roll = F.when(ok, F.atan2(a[7], a[8])).otherwise(F.lit(0.0))
        return F.array(yaw, pitch, roll)

    return let(m, made)


def axis_angle_to_quat(v: Column) -> Column:
    def made(u):
        x = _at(u, 3)
        angle = F.sqrt(dot(x, x))
        k = F.when(angle > 1e-9, F.sin(angle / 2) / F.greatest(angle, F.lit(1e-30))).otherwise(F.lit(0.5))
        return F.array(F.cos(angle / 2), x[0] * k, x[1] * k, x[2] * k)

    return let(v, made)


def quat_to_axis_angle(q: Column) -> Column:
    def made(u):
        w, x, y, z = _at(u, 4)
        n = F.sqrt(x * x + y * y + z * z)
        k = F.when(n > 1e-9, 2 * F.atan2(n, w) / F.greatest(n, F.lit(1e-30))).otherwise(F.lit(2.0))
        return F.array(x * k, y * k, z * k)

    return let(q, made)


TO_MATRIX = {
    "matrix": lambda v: v,
    "quaternion": quat_to_matrix,
    "rotation_6d": rot6d_to_matrix,
    "euler": euler_to_matrix,
    "axis_angle": lambda v: quat_to_matrix(axis_angle_to_quat(v)),
}
FROM_MATRIX = {
    "matrix": lambda v: v,
    "quaternion": matrix_to_quat,
    "rotation_6d": matrix_to_rot6d,
    "euler": matrix_to_euler,
    "axis_angle": lambda v: quat_to_axis_angle(matrix_to_quat(v)),
}


def convert(v: Column, source: str, target: str) -> Column:
    if source == target:
        raise ValueError("source and target representation are the same")
    return let(TO_MATRIX[source](v), FROM_MATRIX[target])


# --- rigid transforms, 16 doubles row-major -------------------------------------------------

@bound
def pose(rotation: Column, translation: Column) -> Column:
    r, t = _at(rotation, 9), _at(translation, 3)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2], zero, zero, zero, one)


def rotation_of(m: Column) -> Column:
    return V.permute(m, [0, 1, 2, 4, 5, 6, 8, 9, 10])


def translation_of(m: Column) -> Column:
    return V.permute(m, [3, 7, 11])


def invert(m: Column) -> Column:
    """Rigid inverse: R^T and -R^T t."""

    def made(x):
        a = _at(x, 16)
        t = [a[3], a[7], a[11]]
        cols = [[a[0], a[4], a[8]], [a[1], a[5], a[9]], [a[2], a[6], a[10]]]
        out = []
        for c in cols:
            out += [*c, -dot(c, t)]
        return F.array(*out, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))

    return let(m, made)


def compose(a: Column, b: Column) -> Column:
    """4x4 product of two rigid transforms."""

    def made(p):
        x, y = _at(F.get(p, 0), 16), _at(F.get(p, 1), 16)
        out = []
        for i in range(3):
            row = x[4 * i : 4 * i + 4]
            for j in range(4):
                term = row[0] * y[j] + row[1] * y[4 + j] + row[2] * y[8 + j]
                out.append(term + row[3] if j == 3 else term)
        return F.array(*out, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))

    return let(F.array(a, b), made)


@bound
def transform_point(m: Column, p: Column) -> Column:
    x, q = _at(m, 12), _at(p, 3)
    return F.array(*[dot(x[4 * i : 4 * i + 3], q) + x[4 * i + 3] for i in range(3)])


@bound
def rotate_vector(m: Column, p: Column) -> Column:
    """Rotation part of a 4x4 applied to a direction."""
    x, q = _at(m, 12), _at(p, 3)
    return F.array(*[dot(x[4 * i : 4 * i + 3], q) for i in range(3)])


@bound
def multiply3(a: Column, b: Column, transpose_b: bool = False) -> Column:
    x, y = _at(a, 9), _at(b, 9)
    idx = (lambda k, j: 3 * j + k) if transpose_b else (lambda k, j: 3 * k + j)
    return F.array(*[dot(x[3 * i : 3 * i + 3], [y[idx(k, j)] for k in range(3)]) for i in range(3) for j in range(3)])


@bound
def rotate_by_quat(q: Column, p: Column) -> Column:
    """v + 2 w (u x v) + 2 u x (u x v) for a unit quaternion."""
    w, u, v = F.get(q, 0), [F.get(q, i) for i in (1, 2, 3)], _at(p, 3)
    c = cross(u, v)
    cc = cross(u, c)
    return F.array(*[v[i] + 2 * w * c[i] + 2 * cc[i] for i in range(3)])


def slerp(a: Column, b: Column, f: Column) -> Column:
    """Shortest-path spherical interpolation of unit quaternions, linear when they nearly agree."""

    def made(p):
        x, y = _at(F.get(p, 0), 4), _at(F.get(p, 1), 4)
        raw = dot(x, y)
        sign = F.when(raw < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        d = F.least(F.abs(raw), F.lit(1.0))
        theta = F.acos(d)
        s = F.sin(theta)
        near = s < 1e-9
        wa = F.when(near, 1 - f).otherwise(F.sin((1 - f) * theta) / F.greatest(s, F.lit(1e-30)))
        wb = F.when(near, f).otherwise(F.sin(f * theta) / F.greatest(s, F.lit(1e-30))) * sign
        return let(F.array(*[wa * x[i] + wb * y[i] for i in range(4)]), lambda q: F.array(*unit(_at(q, 4))))

    return let(F.array(a, b), made)
