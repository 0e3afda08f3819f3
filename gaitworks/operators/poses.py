"""Pose jobs over chunks and frames: array expressions, no Python per row."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaitworks.functions import rotations as R
from gaitworks.functions import vectors as V

INVALID, INVALID_OUT = 1e8, 1e9  # fixed values: marker threshold and the value that reports it


def xyzypr_to_pose(v: Column) -> Column:
    return R.pose(R.euler_to_matrix(V.take_span(v, 3, 6)), V.take_span(v, 0, 3))


def pose_to_xyzypr(m: Column) -> Column:
    return F.concat(R.translation_of(m), R.matrix_to_euler(R.rotation_of(m)))


def d9_to_pose(v: Column) -> Column:
    """xyz + rot6d -> 4x4."""
    return R.pose(R.rot6d_to_matrix(V.take_span(v, 3, 9)), V.take_span(v, 0, 3))


def to_camera(pose: Column, extrinsics: Column) -> Column:
    return R.compose(R.invert(extrinsics), pose)


def point_to_camera(p: Column, extrinsics: Column) -> Column:
    return R.transform_point(R.invert(extrinsics), p)


def relative(pose: Column, base: Column, mode: str) -> Column:
    """``abs``, ``rel`` (difference and R B^T) or ``relative`` (inv(base) @ pose)."""
    if mode == "abs":
        return pose
    if mode == "relative":
        return R.compose(R.invert(base), pose)
    if mode == "rel":
        return _difference(pose, base)
    raise ValueError(f"unsupported pose mode {mode!r}")


def absolute(pose: Column, base: Column, mode: str) -> Column:
    if mode == "abs":
        return pose
    if mode == "relative":
        return R.compose(base, pose)
    if mode == "rel":
        return _sum(pose, base)
    raise ValueError(f"unsupported pose mode {mode!r}")


def _difference(pose: Column, base: Column) -> Column:
    return R.pose(
        R.multiply3(R.rotation_of(pose), R.rotation_of(base), transpose_b=True),
        V.subtract(R.translation_of(pose), R.translation_of(base)),
    )


def _sum(pose: Column, base: Column) -> Column:
    return R.pose(
        R.multiply3(R.rotation_of(pose), R.rotation_of(base)), V.add(R.translation_of(pose), R.translation_of(base))
    )


def delta_chunk(chunk: Column, base: Column) -> Column:
    """Each pose against the one before it, the first against ``base``."""
    previous = F.concat(F.array(base), F.slice(chunk, 1, F.size(chunk) - 1))
    return F.zip_with(chunk, previous, _difference)


def delta_chunk_inverse(chunk: Column, base: Column) -> Column:
    """Ordered fold over a chunk (bounded by its horizon)."""
    whole = F.aggregate(chunk, F.array(base), lambda acc, p: F.concat(acc, F.array(_sum(p, F.element_at(acc, -1)))))
    return F.slice(whole, 2, F.size(chunk))


def pose_delta_48(action: Column, previous: Column, extrinsics: Column) -> Column:
    """Consecutive 48-D delta in the camera frame: per hand xyz step, R2 R1^T as roll, pitch, yaw, three zeros, tip steps."""

    def made(inv: Column) -> Column:
        parts = []
        for b in (0, 24):
            now = R.compose(inv, d9_to_pose(V.take_span(action, b, b + 9)))
            was = R.compose(inv, d9_to_pose(V.take_span(previous, b, b + 9)))

            def wrist(p: Column) -> Column:
                turn = R.matrix_to_euler(R.multiply3(R.rotation_of(F.get(p, 0)), R.rotation_of(F.get(p, 1)), transpose_b=True))
                return F.concat(V.subtract(R.translation_of(F.get(p, 0)), R.translation_of(F.get(p, 1))), F.reverse(turn))

            parts += [V.let(F.array(now, was), wrist), V.zeros(3)]
            for t in range(5):
                a, z = b + 9 + 3 * t, b + 12 + 3 * t
                parts.append(R.rotate_vector(inv, V.subtract(V.take_span(action, a, z), V.take_span(previous, a, z))))
        return F.concat(*parts)

    return V.let(R.invert(extrinsics), made)


def bimanual_relative(chunk: Column, left: Column, right: Column) -> Column:
    """(T, 14) xyz+ypr+gripper twice; each arm in its own target frame, grippers copied."""

    def arm(row: Column, base: Column, at: int) -> Column:
        moved = pose_to_xyzypr(R.compose(R.invert(xyzypr_to_pose(base)), xyzypr_to_pose(V.take_span(row, at, at + 6))))
        return F.concat(moved, V.take_span(row, at + 6, at + 7))

    return F.transform(chunk, lambda row: F.concat(arm(row, left, 0), arm(row, right, 7)))


def resample_pose(a: Column, b: Column, f: Column) -> Column:
    """xyz + wxyz between two poses: linear translation, slerp rotation; invalid marks give 1e9."""
    bad = F.exists(F.concat(a, b), lambda x: x >= INVALID)
    xyz = F.zip_with(V.take_span(a, 0, 3), V.take_span(b, 0, 3), lambda p, q: p + (q - p) * f)
    return F.when(bad, F.array_repeat(F.lit(INVALID_OUT), 7)).otherwise(
        F.concat(xyz, R.slerp(V.take_span(a, 3, 7), V.take_span(b, 3, 7), f))
    )


def _marks(chunk: Column, count: int, between) -> Column:
    """``between(row before, row after, fraction)`` at ``count`` even marks from the first row to the last."""
    step = 1.0 / max(count - 1, 1)

    def over(rows: Column) -> Column:
        last = F.size(rows) - 1

        def mark(x: Column) -> Column:
            i = F.greatest(F.least(F.floor(x + 1e-9).cast("int"), last - 1), F.lit(0))  # a mark on a row belongs to that row
            pair = F.struct(F.get(rows, i).alias("a"), F.get(rows, F.least(i + 1, last)).alias("b"), F.greatest(x - i, F.lit(0.0)).alias("f"))
            return V.let(pair, lambda p: between(p["a"], p["b"], p["f"]))

        return F.transform(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: j * step * last), mark)

    return V.let(chunk, over)


def _unless_invalid(chunk: Column, count: int, width: int, made: Column) -> Column:
    """``made``, or the reporting value everywhere when any value of the chunk is a marker; null for no rows."""
    bad = F.exists(chunk, lambda row: F.exists(row, lambda x: x >= INVALID))
    spoilt = F.array_repeat(F.array_repeat(F.lit(INVALID_OUT), width), count)
    return F.when(bad, spoilt).when(F.size(chunk) > 0, made)


def resample_pose_chunk(chunk: Column, count: int) -> Column:
    """(T, 7) rows of xyz + wxyz to ``count`` even marks: linear translation, slerp along the short way.

    A zero quaternion counts as no turn. Signs follow the row before, so the output is continuous over the chunk. One row
    is repeated.
    """

    def whole(row: Column) -> Column:
        q = F.transform(V.take_span(row, 3, 7), lambda x: x.cast("double"))
        n = F.sqrt(V.vector_sum(V.multiply(q, q)))
        return V.let(n, lambda m: F.when(m > 0, F.transform(q, lambda x: x / m)).otherwise(V.literal([1, 0, 0, 0])))

    def signed(quats: Column) -> Column:
        """Each row against the one before it, whose own sign counts: a running product of signs."""
        after = lambda i: V.vector_sum(V.multiply(F.get(quats, i - 1), F.get(quats, i)))

        def sign(done: Column, i: Column) -> Column:
            against = F.get(done, i - 1) * after(i) < 0
            return F.concat(done, F.array(F.when((i > 0) & against, -1.0).otherwise(1.0)))

        signs = F.aggregate(F.sequence(F.lit(0), F.size(quats) - 1), F.array().cast("array<double>"), sign)
        return F.zip_with(quats, signs, lambda q, s: F.transform(q, lambda x: x * s))

    def between(a: Column, b: Column, f: Column) -> Column:
        xyz = F.zip_with(V.take_span(a, 0, 3), V.take_span(b, 0, 3), lambda p, q: p + (q - p) * f)
        return F.concat(xyz, R.slerp(V.take_span(a, 3, 7), V.take_span(b, 3, 7), f))

    rows = F.zip_with(chunk, V.let(F.transform(chunk, whole), signed), lambda row, q: F.concat(V.take_span(row, 0, 3), q))
    return _unless_invalid(chunk, count, 7, _marks(rows, count, between))


def resample_euler_chunk(chunk: Column, count: int, width: int = 6) -> Column:
    """(T, 6) rows of xyz + three angles, or (T, 7) with a gripper, to ``count`` even marks; angles take the short way
    from row to row and come back in [-pi, pi)."""
    turn = 2 * math.pi

    def between(a: Column, b: Column, f: Column) -> Column:
        def cell(x: Column, y: Column, i: Column) -> Column:
            gap = y - x
            short = gap - turn * F.floor((gap + math.pi) / turn)
            # half a turn keeps the direction of the step
            short = F.when((short == -math.pi) & (gap > 0), F.lit(math.pi)).otherwise(short)
            at = x + short * f + math.pi
            return F.when((i >= 3) & (i < 6), at - turn * F.floor(at / turn) - math.pi).otherwise(x + gap * f)

        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: cell(F.get(a, i), F.get(b, i), i))

    return _unless_invalid(chunk, count, width, _marks(chunk, count, between))


def head_to_world(p: Column, quat: Column, t: Column) -> Column:
    return V.add(R.rotate_by_quat(quat, p), t)


def project(p: Column, fx: float, fy: float, cx: float, cy: float, width: int, height: int) -> Column:
    """Camera point -> struct(u, v, visible); null pixel at zero depth."""
    x, y, z = F.get(p, 0), F.get(p, 1), F.get(p, 2)
    u, v = F.try_divide(x * fx, z) + cx, F.try_divide(y * fy, z) + cy
    inside = (z > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return F.struct(u.alias("u"), v.alias("v"), F.coalesce(inside, F.lit(False)).alias("visible"))


def gaze_endpoint(yaw: Column, pitch: Column, depth: Column, pose: Column) -> Column:
    x, y = F.tan(yaw), F.tan(pitch)
    n = F.sqrt(x * x + y * y + 1)
    return R.transform_point(pose, F.array(x / n * depth, y / n * depth, F.lit(1.0) / n * depth))
