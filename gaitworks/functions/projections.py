"""Column-level projections: key lists, renames, grasp, grippers, text and JSON helpers."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitworks.functions import vectors as V


def modality_key(key: str, width: int | None = None) -> Column:
    """``"action[2:10:2]"``, ``"action[3]"`` or ``"action.neck"`` as a vector column."""
    m = re.fullmatch(r"(.*?)\[([^\]]*)\]", key)
    if not m:
        return F.col(f"`{key}`")
    col, parts = F.col(f"`{m.group(1)}`"), m.group(2).split(":")
    if len(parts) == 1:
        i = int(parts[0])
        return F.array(F.element_at(col, i + 1 if i >= 0 else i))
    start = int(parts[0] or 0)
    step = int(parts[2]) if len(parts) > 2 and parts[2] else 1
    n = F.size(col)
    first = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    stop = F.lit(int(parts[1])) if parts[1] else n
    if parts[1] and int(parts[1]) < 0:
        stop = n + int(parts[1])
    span = F.slice(col, first + 1, F.greatest(F.least(stop, n) - first, F.lit(0)))
    return span if step == 1 else F.filter(span, lambda _, i: i % step == 0)


def select_keys(keys: Sequence[str]) -> Column:
    """Concatenate the vectors of a key list in order."""
    return F.concat(*[modality_key(k) for k in keys])


def flatten_struct(df: DataFrame, column: str, sep: str = ".") -> DataFrame:
    """A nested struct column becomes one column per leaf, named by its path."""
    found: list[Column] = []

    def walk(path: list[str], kind: T.DataType):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk([*path, f.name], f.dataType)
        else:
            found.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path[1:])))

    walk([column], df.schema[column].dataType)
    return df.select(*[c for c in df.columns if c != column], *found)


def repack(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Select and rename: target (``a/b`` makes a nested struct) -> source column."""
    tree: dict = {}
    for target, source in mapping.items():
        node, *rest = [tree, *target.split("/")]
        for part in rest[:-1]:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ValueError(f"{target}: {part} is already a leaf")
        if rest[-1] in node:
            raise ValueError(f"duplicate target {target}")
        node[rest[-1]] = source

    def build(node) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else F.col(v)).alias(k) for k, v in node.items()])

    return df.select(*[(build(v) if isinstance(v, dict) else F.col(v)).alias(k) for k, v in tree.items()])


def rename_by_patterns(df: DataFrame, patterns: Mapping[str, str | None]) -> DataFrame:
    """First full match renames a column, ``None`` drops it; two columns on one target is an error."""
    out: dict[str, str] = {}
    for c in df.columns:
        new: str | None = c
        for pat, rep in patterns.items():
            if re.fullmatch(pat, c):
                new = None if rep is None else re.sub(f"^{pat}$", rep, c)
                break
        if new is None:
            continue
        if new in out:
            raise ValueError(f"columns {out[new]} and {c} both become {new}")
        out[new] = c
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in out.items()])


def renumber_path(path: Column, old: Column, new: Column) -> Column:
    """``episode_000012`` in a path becomes the new number: six digits at least, all of a longer number."""
    token = lambda i: F.format_string("episode_%06d", i.cast("bigint"))
    return F.regexp_replace(path, F.concat(token(old), F.lit("(?![0-9])")), token(new))


def default_text(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def json_block(text: Column, schema: str) -> Column:
    """The ``{...}`` block inside free text, parsed; null when there is none or it is malformed."""
    block = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.from_json(block, schema, {"mode": "PERMISSIVE"})


def openness(hand: Column, lo: Column, hi: Column, threshold: float = 0.3, invert: bool = False) -> Column:
    """Mean in-range position over joints whose range exceeds ``threshold`` (all joints if none does)."""
    live = F.zip_with(lo, hi, lambda a, b: b - a > threshold)
    pos = F.transform(
        hand, lambda x, i: V.clip((x - F.get(lo, i)) / F.greatest(F.get(hi, i) - F.get(lo, i), F.lit(1e-6)), 0, 1)
    )
    used = F.filter(pos, lambda _, i: F.get(live, i) | ~F.exists(live, lambda a: a))
    mean = V.vector_sum(used) / F.size(used)
    return 1.0 - mean if invert else mean


def hand_from_openness(open_: Column, lo: Column, hi: Column, threshold: float = 0.3, invert: bool = False) -> Column:
    """Inverse: live joints by openness, the others at mid-range."""
    o = V.clip(open_, 0, 1)
    share = 1.0 - o if invert else o
    live = F.zip_with(lo, hi, lambda a, b: b - a > threshold)
    none = ~F.exists(live, lambda a: a)
    return F.transform(
        lo, lambda a, i: F.when(F.get(live, i) | none, a + share * (F.get(hi, i) - a)).otherwise((a + F.get(hi, i)) / 2)
    )


# Sign flips of the 14 joints, gripper dims; ranges of the slider (m) and of two angles (rad), lengths of the linkage (m)
JOINT_FLIP = [1, -1, -1, 1, 1, 1, 1, 1, -1, -1, 1, 1, 1, 1]
GRIPPER_DIMS = (6, 13)
SLIDER, TURN, JOINT = (0.01844, 0.05800), (0.5476, 1.6296), (-0.6213, 1.4910)
ROD, HORN = 0.036, 0.022


def linkage_angle(slider: Column) -> Column:
    """Angle of a horn that drives a slider through a rod: sin(angle) = (horn^2 + slider^2 - rod^2) / (2 horn slider)."""
    return F.asin(V.clip((HORN**2 + slider * slider - ROD**2) / (2 * HORN * slider), -1, 1))


def _share_of(span: tuple[float, float]):
    lo, hi = span
    return lambda x: lo + x * (hi - lo), lambda angle: (angle - lo) / (hi - lo)


# How each unit of a gripper reading becomes an angle, and an angle that unit
GRIPPER_UNITS = {
    "slider share": (lambda x: linkage_angle(_share_of(SLIDER)[0](x)), None),
    "turn share": _share_of(TURN),
    "turn from start": (lambda x: x + TURN[0], lambda angle: angle - TURN[0]),
    "joint share": _share_of(JOINT),
}


def gripper(x: Column, source: str, target: str) -> Column:
    """A gripper reading in another unit, by way of the angle it stands for; swap the units for the way back."""
    return GRIPPER_UNITS[target][1](GRIPPER_UNITS[source][0](x))


def mirrored(v: Column, signs: Sequence[int] = tuple(JOINT_FLIP)) -> Column:
    return F.zip_with(v, V.literal(list(signs)), lambda x, s: x * s)


def on_dims(v: Column, dims: Sequence[int], fn) -> Column:
    """``fn`` on the listed dimensions, the others as they are."""
    return F.transform(v, lambda x, i: F.when(i.isin(*dims), fn(x)).otherwise(x))


def permutation(names: Sequence[str], reference: Sequence[str]) -> list[int]:
    """Source position of every reference name; both lists must hold the same unique names."""
    if len(set(names)) != len(names) or set(names) != set(reference) or len(names) != len(reference):
        raise ValueError("name lists differ or repeat a name")
    at = {n: i for i, n in enumerate(names)}
    return [at[n] for n in reference]


def recorded_order(spans: Sequence[tuple[int, int]], width: int) -> list[int]:
    """Positions in the model vector of each recorded dimension, from the declared spans."""
    where: list[int | None] = [None] * width
    model = 0
    for a, b in spans:
        for i in range(a, b):
            where[i] = model
            model += 1
    if any(p is None for p in where):
        raise ValueError("some recorded dimensions are not covered by any span")
    return where  # type: ignore[return-value]


# Fingertip joints among the 21 of a hand, in two orderings
TIPS_FIRST_FIVE = [0, 1, 2, 3, 4]
TIPS_EVERY_FOURTH = [4, 8, 12, 16, 20]


def keypoints_to_48(kp: Column, body: Column) -> Column:
    """Two wrists (xyz + wxyz) and 2 x 21 keypoints -> per arm xyz, rot6d, five tips."""
    from gaitworks.functions import rotations as R

    def arm(base: int) -> Column:
        quat = V.take_span(kp, base + 3, base + 7)
        tips = lambda ids: F.concat(*[V.take_span(kp, base + 7 + 3 * j, base + 10 + 3 * j) for j in ids])
        fourth = F.lower(body).contains("mecka") | F.lower(body).contains("scale")
        return F.concat(
            V.take_span(kp, base, base + 3), R.rot6d_from_unit_quat(quat),
            F.when(fourth, tips(TIPS_EVERY_FOURTH)).otherwise(tips(TIPS_FIRST_FIVE)),
        )

    return F.concat(arm(0), arm(70))


def matrix_column(m: Column, j: int) -> Column:
    """The upper three entries of column ``j`` of a row-major 4x4 matrix: an axis, or (3) the position."""
    return F.filter(m, lambda _, i: (i % 4 == j) & (i < 12))


def hand_vector(wrist: Column, tips: Column) -> Column:
    """Wrist position, its first two axes, and the positions of an array of fingertip transforms."""
    points = F.flatten(F.transform(tips, lambda t: matrix_column(t, 3)))
    return F.concat(matrix_column(wrist, 3), matrix_column(wrist, 0), matrix_column(wrist, 1), points)
