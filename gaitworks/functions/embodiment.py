"""Slot layouts of the supported bodies and the expressions that apply them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaitworks.functions import vectors as V

# Canonical widths and, per body, (source start, source stop, canonical start)
STATE_WIDTH, ACTION_WIDTH = 45, 36
STATE_SLOTS = {
    "g1": [(0, 43, 0)],
    "g1neck": [(0, 45, 0)],
    "h1": [(0, 12, 0), (12, 26, 14), (26, 38, 28), (38, 39, 40)],
}
ACTION_SLOTS = {
    "g1": [(0, 36, 0)],
    "g1neck": [(0, 36, 0)],
    "h1": [(0, 12, 0), (12, 34, 14)],
}
# Layout of the model vector (token 64, hands 14, neck 2) and the dims a body lacks
MODEL_WIDTH = 80
MODEL_ABSENT = {"g1": [(78, 80)], "g1neck": [], "h1": [(76, 78), (78, 80)]}


def place(v: Column, slots: Sequence[tuple[int, int, int]], width: int) -> Column:
    """Copy source spans to their canonical slots; what nothing fills is zero."""
    parts, at = [], 0
    for a, b, dst in sorted(slots, key=lambda s: s[2]):
        if dst > at:
            parts.append(V.zeros(dst - at))
        parts.append(V.take_span(v, a, b))
        at = dst + (b - a)
    if at < width:
        parts.append(V.zeros(width - at))
    return F.concat(*parts)


def _by_body(body: Column, made: Mapping[str, Column], otherwise: Column) -> Column:
    items = list(made.items())
    return reduce(lambda c, kv: c.when(body == kv[0], kv[1]), items[1:], F.when(body == items[0][0], items[0][1])).otherwise(otherwise)


def canonical(v: Column, body: Column, slots: Mapping[str, Sequence[tuple[int, int, int]]], width: int) -> Column:
    """Any body's vector in canonical slot order; an unknown body or width is an error."""
    made = {}
    for name, spans in slots.items():
        made[name] = place(V.require_width(v, max(b for _, b, _ in spans), name), spans, width)
    unknown = F.raise_error(F.concat(F.lit("unknown embodiment "), body)).cast("array<double>")
    return _by_body(body, made, unknown)


def valid_mask(body: Column, absent: Mapping[str, Sequence[tuple[int, int]]], width: int) -> Column:
    made = {}
    for name, gaps in absent.items():
        made[name] = V.literal([0.0 if any(a <= i < b for a, b in gaps) else 1.0 for i in range(width)])
    return _by_body(body, made, V.literal([1.0] * width))
