"""Discretisation of actions: bins, quantile tables, DCT symbols."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaitworks.functions import vectors as V


def uniform_bin(x: Column, lo, hi, n: int) -> Column:
    """1-based index on ``linspace(lo, hi, n)`` of the clipped value (right edges open, as ``digitize``)."""
    lo, hi = (c if isinstance(c, Column) else F.lit(float(c)) for c in (lo, hi))
    y = V.clip(x, lo, hi)
    step = (hi - lo) / (n - 1)
    edge = lambda k: F.when(k >= n - 1, hi).otherwise(k * step + lo)
    return _edges_passed(y, F.floor((y - lo) / step), edge, n).cast("int")


def _edges_passed(y: Column, guess: Column, edge, n: int) -> Column:
    """How many of ``n`` rising edges are at or below y; ``guess`` is the last one's number give or take one."""
    g = V.clip(guess, 0, n - 1)
    at = F.when(y < edge(g), g - 1).when((g + 1 < n) & (y >= edge(g + 1)), g + 1).otherwise(g)
    return at + 1


def uniform_token(x: Column, lo, hi, n: int, vocab: int, valid: Column | None = None, invalid: int = -1) -> Column:
    t = F.lit(vocab - 1) - uniform_bin(x, lo, hi, n)
    return t if valid is None else F.when(valid, t).otherwise(F.lit(invalid))


def uniform_decode(token: Column, lo, hi, n: int, vocab: int) -> Column:
    """Bin centre of a token."""
    lo, hi = (c if isinstance(c, Column) else F.lit(float(c)) for c in (lo, hi))
    i = V.clip(F.lit(vocab - 1) - token - 1, 0, n - 2)
    return lo + (hi - lo) / (n - 1) * (i + 0.5)


def quantile_token(x: Column, thresholds: Column) -> Column:
    """Number of thresholds at or below x."""
    return F.size(F.filter(thresholds, lambda t: t <= x))


def quantile_decode(token: Column, thresholds: Column) -> Column:
    return F.get(thresholds, F.greatest(F.least(token, F.size(thresholds)) - 1, F.lit(0)))


def state_prompt(text: Column, state: Column, bins: int = 256) -> Column:
    """``Task: ..., State: b1 b2 ...;`` with the state in [-1, 1] cut into ``bins`` bins; below -1 the bin is -1."""
    edge = lambda k: k * (2 / bins) - 1
    ids = F.transform(state, lambda x: (_edges_passed(x, F.floor((x + 1) * (bins / 2)), edge, bins) - 1).cast("int").cast("string"))
    clean = F.replace(F.replace(F.trim(text), F.lit("_"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit("Task: "), clean, F.lit(", State: "), F.array_join(ids, " "), F.lit(";"))


def _cosines(t: int) -> list[list[float]]:
    rows = []
    for k in range(t):
        s = math.sqrt((1 if k == 0 else 2) / t)
        rows.append([s * math.cos(math.pi * (2 * i + 1) * k / (2 * t)) for i in range(t)])
    return rows


def _apply(chunk: Column, table: Sequence[Sequence[float]], width: int | None = None) -> Column:
    """table @ chunk for an array of row vectors; with their ``width`` as plain sums, without an array a term.

    The sums stand inside ``let``: written out where rows are exploded, they make one method too long to be compiled.
    """
    if width is not None:
        cell = lambda c, row, j: reduce(lambda acc, p: acc + F.lit(p[1]) * F.get(F.get(c, p[0]), j), enumerate(row), F.lit(0.0))
        return V.let(chunk, lambda c: F.array(*[F.array(*[cell(c, row, j) for j in range(width)]) for row in table]))
    width = F.size(F.get(chunk, 0))
    zero = F.array_repeat(F.lit(0.0), width)
    const = F.array(*[V.literal(r) for r in table])
    return F.transform(
        const,
        lambda row: F.aggregate(
            F.zip_with(row, chunk, lambda c, v: F.transform(v, lambda x: c * x)), zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)
        ),
    )


def dct_quantise(chunk: Column, steps: int, scale: float = 10.0, width: int | None = None) -> Column:
    """Orthonormal DCT-II over time per dimension, times scale, rounded half to even."""
    return F.transform(_apply(chunk, _cosines(steps), width), lambda v: F.transform(v, lambda x: F.rint(x * scale)))


def dct_reconstruct(symbols: Column, steps: int, scale: float = 10.0, width: int | None = None) -> Column:
    c = _cosines(steps)
    inverse = [[c[k][i] for k in range(steps)] for i in range(steps)]
    return _apply(F.transform(symbols, lambda v: F.transform(v, lambda x: x / scale)), inverse, width)


def clip_ids(token: Column, shift: int, low: int, high: int) -> Column:
    return F.least(F.greatest(token + shift, F.lit(low)), F.lit(high))


def snap(x: Column, lo: float, hi: float, step: float) -> Column:
    return F.rint(V.clip(x, lo, hi) / step) * step
