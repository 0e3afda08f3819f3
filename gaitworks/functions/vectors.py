"""Vector columns are ``array<double>``; everything here is a built-in expression."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def spread(v: Column, width: int, prefix: str, digits: int | None = 6) -> list[Column]:
    """One scalar column per dimension, rounded for output."""
    cells = [F.get(v, i) for i in range(width)]
    return [(c if digits is None else F.round(c, digits)).alias(f"{prefix}{i}") for i, c in enumerate(cells)]


def explode_vector(df: DataFrame, column: str, keep: Sequence[str] = (), dim: str = "dim", value: str = "value") -> DataFrame:
    """Long form: one row per element with its 0-based dimension."""
    return df.select(*keep, F.posexplode(column).alias(dim, value))


def take_span(v: Column, start: int, stop: int, step: int = 1) -> Column:
    """``v[start:stop:step]`` of a vector."""
    part = F.slice(v, start + 1, stop - start)
    if step == 1:
        return part
    return F.filter(part, lambda _, i: i % step == 0)


def concat_spans(v: Column, spans: Sequence[tuple[int, int]]) -> Column:
    return F.concat(*[take_span(v, a, b) for a, b in spans])


def require_width(v: Column, width: int, label: str) -> Column:
    """The vector itself, or an error naming the column when its width is wrong."""
    bad = F.raise_error(F.format_string(f"{label}: width %d, expected {width}", F.size(v))).cast("array<double>")
    return F.when(F.size(v) == width, v).otherwise(bad)


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.get(F.transform(F.array(value), use), 0)


def bound(fn):
    """Decorator: evaluate each vector argument once however often ``fn`` reads it."""

    @functools.wraps(fn)
    def go(*vectors, **options):
        if len(vectors) == 1:
            return let(vectors[0], lambda x: fn(x, **options))
        return let(F.array(*vectors), lambda p: fn(*[F.get(p, i) for i in range(len(vectors))], **options))

    return go


def permute(v: Column, order: Sequence[int]) -> Column:
    """``v[order]``; wide orders loop over one constant array to keep generated code small."""
    if len(order) <= 12:
        return let(v, lambda x: F.array(*[F.get(x, i) for i in order]))
    return let(v, lambda x: F.transform(F.array(*[F.lit(int(i)) for i in order]), lambda i: F.get(x, i)))


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def pad_right(v: Column, width: int) -> Column:
    return F.concat(v, zeros(F.greatest(F.lit(width) - F.size(v), F.lit(0))))


def pad_or_trim(v: Column, width: int) -> Column:
    return F.slice(pad_right(v, width), 1, width)


def valid_mask(v: Column, width: int) -> Column:
    """1.0 where a padded position carries data."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i < F.size(v), 1.0).otherwise(0.0))


def zip_op(a: Column, b: Column, op) -> Column:
    return F.zip_with(a, b, op)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def fold(v: Column, start: Column, step) -> Column:
    return F.aggregate(v, start, step)


def vector_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def clip(x: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.least(F.greatest(x, lo), hi)


def sincos(v: Column) -> Column:
    return F.concat(F.transform(v, F.sin), F.transform(v, F.cos))


def tail_shift(chunk: Column, k: int, filler: Column) -> Column:
    """Drop the first ``k`` steps of a chunk and fill the end, length kept."""
    n = F.size(chunk)
    kept = F.slice(chunk, k + 1, F.greatest(n - k, F.lit(0)))
    return F.concat(kept, F.array_repeat(filler, F.least(n, F.lit(k))))
