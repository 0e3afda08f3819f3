"""Normalisation of vector columns by statistics columns on the same row.

Zero-width ranges are handled differently on purpose: min-max gives 0, q99 and
mean-std keep x, scale gives 0, the tolerant form keeps x for actions and gives
0 for states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.functions.vectors import clip


def with_stats(df: DataFrame, stats: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Attach statistics arrays: one row, or one row per registered embodiment / horizon, broadcast so that rows stay where they are."""
    if on:
        return df.join(F.broadcast(stats), list(on))
    one = stats.select(F.struct("*").alias("_s"))
    return df.withColumn("_s", one.scalar()).select("*", "_s.*").drop("_s")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _each(v, cols: Sequence, fn) -> Column:
    """Element-wise fn(x, *stats[i]) by index."""
    cols = [_c(c) for c in cols]
    return F.transform(_c(v), lambda x, i: fn(x, *[F.get(c, i) for c in cols]))


def min_max(v, lo="min", hi="max") -> Column:
    return _each(v, (lo, hi), lambda x, a, b: F.when(a != b, clip(2 * (x - a) / F.nullif(b - a, F.lit(0.0)) - 1, -1, 1)).otherwise(F.lit(0.0)))


def q99(v, lo="q01", hi="q99") -> Column:
    return _each(v, (lo, hi), lambda x, a, b: clip(F.when(a != b, 2 * (x - a) / F.nullif(b - a, F.lit(0.0)) - 1).otherwise(x), -1, 1))


def mean_std(v, mean="mean", std="std") -> Column:
    return _each(v, (mean, std), lambda x, m, s: F.when(s != 0, (x - m) / F.nullif(s, F.lit(0.0))).otherwise(x))


def scale(v, lo="min", hi="max") -> Column:
    def one(x, a, b):
        top = F.greatest(F.abs(a), F.abs(b))
        return F.when(top != 0, x / F.nullif(top, F.lit(0.0))).otherwise(F.lit(0.0))

    return _each(v, (lo, hi), one)


def binary(v) -> Column:
    return F.transform(_c(v), lambda x: F.when(x > 0.5, 1.0).otherwise(0.0))


def undo_range(v, lo, hi) -> Column:
    """Inverse of min-max and q99 inside their range."""
    return _each(v, (lo, hi), lambda x, a, b: (x + 1) / 2 * (b - a) + a)


def undo_mean_std(v, mean="mean", std="std") -> Column:
    return _each(v, (mean, std), lambda x, m, s: F.when(s != 0, x * s + m).otherwise(x))


def near_zero(a: Column, b: Column) -> Column:
    return F.abs(b - a) < 1e-4 * (F.abs(b) + F.abs(a) + 1e-8)


def tolerant(v, lo, hi, is_action: bool, mask: Column | None = None) -> Column:
    """Range map with a relative zero test, clipped to [-1, 1].

    A flat range keeps x for actions and gives 0 for states; masked-off elements
    keep x before the clip; NaN becomes 0 for states.
    """

    def one(x, a, b, *m):
        flat = near_zero(a, b)
        y = 2 * (x - a) / F.when(flat, F.lit(1.0)).otherwise(b - a) - 1
        y = F.when(flat, x if is_action else F.lit(0.0)).otherwise(y)
        if m:
            y = F.when(m[0], y).otherwise(x)
        return F.when(F.isnan(y), y if is_action else F.lit(0.0)).otherwise(clip(y, -1, 1))

    return _each(v, (lo, hi) if mask is None else (lo, hi, mask), one)


def undo_tolerant(v, lo, hi) -> Column:
    return _each(v, (lo, hi), lambda x, a, b: F.when(near_zero(a, b), x).otherwise((x + 1) / 2 * (b - a) + a))


def zscore_eps(v, mean="mean", std="std") -> Column:
    return _each(v, (mean, std), lambda x, m, s: (x - m) / (s + 1e-6))


def undo_zscore_eps(v, mean="mean", std="std") -> Column:
    """Extra dimensions beyond the statistics are kept."""
    return _each(v, (mean, std), lambda x, m, s: F.when(m.isNull(), x).otherwise(x * (s + 1e-6) + m))


def quantile_eps(v, lo="q01", hi="q99") -> Column:
    """Quantile map with tolerance: a flat range gives 0, the rest is clipped."""
    return _each(
        v, (lo, hi),
        lambda x, a, b: F.when(near_zero(a, b), F.lit(0.0)).otherwise(clip((x - a) / (b - a + 1e-6) * 2 - 1, -1, 1)),
    )


def undo_quantile_eps(v, lo="q01", hi="q99") -> Column:
    return _each(v, (lo, hi), lambda x, a, b: F.when(a.isNull(), x).otherwise((x + 1) / 2 * (b - a + 1e-6) + a))


def clamp_standardise(v, lo="min", hi="max", mean="mean", std="std") -> Column:
    return _each(v, (lo, hi, mean, std), lambda x, a, b, m, s: (clip(x, a, b) - m) / (s + 1e-6))


def rescale(v, from_lo, from_hi, to_lo: float, to_hi: float) -> Column:
    return _each(
        v, (from_lo, from_hi),
        lambda x, a, b: F.when(b != a, (x - a) / F.nullif(b - a, F.lit(0.0)) * (to_hi - to_lo) + to_lo).otherwise(F.lit(float(to_lo))),
    )


def undo_clamp_standardise(v, mean="mean", std="std") -> Column:
    return _each(v, (mean, std), lambda x, m, s: x * (s + 1e-6) + m)


def undo_rescale(v, from_lo, from_hi, to_lo: float, to_hi: float) -> Column:
    return _each(v, (from_lo, from_hi), lambda x, a, b: (x - to_lo) / (to_hi - to_lo) * (b - a) + a)


def concat_bounds(stats: DataFrame, modes: Sequence[tuple[str, str]], feature: str = "feature", dim: str = "dim") -> DataFrame:
    """Bounds of every (feature, mode) in the given order as one long table: position, lo, hi."""
    order = {f: i for i, (f, _) in enumerate(modes)}
    lo = hi = None
    for f, mode in modes:
        pair = {
            "min_max": (F.col("min"), F.col("max")), "q99": (F.col("q01"), F.col("q99")),
            "mean_std": (F.col("mean") - F.col("std"), F.col("mean") + F.col("std")),
        }[mode]
        here = F.col(feature) == f
        lo = F.when(here, pair[0]) if lo is None else lo.when(here, pair[0])
        hi = F.when(here, pair[1]) if hi is None else hi.when(here, pair[1])
    ranks = F.array(*[F.lit(f) for f in order])
    listed = stats.where(F.col(feature).isin(*order)).select(
        (F.array_position(ranks, F.col(feature)) - 1).alias("key_rank"), F.col(feature), F.col(dim), lo.alias("lo"), hi.alias("hi")
    )
    from pyspark.sql import Window

    # one row per declared dimension: bounded by the schema
    w = Window.partitionBy(F.lit(0)).orderBy("key_rank", dim)
    return listed.withColumn("position", F.row_number().over(w).cast("long") - 1)


def perturb(v, lo, hi, std: float, seed: str, row_key: Sequence[Column], training: bool = True) -> Column:
    """Gaussian noise on live dimensions, clipped; the draw is a hash of the row key (Box-Muller)."""
    import math

    from gaitworks.functions import hashing

    if not training:
        return _c(v)

    def one(x, a, b, i):
        u1 = (hashing.draw32(seed + "-r", *row_key, i) + 1) / F.lit(2.0**32 + 1)
        u2 = hashing.uniform(seed + "-a", *row_key, i)
        z = F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
        return clip(x + F.when(near_zero(a, b), F.lit(0.0)).otherwise(z * std), -1, 1)

    lo, hi = _c(lo), _c(hi)
    return F.transform(_c(v), lambda x, i: one(x, F.get(lo, i), F.get(hi, i), i))


def dropout(v, p: float, seed: str, row_key: Sequence[Column], training: bool = True) -> Column:
    """The whole vector to zero with probability ``p``."""
    from gaitworks.functions import hashing

    if not training or p <= 0:
        return _c(v)
    return F.when(hashing.uniform(seed, *row_key) < p, F.transform(_c(v), lambda x: F.lit(0.0))).otherwise(_c(v))


def fill_constant(frames: DataFrame, listed: DataFrame, stats: DataFrame, column: str, key: str = "episode_index") -> DataFrame:
    """Listed episodes get the midpoint of min and max in every frame."""
    marked = frames.join(listed.select(key).distinct().withColumn("_fill", F.lit(True)), key, "left")
    mid = F.zip_with("min", "max", lambda a, b: (a + b) / 2)
    return with_stats(marked, stats.select("min", "max")).withColumn(
        column, F.when(F.col("_fill"), mid).otherwise(F.col(column))
    ).drop("_fill", "min", "max")
