"""Interpolation of a recorded signal at given times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.operators import ordering


def monotone(df: DataFrame, keys: Sequence[str], time: str, order: str, index: str) -> DataFrame:
    """Drop rows whose time does not exceed every earlier time of the recording."""
    cut = ordering.with_blocks(df, index).drop("_home")
    local = F.max(time).over(ordering.block_window(keys, index).rowsBetween(Window.unboundedPreceding, -1))
    tops = cut.groupBy(*keys, "_blk").agg(F.max(time).alias("_t"))
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, "_blk", F.max("_t").over(wb).alias("_carry"))
    got = cut.withColumn("_l", local).join(carry, [*keys, "_blk"], "left")
    before = F.greatest("_l", "_carry")  # greatest skips nulls
    return got.where(before.isNull() | (F.col(time) > before)).drop("_l", "_carry", "_blk")


def at_times(
    signal: DataFrame, targets: DataFrame, keys: Sequence[str], time: str, order: str, value: str, target_id: str
) -> DataFrame:
    """Linear interpolation of ``value`` at each target time; outside the recording is an error.

    Samples and targets go into one time-ordered stream with a dense position;
    a forward and a backward fill bring the bracketing samples to each target.
    """
    keys = list(keys)
    s = ordering.row_index(signal, keys, [order], "_rec")
    s = monotone(s, keys, time, order, "_rec").select(
        *keys, time, F.lit(0).alias("_kind"), F.lit(None).cast(dict(targets.dtypes)[target_id]).alias(target_id),
        F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_s"),
    )
    q = targets.select(*keys, time, F.lit(1).alias("_kind"), target_id)
    both = s.unionByName(q, allowMissingColumns=True)
    both = ordering.row_index(both, keys, [time, "_kind", target_id], "_pos")
    both = ordering.fill(both, F.col("_s"), keys, "_pos", forward="_a", backward="_b")
    got = both.where("_kind = 1")
    t, a, b = F.col(time), F.col("_a"), F.col("_b")
    exact = a["t"] == t
    lerp = a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0))
    out = F.when(exact, a["v"]).when(a.isNull() | b.isNull(), F.raise_error(F.lit("target time outside the recording")).cast("double")).otherwise(lerp)
    return got.select(*keys, target_id, time, out.alias(value))
