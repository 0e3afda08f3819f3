"""Predicates over catalogue rows, frames and episodes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def catalogue_filter(df: DataFrame, predicates: Iterable[str] | Mapping[str, object], deleted: str | None = "is_deleted") -> DataFrame:
    """Rows matching every predicate; deleted rows never match.

    Predicates are SQL expressions, or a mapping column -> wanted value.  An
    expression that is not boolean is an error at analysis time.
    """
    if isinstance(predicates, Mapping):
        conds = [F.col(k).eqNullSafe(F.lit(v)) for k, v in predicates.items()]
    else:
        texts = list(predicates)
        kinds = df.select(*[F.expr(t).alias(f"p{i}") for i, t in enumerate(texts)]).dtypes if texts else []
        bad = [t for t, (_, k) in zip(texts, kinds) if k != "boolean"]
        if bad:
            raise TypeError(f"predicates must be boolean: {bad}")
        conds = [F.coalesce(F.expr(t), F.lit(False)) for t in texts]
    if deleted is not None:
        conds.append(~F.coalesce(F.col(deleted), F.lit(False)))
    return df.where(reduce(lambda a, b: a & b, conds, F.lit(True)))


def normalise_row(df: DataFrame, deleted: str, names: Sequence[str], out: str) -> DataFrame:
    """Null deleted flag to false; ``out`` = first non-blank of ``names``."""
    first = F.coalesce(*[F.when(~blank(F.col(n)), F.col(n)) for n in names])
    return df.withColumns({deleted: F.coalesce(F.col(deleted), F.lit(False)), out: first})


def require_path(df: DataFrame, path: str) -> DataFrame:
    return df.where(~blank(F.col(path)))


def first_non_empty(df: DataFrame, text: str, keys: Sequence[str], order: str) -> DataFrame:
    """Keep groups whose first row carries a non-blank text."""
    first = df.groupBy(*keys).agg(F.min_by(F.coalesce(F.col(text), F.lit("")), order).alias("_t")).where(~blank(F.col("_t")))
    return df.join(first.select(*keys), list(keys), "left_semi")


def moving_frames(df: DataFrame, position: str, gripper: str, eps: float, keys: Sequence[str] = ("episode_index",), enabled: bool = True) -> DataFrame:
    """Steps whose delta position exceeds ``eps`` on any axis or whose gripper changed."""
    from gaitworks.operators.ordering import over_frames

    if not enabled:
        return df
    got = over_frames(df, {"_g": lambda w: F.lag(gripper, 1).over(w)}, keys, before=1)
    moved = F.exists(F.col(position), lambda x: F.abs(x) > eps)
    changed = F.coalesce(F.col(gripper) != F.col("_g"), F.lit(False))
    return got.where(moved | changed).drop("_g")


def cap_lengths(episodes: DataFrame, low: int, high: int, length: str = "length") -> DataFrame:
    return episodes.where(F.col(length) >= low).withColumn(length, F.least(F.col(length), F.lit(high)))


def long_conversations(turns: DataFrame, words: int, key: str = "conv_id", text: str = "text") -> DataFrame:
    """Conversations with more than ``words`` words in all turns."""
    n = F.when(blank(F.col(text)), 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " ")))
    return turns.groupBy(key).agg(F.sum(n).alias("words")).where(F.col("words") > words)


def outlier_episodes(long: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    big = long.where(F.abs("value") > threshold)
    return big.groupBy(*keys, "dim").agg(F.count(F.lit(1)).alias("hits"), F.max(F.abs("value")).alias("worst"))


def width_report(df: DataFrame, columns: Mapping[str, int], keys: Sequence[str]) -> DataFrame:
    """Per group: rows whose vector is missing or has the wrong width; nothing fails."""
    aggs = []
    for c, n in columns.items():
        if c in df.columns:
            aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(F.size(c) != n).alias(f"{c}_wrong_width")]
        else:
            aggs.append(F.count(F.lit(1)).alias(f"{c}_missing"))
    out = df.groupBy(*keys).agg(*aggs)
    names = [a for a in out.columns if a not in keys]
    return out.where(reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names]))


def missing_stats(features: DataFrame, have: DataFrame, required: Sequence[str], feature: str = "feature", stat: str = "stat") -> DataFrame:
    """(feature, stat) pairs that should exist and do not; ``required`` is a fixed list."""
    want = features.withColumn(stat, F.explode(F.array(*[F.lit(r) for r in required])))
    return want.join(have.select(feature, stat), [feature, stat], "left_anti").withColumn("missing", F.lit(True))
