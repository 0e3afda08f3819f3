"""Statistics of vector columns: moments, exact quantiles, masked and mixed forms.

All take the long form (keys..., value).  Moments are partial + final
aggregates.  Exact quantiles never hold a group's values in one task: a sketch
brackets every wanted rank, a second pass counts what lies outside the brackets
and keeps only distinct values inside them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.functions import vectors as V
from gaitworks.operators import ordering
from gaitworks.session import stored

Q01_Q99 = (0.01, 0.99)
SALTS = 32
CELLS = 256  # even cells of a bracket


def moments(value: str = "value") -> list[Column]:
    v = F.col(value)
    return [
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    ]


MOMENTS = ("count", "mean", "std", "min", "max")


def moment_stats(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return long.groupBy(*keys).agg(*moments(value))


def episode_moments(frames: DataFrame, column: str, keys: Sequence[str] = ("episode_index",)) -> DataFrame:
    """Moments of a vector column per episode and dimension; frames are shuffled once, before they are cut into dimensions."""
    long = lambda f: V.explode_vector(f, column, keys)
    return ordering.per_group(frames.select(*keys, column), keys, lambda f: moment_stats(long(f), [*keys, "dim"]))


def sorted_stats(
    long: DataFrame, keys: Sequence[str], probs: Sequence[float] = Q01_Q99, names: Sequence[str] = ("q01", "q99"), value: str = "value",
) -> DataFrame:
    """What ``full_stats`` gives, for groups small enough to be sorted in one array each."""
    v = F.when(~F.isnan(value), F.col(value).cast("double"))
    t = long.select(*keys, v.alias("_v")).groupBy(*keys).agg(*moments("_v"), F.sort_array(F.collect_list("_v")).alias("_xs"))
    out = []
    for p, n in zip(sorted(probs), names):
        h = (F.col("count") - 1) * F.lit(float(p))
        a, b = (F.get("_xs", r(h).cast("int")) for r in (F.floor, F.ceil))
        out.append((a + (b - a) * (h - F.floor(h))).alias(n))
    return t.select(*keys, *MOMENTS, *out)


def grouped_stats(
    frames: DataFrame, column: str, keys: Sequence[str], probs: Sequence[float] = Q01_Q99, names: Sequence[str] = ("q01", "q99"),
) -> DataFrame:
    """Moments and exact quantiles of a vector column per group and dimension, where groups may be many.

    A sketch of a small group is wider than its values. Frames are shuffled once, before they are cut into dimensions, and a
    group's values sorted; groups of more than a block take the two passes of ``full_stats``.
    """
    long = lambda f: V.explode_vector(f, column, keys)
    by = [*keys, "dim"]
    return ordering.per_group(
        frames.select(*keys, column), keys, lambda f: sorted_stats(long(f), by, probs, names),
        large_by=lambda f: full_stats(long(f), by, probs, names),
    )


def full_stats(
    long: DataFrame,
    keys: Sequence[str],
    probs: Sequence[float] = Q01_Q99,
    names: Sequence[str] = ("q01", "q99"),
    value: str = "value",
    few_groups: bool = False,
    accuracy: int = 100_000,
) -> DataFrame:
    """Moments plus exact linearly interpolated quantiles in two passes.

    Pass 1 takes the moments and a sketch whose rank error is at most
    n / accuracy, so the value at rank p*(n-1) lies between the sketch's
    p-2e and p+2e.  Pass 2 groups by (keys, segment, value-in-bracket): values
    outside every bracket collapse to a count, equal values to one row, which
    leaves about 4 n / accuracy rows per quantile.  They are ranked per cell, of
    which a bracket has ``CELLS``, and a cell's start is added from one row per
    cell.  The sketch ranks by p*n and interpolation by p*(n-1), so a wanted rank may sit one place
    outside its bracket: the minimum and maximum of each outside run serve it.

    What a sketch gives depends on the order in which its parts arrive, so pass 1 is written once and every reader sees
    the same brackets; the counts of pass 2, of which two readers need different columns, are written as well.  Both hold
    a few rows a group.  Building a query therefore runs the two passes.  Null and NaN values do not count; a null key is a
    group, and a group without a value has count 0 and nulls.

    ``few_groups`` says that the number of key combinations is bounded by the
    schema (dimensions, registered embodiments); only then is the pass-1 result
    broadcast, otherwise the join is salted and Catalyst and AQE choose its form.
    """
    keys, probs = list(keys), sorted(probs)
    e = 2.0 / accuracy
    edges = [x for p in probs for x in (max(p - e, 0.0), min(p + e, 1.0))]
    rows = long.select(*keys, F.when(~F.isnan(value), F.col(value).cast("double")).alias("_v"))
    first = stored(rows.groupBy(*keys).agg(*moments("_v"), F.percentile_approx("_v", edges, accuracy).alias("_br")), "brackets")
    # a null key is a key like any other
    named = [f"_k{i}" for i in range(len(keys))]
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named)]
    brackets = first.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], "_br")
    rows = rows.where("_v is not null")
    lows = [F.get("_br", 2 * i) for i in range(len(probs))]
    highs = [F.get("_br", 2 * i + 1) for i in range(len(probs))]
    v = F.col("_v")
    inside = F.lit(False)
    seg = F.lit(0)
    for lo, hi in zip(lows, highs):
        inside = inside | v.between(lo, hi)
        seg = seg + (v > hi).cast("int")
    # never falls as v rises within a segment; what no bracket holds comes first
    lo, hi = F.get(F.array(*lows), F.col("_seg")), F.get(F.array(*highs), F.col("_seg"))
    part = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * CELLS)).otherwise(0)
    cell = F.when(F.col("_in"), F.least(F.greatest(F.coalesce(part, F.lit(0)), F.lit(0)), F.lit(CELLS - 1))).otherwise(-1).cast("int")
    if few_groups:
        tagged = rows.join(F.broadcast(brackets), same)
    else:
        # a key holding much of the table is spread over SALTS join partitions; equal values stay together
        salted = brackets.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        tagged = rows.withColumn("_salt", F.pmod(F.hash("_v"), F.lit(SALTS))).join(salted, [*same, F.col("_salt") == F.col("_of")])
    counted = (
        tagged.select(*keys, "_br", seg.alias("_seg"), inside.alias("_in"), "_v")
        .select(*keys, "_seg", cell.alias("_cell"), F.when(F.col("_in"), v).alias("_w"), "_v")
        .groupBy(*keys, "_seg", "_cell", "_w")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    counted = stored(counted, "counts")
    before = Window.partitionBy(*keys).orderBy("_seg", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy(*keys, "_seg", "_cell").agg(F.sum("_c").alias("_s"))
    starts = sums.select(*keys, "_seg", "_cell", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    at = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in (*keys, "_seg", "_cell")]
    placed = counted.alias("_l").join(starts.alias("_r"), at).select("_l.*", "_start")
    order = Window.partitionBy(*keys, "_seg", "_cell").orderBy(F.col("_w").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("_upto", F.col("_start") + F.sum("_c").over(order))
    ranked = ranked.withColumn("_from", F.col("_upto") - F.col("_c"))
    whole = first.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], *MOMENTS)
    ranked = ranked.join(F.broadcast(whole) if few_groups else whole, same)
    picks = []
    for i, p in enumerate(probs):
        h = (F.col("count") - 1) * F.lit(float(p))
        for tag, r in (("a", F.floor(h)), ("b", F.ceil(h))):
            at = (
                F.when(F.col("_w").isNotNull(), F.col("_w"))
                .when(r == F.col("_from"), F.col("_lo"))
                .when(r == F.col("_upto") - 1, F.col("_hi"))
                .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
            )
            picks.append(F.max(F.when((F.col("_from") <= r) & (r < F.col("_upto")), at)).alias(f"_{tag}{i}"))
    got = ranked.groupBy(*keys).agg(*[F.max(m).alias(m) for m in MOMENTS], *picks)
    out = []
    for i, (p, n) in enumerate(zip(probs, names)):
        h = (F.col("count") - 1) * F.lit(float(p))
        out.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (h - F.floor(h))).alias(n))
    # a group without a value keeps its row
    empty = first.where("count = 0").select(*keys, *MOMENTS, *[F.lit(None).cast("double").alias(n) for n in names])
    return got.select(*keys, *MOMENTS, *out).unionByName(empty)


def partial_moments(long: DataFrame, keys: Sequence[str], value: str = "value", valid: Column | None = None) -> DataFrame:
    """Mergeable rows (count, sum, sumsq, min, max); invalid elements do not count."""
    v = F.col(value) if valid is None else F.when(valid, F.col(value))
    return long.groupBy(*keys).agg(
        F.count(v).alias("count"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
        F.coalesce(F.sum(v * v), F.lit(0.0)).alias("sumsq"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def merge_partials(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combine partial rows; a dimension nobody filled has zeros everywhere."""
    t = parts.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.sum("sum").alias("_s"), F.sum("sumsq").alias("_q"),
        F.coalesce(F.min("min"), F.lit(0.0)).alias("min"), F.coalesce(F.max("max"), F.lit(0.0)).alias("max"),
    )
    n = F.greatest(F.col("count"), F.lit(1))
    mean = F.col("_s") / n
    return t.select(
        *keys, "count", mean.alias("mean"),
        F.sqrt(F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0))).alias("std"), "min", "max",
    )


def pool_episode_stats(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pool per-episode rows (count, mean, std, min, max, q01, q99) into one per key.

    The pooled variance is E[var] + E[mean^2] - M^2, which needs one aggregate.
    """
    c = F.col("count")
    t = stats.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.sum(c * F.col("mean")).alias("_m"),
        F.sum(c * F.col("std") * F.col("std")).alias("_within"),
        F.sum(c * F.col("mean") * F.col("mean")).alias("_m2"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.min("q01").alias("q01"), F.max("q99").alias("q99"),
    )
    m = F.col("_m") / F.col("count")
    var = F.col("_within") / F.col("count") + F.greatest(F.col("_m2") / F.col("count") - m * m, F.lit(0.0))
    return t.select(*keys, "count", m.alias("mean"), F.sqrt(var).alias("std"), "min", "max", "q01", "q99")


def mix_stats(
    stats: DataFrame, weight: str, keys: Sequence[str], percentiles: str = "weighted_average"
) -> DataFrame:
    """Dataset-weighted statistics; add ``horizon`` to ``keys`` for the 2-D form."""
    if percentiles not in ("weighted_average", "min_max"):
        raise ValueError(f"unknown percentile mixing {percentiles!r}")
    w = F.col(weight)
    total = F.sum(w)
    t = stats.groupBy(*keys).agg(
        (F.sum(w * F.col("mean")) / total).alias("mean"),
        (F.sum(w * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))) / total).alias("_sq"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        *(
            [(F.sum(w * F.col(q)) / total).alias(q) for q in ("q01", "q99")]
            if percentiles == "weighted_average"
            else [F.min("q01").alias("q01"), F.max("q99").alias("q99")]
        ),
    )
    std = F.sqrt(F.greatest(F.col("_sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return t.select(*keys, "mean", std.alias("std"), "min", "max", "q01", "q99")


def histogram_quantiles(
    long: DataFrame, keys: Sequence[str], probs: Sequence[float] = Q01_Q99, names: Sequence[str] = ("q01", "q99"),
    bins: int = 5000, value: str = "value",
) -> DataFrame:
    """Quantile = left edge of the first bin whose cumulative count reaches p*n.

    Range first, then counts per bin: at most ``bins`` rows per key reach the
    cumulative window however many rows there are.
    """
    keys = list(keys)
    rows = long.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    span = rows.groupBy(*keys).agg(
        (F.min("_v") - 1e-10).alias("_lo"), (F.max("_v") + 1e-10).alias("_hi"), F.count("_v").alias("count")
    )
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    bin_id = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)).cast("long")
    hist = (
        rows.join(span, keys)
        .groupBy(*keys, bin_id.alias("bin"))
        .agg(F.count(F.lit(1)).alias("_c"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("count").alias("count"))
    )
    cum = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_upto", F.sum("_c").over(cum))
    edge = F.col("_lo") + F.col("bin") * width
    return hist.groupBy(*keys).agg(
        F.max("count").alias("count"),
        *[F.min(F.when(F.col("_upto") >= F.lit(float(p)) * F.col("count"), edge)).alias(n) for p, n in zip(probs, names)],
    )


def stats_vectors(stats: DataFrame, keys: Sequence[str], dim: str = "dim", columns: Sequence[str] = ("mean", "std", "min", "max", "q01", "q99")) -> DataFrame:
    """Re-nest the long statistics to one array per column; rows per key = vector width."""
    cells = F.sort_array(F.collect_list(F.struct(dim, *columns)))
    t = stats.groupBy(*keys).agg(cells.alias("_s")) if keys else stats.agg(cells.alias("_s"))
    return t.select(*keys, *[F.col("_s")[c].alias(c) for c in columns])
