"""Windows cut around frames: chunks, histories, deltas, goals, resampling.

Every function takes frames with a dense ``frame_index`` and adds array columns
by one block window (see ``ordering``): no join, one exchange, bounded tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.functions import hashing
from gaitworks.functions import vectors as V
from gaitworks.operators.ordering import over_frames
from gaitworks.session import stored

EP = ("episode_index",)


def neighbourhood(df: DataFrame, columns: dict[str, str], before: int, after: int, keys: Sequence[str] = EP) -> DataFrame:
    """Collect each column over rows -before..after; ``_at`` is the row's own position in the list."""
    made = {
        out: (lambda w, c=c: F.collect_list(c).over(w.rowsBetween(-before, after))) for out, c in columns.items()
    }
    got = over_frames(df, made, keys, before=before, after=after)
    return got.withColumn("_at", F.least(F.col("frame_index"), F.lit(before)).cast("int"))


def delta_window(
    df: DataFrame, column: str, deltas: Sequence[int], name: str = "window", keys: Sequence[str] = EP, pad: str = "clamp"
) -> DataFrame:
    """Rows at t+delta for every delta plus ``is_pad``.

    ``pad``: ``clamp`` repeats the edge frame (same as first/last padding),
    ``zero`` gives a zero vector.  Padding is decided on the raw index.
    """
    before, after = max(0, -min(deltas)), max(0, max(deltas))
    got = neighbourhood(df, {"_list": column}, before, after, keys)
    at, n = F.col("_at"), F.col("_n")
    got = got.withColumn("_n", F.size("_list"))
    empty = V.zeros(F.size(F.get("_list", 0)))
    values, pads = [], []
    for d in deltas:
        raw = at + int(d)
        out = (raw < 0) | (raw >= n)
        value = F.get("_list", F.least(F.greatest(raw, F.lit(0)), n - 1))
        values.append(value if pad == "clamp" else F.when(out, empty).otherwise(value))
        pads.append(out)
    return got.withColumns({name: F.array(*values), "is_pad": F.array(*pads)}).drop("_list", "_at", "_n")


def action_chunk(
    df: DataFrame, column: str, horizon: int, name: str = "chunk", keys: Sequence[str] = EP, pad: bool = True
) -> DataFrame:
    """The next ``horizon`` rows; the tail repeats the last, or is dropped when ``pad`` is off. Null vectors are passed over.

    Read by leads, which take a row from the window's buffer; a sliding list would be gathered anew for each row.
    """
    leads = {f"_a{i}": (lambda w, i=i: F.lead(column, i).over(w)) for i in range(1, horizon)}
    got = over_frames(df, leads, keys, after=horizon - 1)
    rows = [F.col(column), *[F.col(a) for a in leads]]
    listed = F.array(*rows)
    if not pad:
        return got.where(reduce(lambda a, r: a & r.isNotNull(), rows, F.lit(True))).withColumn(name, listed).drop(*leads)
    # past the end every lead is null; a null before another row is a null vector
    gap = reduce(lambda g, pair: g | (pair[0].isNull() & pair[1].isNotNull()), zip(rows, rows[1:]), rows[0].isNull())
    last = F.coalesce(*reversed(rows))
    kept = F.array_compact(listed)
    repeated = F.concat(kept, F.array_repeat(F.element_at(kept, -1), F.lit(horizon) - F.size(kept)))
    return got.withColumn(name, F.when(gap, repeated).otherwise(F.array(rows[0], *[F.coalesce(r, last) for r in rows[1:]]))).drop(*leads)


def observation_history(df: DataFrame, column: str, k: int, stride: int = 1, name: str = "history", keys=EP) -> DataFrame:
    """Every ``stride``-th of the last k*stride rows, oldest first, left-padded with the oldest."""
    span = k * stride - 1
    got = over_frames(
        df, {"_l": lambda w: F.collect_list(column).over(w.rowsBetween(-span, 0))}, keys, before=span
    )
    kept = F.filter("_l", lambda _, i: i % stride == 0)
    return got.withColumn(
        name, F.concat(F.array_repeat(F.get(kept, 0), F.lit(k) - F.size(kept)), kept)
    ).drop("_l")


def strided_chunk(df: DataFrame, column: str, steps: int, stride: int, name: str = "chunk", keys=EP) -> DataFrame:
    """Rows t, t+s, ... capped at the end, with ``mask`` = 1 for in-range steps."""
    got = delta_window(df, column, [i * stride for i in range(steps)], name, keys)
    return got.withColumn("mask", F.transform("is_pad", lambda p: F.when(p, 0).otherwise(1))).drop("is_pad")


def subsample(chunk: Column, stride: int) -> Column:
    return F.filter(chunk, lambda _, i: i % stride == 0)


def delta_chunk(chunk: Column, reference: Column | None = None) -> Column:
    """Consecutive differences; the first is against ``reference`` or zero."""
    first = F.get(chunk, 0) if reference is None else reference
    previous = F.concat(F.array(first), F.slice(chunk, 1, F.size(chunk) - 1))
    return F.zip_with(chunk, previous, V.subtract)


def relative_chunk(chunk: Column, anchor: Column, mask: Sequence[bool] | None = None) -> Column:
    """chunk - anchor on the masked dimensions."""
    return _shift_chunk(chunk, anchor, mask, -1.0)


def absolute_chunk(chunk: Column, anchor: Column, mask: Sequence[bool] | None = None) -> Column:
    return _shift_chunk(chunk, anchor, mask, 1.0)


def _shift_chunk(chunk: Column, anchor: Column, mask, sign: float) -> Column:
    used = anchor if mask is None else V.multiply(anchor, V.literal([1.0 if m else 0.0 for m in mask]))
    return F.transform(chunk, lambda a: F.zip_with(a, used, lambda x, y: x + F.lit(sign) * y))


def relative_pairs(df: DataFrame, action: str, state: str, horizon: int, keys: Sequence[str] = EP) -> DataFrame:
    """(horizon, action[t+d] - state[t]) for d < horizon, over base steps with a full horizon."""
    full = action_chunk(df, action, horizon, "_w", keys, pad=False)
    pairs = full.select(*keys, "frame_index", F.col(state).alias("_s"), F.posexplode("_w").alias("horizon", "_a"))
    return pairs.select(*keys, "frame_index", "horizon", V.subtract(F.col("_a"), F.col("_s")).alias("relative"))


def relative_long(df: DataFrame, action: str, state: str, horizon: int, keys: Sequence[str] = EP) -> DataFrame:
    """The same, one row per dimension: (horizon, dim, value); explodes instead of lambdas keep it in generated code.

    The windows are written once, since exact quantiles read the rows twice.
    """
    full = action_chunk(df.select(*keys, "frame_index", action, state), action, horizon, "_w", keys, pad=False)
    full = stored(full.select(F.col(state).alias("_s"), "_w"), "chunks")
    pairs = full.select("_s", F.posexplode("_w").alias("horizon", "_a"))
    cells = pairs.select("horizon", F.posexplode(F.arrays_zip("_a", "_s")).alias("dim", "_c"))
    return cells.select("horizon", "dim", (F.col("_c._a") - F.col("_c._s")).alias("value"))


def previous_or(df: DataFrame, column: str, default: Column, name: str, keys: Sequence[str] = EP) -> DataFrame:
    """The previous frame's value, ``default`` on the first frame."""
    got = over_frames(df, {name: lambda w: F.lag(column, 1).over(w)}, keys, before=1)
    return got.withColumn(name, F.when(F.col("frame_index") == 0, default).otherwise(F.col(name)))


def done_flag(df: DataFrame, name: str = "done", keys: Sequence[str] = EP) -> DataFrame:
    return over_frames(df, {name: lambda w: F.lead("frame_index", 1).over(w).isNull()}, keys, after=1)


def future_goal(df: DataFrame, column: str, low: int, high: int, seed: str | None, name: str = "goal", keys=EP) -> DataFrame:
    """Goal row at t+d, d drawn by hash from what the episode leaves of [low, high); with no seed d is pinned to
    min(low, n-1-t) and at least one step where the episode has one."""
    got = neighbourhood(df, {"_l": column}, 0, max(high - 1, low, 1), keys)
    left = F.size("_l") - 1
    if seed is None:
        d = F.least(F.lit(low), F.greatest(left, F.lit(1)))
    else:
        first, end = F.least(F.lit(low), left), F.least(F.lit(high), left + 1)
        d = (first + F.floor(hashing.uniform(seed, *[F.col(k) for k in keys], F.col("frame_index")) * (end - first))).cast("int")
    step = F.least(d, left).cast("int")
    return got.withColumns({"goal_offset": step, name: F.get("_l", step)}).drop("_l", "_at")


def state_jitter(df: DataFrame, column: str, reach: int, seed: str, name: str = "jittered", keys=EP, training: bool = True, p: float = 1.0) -> DataFrame:
    """The row at t+k, k in [-reach, reach] by hash with probability ``p`` (else k = 0), clamped to the episode;
    identity outside training."""
    if not training:
        return df.withColumn(name, F.col(column))
    got = neighbourhood(df, {"_l": column}, reach, reach, keys)
    u = hashing.uniform(seed, *[F.col(k) for k in keys], F.col("frame_index"))
    moved = hashing.uniform(f"{seed}-p", *[F.col(k) for k in keys], F.col("frame_index")) < p
    k = F.when(moved, F.floor(u * (2 * reach + 1)) - reach).otherwise(0).cast("int")
    at = F.least(F.greatest(F.col("_at") + k, F.lit(0)), F.size("_l") - 1)
    return got.withColumns({"jitter": k, name: F.get("_l", at)}).drop("_l", "_at")


def chunked_sequence(df: DataFrame, column: str, blocks: int, steps: int, name: str = "blocks", keys=EP) -> DataFrame:
    """Up to ``blocks`` blocks of ``steps`` rows from each frame.

    Blocks stop once the episode is exhausted; inside the last block steps
    beyond the end repeat the last row.  ``n_blocks`` aligns other modalities.
    """
    total = blocks * steps
    got = over_frames(df, {"_l": lambda w: F.collect_list(column).over(w.rowsBetween(0, total - 1))}, keys, after=total - 1)
    have = F.size("_l")
    n = F.least(F.ceil(have / F.lit(float(steps))), F.lit(blocks)).cast("int")
    filled = F.concat("_l", F.array_repeat(F.element_at("_l", -1), n * steps - have))
    return got.withColumn("n_blocks", n).withColumn(name, F.slice(filled, 1, F.col("n_blocks") * steps)).drop("_l")


def pad_blocks(seq: Column, n_blocks: Column, blocks: int, steps: int) -> tuple[Column, Column]:
    """Zero-pad a block sequence to ``blocks`` blocks; also the block mask."""
    empty = V.zeros(F.size(F.get(seq, 0)))
    padded = F.concat(seq, F.array_repeat(empty, (F.lit(blocks) - n_blocks) * steps))
    mask = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: i < n_blocks)
    return padded, mask


def temporal_ensemble(chunks: DataFrame, chunk: str, coeff: float, keys: Sequence[str] = EP, made_at: str = "frame_index") -> DataFrame:
    """Exponentially weighted mean of every prediction for a tick, oldest first.

    Predictions for a tick come from at most H chunks, so each (episode, tick)
    group holds at most H rows.
    """
    steps = chunks.select(*keys, F.col(made_at).alias("made_at"), F.posexplode(chunk).alias("_i", "_v")).where(F.col("_v").isNotNull())
    # vectors are shuffled and ranked whole; their dimensions are summed where the tick's votes already are
    w = Window.partitionBy(*keys, "tick").orderBy("made_at")
    ranked = steps.select(*keys, (F.col("made_at") + F.col("_i")).alias("tick"), "made_at", "_v")
    ranked = ranked.withColumn("_w", F.exp(F.lit(-coeff) * (F.row_number().over(w) - 1)))
    weighted = ranked.select(*keys, "tick", "_w", F.posexplode("_v").alias("dim", "x"))
    return weighted.groupBy(*keys, "tick", "dim").agg(
        (F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("value"), F.count(F.lit(1)).alias("votes")
    )


def resample_linear(seq: Column, points: int) -> Column:
    """Linear resampling of an array of vectors to ``points`` rows spread evenly over its length."""

    def made(s):
        t = F.size(s)

        def at(i):
            pos = i * (t - 1) / F.lit(float(max(points - 1, 1)))
            lo = F.least(F.floor(pos), t - 1).cast("int")
            hi = F.least(lo + 1, t - 1)
            return F.zip_with(F.get(s, lo), F.get(s, hi), lambda a, b: a + (b - a) * (pos - lo))

        return F.when(t == points, s).otherwise(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))

    return V.let(seq, made)


def wrap_angle(x: Column) -> Column:
    """Into [-pi, pi)."""
    import math

    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def unwrap_column(df: DataFrame, column: str, name: str, keys: Sequence[str] = EP) -> DataFrame:
    """Remove jumps larger than pi along the episode (cumulative correction)."""
    import math

    from gaitworks.operators.ordering import running_sum

    step = over_frames(df, {"_d": lambda w: F.col(column) - F.lag(column, 1).over(w)}, keys, before=1)
    d = F.coalesce(F.col("_d"), F.lit(0.0))
    short = wrap_angle(d)
    short = F.when((short == -math.pi) & (d > 0), F.lit(math.pi)).otherwise(short)
    fix = F.when(F.abs(d) < math.pi, F.lit(0.0)).otherwise(short - d)
    return running_sum(step, fix, "_fix", keys).withColumn(name, F.col(column) + F.col("_fix")).drop("_d", "_fix")


def resample_angles(seq: Column, points: int) -> Column:
    """Unwrap a short array of angles, resample linearly, wrap back."""
    import math

    def unwrap(acc, x):
        last = F.element_at(acc, -1)
        d = x - last
        turns = F.when(F.abs(d) < math.pi, F.lit(0.0)).otherwise(F.floor((d + math.pi) / (2 * math.pi)))
        return F.concat(acc, F.array(x - turns * (2 * math.pi)))

    flat = F.aggregate(F.slice(seq, 2, F.size(seq)), F.slice(seq, 1, 1), unwrap)
    rows = F.transform(flat, lambda x: F.array(x))
    return F.transform(resample_linear(rows, points), lambda v: wrap_angle(F.get(v, 0)))
