"""Nearest, forward, interval and cumulative joins without per-group tasks or all-pairs output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.functions import vectors as V
from gaitworks.operators import ordering


def nearest_asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, right_order: str,
    payload: Sequence[str], tolerance: float, index: str = "frame_index",
) -> DataFrame:
    """Nearest right row within ``tolerance``, otherwise the last match is carried forward.

    Before the first match: null when the right stream starts after the left
    one, else its first row.  Time is cut into cells of twice the tolerance; a
    right row is copied into the two (on an edge three) cells it can reach, so the join is
    an equi-join whose cells hold only what arrives in that span.
    """
    keys = list(keys)
    cell = 2.0 * tolerance
    t, u = F.col(left_time), F.col(right_time)
    body = F.struct(*payload).alias("_p")
    spans = F.sequence(F.floor((u - tolerance) / cell), F.floor((u + tolerance) / cell))
    r = right.select(*keys, u.alias("_u"), F.col(right_order).alias("_o"), body, F.explode(spans).alias("_cell"))
    probe = left.select(*keys, index, t.alias("_t"), F.floor(t / cell).alias("_cell"))
    near = (
        probe.join(r, [*keys, "_cell"]).where(F.abs(F.col("_u") - F.col("_t")) <= tolerance)
        .groupBy(*keys, index)
        .agg(F.min(F.struct(F.abs(F.col("_u") - F.col("_t")).alias("dt"), "_o", "_p")).alias("_m"))
        .select(*keys, index, F.col("_m._p").alias("_p"))
    )
    matched = left.join(near, [*keys, index], "left")
    carried = ordering.fill(matched, F.col("_p"), keys, index, forward="_c")
    first_right = right.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), F.struct(right_time, right_order)).alias("_f"), F.min(right_time).alias("_fu")
    )
    first_left = left.groupBy(*keys).agg(F.min(left_time).alias("_ft"), (F.max(index) + 1).alias("_len"))
    start = first_left.join(first_right, keys, "left").select(
        *keys, "_len", F.when(F.col("_fu") <= F.col("_ft"), F.col("_f")).alias("_d")
    )
    done = ordering.per_episode(carried, start, keys, index, "_len")
    return done.withColumn("_m", F.coalesce("_c", "_d")).select(
        *left.columns, F.col("_p").isNotNull().alias("fresh"), *[F.col(f"_m.{c}").alias(c) for c in payload]
    )


def forward_asof(
    frames: DataFrame, marks: DataFrame, keys: Sequence[str], index: str, mark_index: str, value: str, fallback: Column
) -> DataFrame:
    """The mark with the smallest index >= frame index; after the last mark ``fallback``.

    Both sides go into one ordered stream; at equal index frames sort first.
    """
    keys = list(keys)
    f = frames.withColumns({"_kind": F.lit(0), "_mark": F.lit(None).cast(dict(marks.dtypes)[value])})
    m = marks.select(*keys, F.col(mark_index).cast(dict(frames.dtypes)[index]).alias(index), F.lit(1).alias("_kind"), F.col(value).alias("_mark"))
    both = f.unionByName(m, allowMissingColumns=True)
    # 2*index + kind keeps frames before marks and gives the blocks a single order column
    both = both.withColumn("_pos", F.col(index) * 2 + F.col("_kind"))
    filled = ordering.fill(both, F.col("_mark"), keys, "_pos", backward="_next")
    return filled.where("_kind = 0").withColumn(value, F.coalesce("_next", fallback)).drop("_kind", "_mark", "_pos", "_next")


def span_width(spans: DataFrame, length: Column) -> Column:
    """Cell width for tiling spans: sixteen mean lengths, so a point meets about sixteen spans."""
    return spans.agg(F.greatest(F.lit(16), F.ceil(F.avg(length) * 16)).cast("bigint")).scalar()


def interval_join(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, low: str, high: str, width: int | Column, how: str = "inner"
) -> DataFrame:
    """Equi-join on (keys, point div width) plus ``low <= point < high``.

    A span is copied once per cell it overlaps.  Cells spread a hot key over
    many tasks.  ``how``: inner, left, left_semi, left_anti.
    """
    keys = list(keys)
    cells = F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))
    s = spans.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(cells))
    p = points.withColumn("_cell", F.floor(F.col(point) / width))
    names = [k for k in keys] + ["_cell"]
    cond = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in names]
    cond.append(F.col(f"p.{point}") >= F.col(f"s.{low}"))
    cond.append(F.col(f"p.{point}") < F.col(f"s.{high}"))
    joined = p.alias("p").join(s.alias("s"), cond, how)
    kept = [F.col(f"p.{c}") for c in points.columns]
    if how in ("inner", "left"):
        kept += [F.col(f"s.{c}") for c in spans.columns if c not in keys and c not in points.columns]
    return joined.select(*kept)


TOP = 16  # log2 of the widest stretch that a span is cut into


def _stretches(low: Column, high: Column) -> Column:
    """The aligned stretches (level, node) that make up ``low <= x < high``; node n of level l is n * 2^l .. (n+1) * 2^l - 1.

    At most two a level below ``TOP``, and there one for each whole stretch.
    """
    one = F.lit(1).cast("bigint")
    shift = lambda x, level: F.call_function("shiftright", x, level)

    def at(level: Column) -> Column:
        ends = F.struct((-shift(-low, level)).alias("lo"), shift(high, level).alias("hi"))

        def inside(e: Column) -> Column:
            odd = F.array(F.when(e["lo"].bitwiseAND(one) == 1, e["lo"]), F.when(e["hi"].bitwiseAND(one) == 1, e["hi"] - 1))
            nodes = F.when(level == TOP, F.sequence(e["lo"], e["hi"] - 1)).otherwise(F.array_distinct(F.array_compact(odd)))
            return F.when(e["lo"] < e["hi"], F.transform(nodes, lambda n: F.struct(level.alias("_level"), n.alias("_node"))))

        return V.let(ends, inside)

    return F.flatten(F.array_compact(F.transform(_levels(high - low), at)))


def _levels(length: Column) -> Column:
    """Levels that a span of so many points can use."""
    return F.sequence(F.lit(0), F.least(F.lit(TOP), F.floor(F.log2(length)).cast("int")))


def first_span(frames: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, start: str, end: str, order: str, text: str) -> DataFrame:
    """Text of the first span (by ``order``, then text) with start <= point <= end, else the empty string.

    ``point``, ``start`` and ``end`` are integers. What is open changes at starts and ends only: the first open span is
    found for those marks and carried forward to the frames, so a frame is one row under however many spans. A span is
    stored at the few aligned stretches that make it up, reduced to the first span of each; a mark asks the one stretch
    that holds it at each level in use. No row per (frame, span) or (mark, span) arises, and a stretch holds at most
    2^16 marks. A null point, key or bound meets nothing; an empty span neither; repeated frames stay.
    """
    keys = list(keys)
    s = spans.select(*keys, F.col(start).cast("bigint").alias("_lo"), (F.col(end).cast("bigint") + 1).alias("_hi"), F.struct(order, text).alias("_s"))
    s = s.where(F.col("_lo") < F.col("_hi"))
    nodes = s.select(*keys, "_s", F.inline(_stretches(F.col("_lo"), F.col("_hi")))).groupBy(*keys, "_level", "_node").agg(F.min("_s").alias("_s"))
    levels = s.agg(_levels(F.max(F.col("_hi") - F.col("_lo")))).scalar()  # at most TOP + 1 numbers; null without spans
    marks = s.select(*keys, F.explode(F.array("_lo", "_hi")).alias("_at")).distinct()
    asked = marks.withColumn("_level", F.explode(levels)).withColumn("_node", F.expr("shiftright(_at, _level)"))
    open_ = (
        asked.join(nodes, [*keys, "_level", "_node"], "left")
        .groupBy(*keys, F.col("_at")).agg(F.struct(F.min("_s").alias("s")).alias("_open"))
        .select(*keys, (F.col("_at") * 2).alias("_pos"), "_open")
    )
    placed = frames.withColumns({"_pos": F.col(point).cast("bigint") * 2 + 1, "_frame": F.lit(True)})
    both = ordering.fill(placed.unionByName(open_, allowMissingColumns=True), F.col("_open"), keys, "_pos", forward="_held")
    found = F.coalesce(F.when(F.col("_pos").isNotNull(), F.col("_held.s")[text]), F.lit(""))
    return both.where("_frame").withColumn(text, found).drop("_pos", "_frame", "_open", "_held")


def keep_ranges(frames: DataFrame, ranges: DataFrame, keys: Sequence[str], point: str, low: str, high: str, width: int = 4096) -> DataFrame:
    """Frames in any half-open range of their episode; an episode without ranges keeps all frames."""
    keys = list(keys)
    listed = ranges.select(*keys).distinct().withColumn("_listed", F.lit(True))
    inside = interval_join(frames, ranges, keys, point, low, high, width, "left_semi")
    free = frames.join(listed, keys, "left_anti")
    return inside.unionByName(free)


def must_resolve(df: DataFrame, dim: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Dictionary join; a key without an entry raises when its row is read."""
    on = list(on)
    got = df.join(dim.withColumn("_hit", F.lit(True)), on, "left")
    miss = F.raise_error(F.concat(F.lit("no dictionary entry for "), F.to_json(F.struct(*on))))
    kind = dict(dim.dtypes)[value]
    return got.withColumn(value, F.when(F.col("_hit"), F.col(value)).otherwise(miss.cast(kind))).drop("_hit")


def gap_report(catalogue: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    a, b = catalogue.select(key).distinct(), local.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("catalogue_only")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("local_only"))
    )
