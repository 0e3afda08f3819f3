"""Ordered per-group work that never puts a whole group into one task.

A plain ``Window.partitionBy(episode)`` sends every frame of an episode to one
task, so one episode holding a third of the table stalls the job.  Everything
ordered in this package goes through the helpers below instead:

* ``row_index`` / ``global_index``  dense 0-based positions inside groups, or
                    over the whole table: rows are range-partitioned by their
                    order columns and written, then numbered inside their
                    partition, and one row a partition gives the offsets;
* ``with_blocks``   once a dense position exists, cuts a group into blocks of
                    ``BLOCK`` rows and copies only the halo rows that a
                    lag / lead / chunk window needs across a block edge;
* ``running_sum`` / ``fill``  block-local window plus a carry computed
                    on one row per block;
* ``per_episode``   joins one-row-per-episode attributes on (episode, block),
                    which spreads a hot episode over as many tasks as it has
                    blocks and reuses the partitioning of the block windows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.session import stored

BLOCK = 1 << 16        # rows of one block of an indexed episode


def _prefix(blocks: DataFrame, keys: Sequence[str], position: str, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "frame_index") -> DataFrame:
    """Dense 0-based position inside each group of ``keys``; ``order`` must be a total order in a group.

    Rows are range-partitioned by ``keys`` and ``order`` together, so that a group of any size, whatever its values share,
    is cut where the partition is full, and are written once with their partition. A window numbers a group's rows of a
    partition. At most one group goes on from a partition to the next, so the rows of groups in earlier partitions are
    at most one row a partition, which is broadcast. The input is read once beside the sample for the ranges.
    """
    keys = list(keys)
    ranged = stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    pieces = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = _prefix(pieces, keys, "_part", "_c", "_off").where("_off > 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of_part"), "_off")
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)).cast("long") - 1)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_of_part"))
    return (
        local.join(F.broadcast(before), same, "left")
        .withColumn(name, F.col("_local") + F.coalesce("_off", F.lit(0)))
        .drop("_local", "_off", "_part", "_of_part", *[f"_k{i}" for i in range(len(keys))])
    )


def global_index(df: DataFrame, order: Sequence[Column | str], name: str, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Dense 0-based position over the whole table; ``order`` must be total. No task sees more than its range.

    Rows are range-partitioned by ``order``, sorted and written once with their place in the partition; one row a
    partition, broadcast, gives the offset. ``sums`` adds running totals of values over all earlier rows the same way.
    """
    sums = dict(sums or {})
    values = {f"_v{i}": v for i, v in enumerate(sums.values())}
    placed = df.withColumns(values) if values else df
    ranged = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(v).alias(v) for v in values])
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_off")
    offsets = parts.select(F.col("_part").alias("_of_part"), before("_c"), *[before(v) for v in values])
    got = ranged.join(F.broadcast(offsets), F.col("_part") == F.col("_of_part"))
    got = got.withColumn(name, F.col("_c_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    for v, total in zip(values, sums):
        got = got.withColumn(total, F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"{v}_off"))
    return got.drop("_at", "_part", "_of_part", "_c_off", *values, *[f"{v}_off" for v in values])


def with_blocks(
    df: DataFrame, index: str = "frame_index", before: int = 0, after: int = 0, block: int | None = None
) -> DataFrame:
    """Add ``_blk`` and ``_home``; rows needed by a neighbour block are copied.

    ``before`` / ``after`` is how far a window reaches back / ahead of a row.
    Use ``Window.partitionBy(*keys, "_blk")`` and then ``home_rows``.
    """
    block = block or BLOCK
    if max(before, after) > block:
        raise ValueError("window reaches further than one block; raise block")
    i = F.col(index)
    own = F.floor(i / F.lit(block)).cast("long")
    if before == 0 and after == 0:
        return df.withColumn("_blk", own).withColumn("_home", F.lit(True))
    copies = [own]
    if before:
        copies.append(F.when(i % block >= block - before, own + 1))
    if after:
        copies.append(F.when((i % block < after) & (own > 0), own - 1))
    return df.withColumn("_blk", F.explode(F.array_compact(F.array(*copies)))).withColumn("_home", F.col("_blk") == own)


def home_rows(df: DataFrame) -> DataFrame:
    return df.where("_home").drop("_home", "_blk")


def block_window(keys: Sequence[str], index: str = "frame_index"):
    return Window.partitionBy(*keys, "_blk").orderBy(index)


def over_frames(
    df: DataFrame,
    columns: dict[str, "callable"],
    keys: Sequence[str] = ("episode_index",),
    index: str = "frame_index",
    before: int = 0,
    after: int = 0,
    block: int | None = None,
) -> DataFrame:
    """Add ordered-window columns; each value is a function of the window spec."""
    blocks = with_blocks(df, index, before, after, block)
    w = block_window(keys, index)
    return home_rows(blocks.withColumns({name: make(w) for name, make in columns.items()}))


def episode_lengths(
    df: DataFrame, keys: Sequence[str] = ("episode_index",), index: str = "frame_index", name: str = "length"
) -> DataFrame:
    return df.groupBy(*keys).agg((F.max(index) + 1).alias(name))


def per_episode(
    frames: DataFrame,
    episodes: DataFrame,
    keys: Sequence[str] = ("episode_index",),
    index: str = "frame_index",
    length: str = "length",
    how: str = "inner",
    block: int | None = None,
    on: Column | None = None,
) -> DataFrame:
    """Join one row per episode onto frames on (episode, block); with ``on``, one row per episode and whatever it compares."""
    block = block or BLOCK
    last = F.greatest(F.floor((F.col(length) - 1) / F.lit(block)), F.lit(0)).cast("long")
    spread = episodes.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    cut = frames.withColumn("_blk", F.floor(F.col(index) / F.lit(block)).cast("long"))
    if on is None:
        return cut.join(spread, [*keys, "_blk"], how).drop("_blk")
    spread = spread.withColumnsRenamed({k: f"_of_{k}" for k in (*keys, "_blk")})
    same = reduce(lambda a, k: a & (F.col(k) == F.col(f"_of_{k}")), (*keys, "_blk"), on)
    return cut.join(spread, same, how).drop("_blk", *[f"_of_{k}" for k in (*keys, "_blk")])


def with_length(
    frames: DataFrame, keys: Sequence[str] = ("episode_index",), index: str = "frame_index", name: str = "length",
    block: int | None = None,
) -> DataFrame:
    return per_episode(frames, episode_lengths(frames, keys, index, name), keys, index, name, block=block)


def running_sum(
    df: DataFrame, value: Column, name: str, keys: Sequence[str] = ("episode_index",), index: str = "frame_index",
    inclusive: bool = True, block: int | None = None,
) -> DataFrame:
    """Cumulative sum along ``index``: block-local sum plus the sum of earlier blocks."""
    keys = list(keys)
    cut = with_blocks(df, index, block=block).drop("_home").withColumn("_v", value)
    end = Window.currentRow if inclusive else -1
    local = F.coalesce(F.sum("_v").over(block_window(keys, index).rowsBetween(Window.unboundedPreceding, end)), F.lit(0))
    sums = cut.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_s"))
    carry = _prefix(sums, keys, "_blk", "_s", "_carry").where("_blk > 0").select(*keys, "_blk", "_carry")
    return (
        cut.withColumn("_l", local).join(carry, [*keys, "_blk"], "left")
        .withColumn(name, F.col("_l") + F.coalesce("_carry", F.lit(0)))
        .drop("_v", "_l", "_carry", "_blk")
    )


def fill(
    df: DataFrame, value: Column, keys: Sequence[str] = ("episode_index",), index: str = "frame_index",
    forward: str | None = None, backward: str | None = None, block: int | None = None,
) -> DataFrame:
    """Last non-null value at or before each row (``forward``), next one at or after it (``backward``).

    Inside a block by a window; across blocks by one row per block.
    """
    keys = list(keys)
    cut = with_blocks(df, index, block=block).drop("_home").withColumn("_v", value)
    w = block_window(keys, index)
    present = F.when(F.col("_v").isNotNull(), F.col(index))
    edges = cut.groupBy(*keys, "_blk").agg(F.max_by("_v", present).alias("_end"), F.min_by("_v", present).alias("_start"))
    wb = Window.partitionBy(*keys).orderBy("_blk")
    carry = edges.select(
        *keys, "_blk",
        F.last("_end", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_start", ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    ).where("_before is not null or _after is not null")
    local = {}
    if forward:
        local["_f"] = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if backward:
        local["_g"] = F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    got = cut.withColumns(local).join(carry, [*keys, "_blk"], "left")
    if forward:
        got = got.withColumn(forward, F.coalesce("_f", "_before"))
    if backward:
        got = got.withColumn(backward, F.coalesce("_g", "_after"))
    return got.drop("_v", "_f", "_g", "_before", "_after", "_blk")


def per_group(
    rows: DataFrame, keys: Sequence[str], aggregate: Callable[[DataFrame], DataFrame], most: int | None = None,
    large_by: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``aggregate(rows)``, grouped by ``keys`` and whatever else, with rows shuffled as they are.

    Where groups are small, partial aggregates are wider than the rows they stand for and save nothing. Groups of more than
    ``most`` rows (a block) stay with partial aggregates, so that no task holds one; their keys, at most one per ``most``
    rows of the table, are broadcast. ``large_by`` is another way for those groups; as it may read the rows more than once,
    their keys are then written.
    """
    most = most or BLOCK
    named = [f"_k{i}" for i in range(len(keys))]
    large = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, named)]).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > most).drop("_c")
    if large_by:
        large = stored(large, "large")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named)])
    small = rows.join(F.broadcast(large), same, "left_anti").repartition(*keys)
    return aggregate(small).unionByName((large_by or aggregate)(rows.join(F.broadcast(large), same, "left_semi")))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, name: str = "_rn") -> DataFrame:
    """The first ``k`` rows of each group.

    With a number, Spark limits each group below the exchange, so that a task gets k rows of a group from each map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
