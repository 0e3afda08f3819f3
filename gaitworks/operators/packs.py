"""Pack surgery: counts, audits, merges, splits, reindexing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.operators import ordering
from gaitworks.session import stored


def pack_counts(frames: DataFrame, pack: str, cameras: int = 1, chunk: int = 1000) -> DataFrame:
    """Episodes, frames, tasks, videos and chunks per pack.

    Distinct pairs first, so a pack holding most rows is reduced before it meets
    one task.
    """
    per = frames.groupBy(pack, "episode_index", "task_index").agg(F.count(F.lit(1)).alias("_n"))
    eps = per.groupBy(pack, "episode_index").agg(F.sum("_n").alias("_n"))
    a = eps.groupBy(pack).agg(F.count(F.lit(1)).alias("episodes"), F.sum("_n").alias("frames"))
    b = per.select(pack, "task_index").distinct().groupBy(pack).agg(F.count(F.lit(1)).alias("tasks"))
    return a.join(b, pack).select(
        pack, "episodes", "frames", "tasks", (F.col("episodes") * cameras).alias("videos"),
        F.ceil(F.col("episodes") / chunk).alias("chunks"),
    )


def task_report(frames: DataFrame, task: str) -> DataFrame:
    per = frames.groupBy(task, "episode_index").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(task).agg(F.count(F.lit(1)).alias("episodes"), F.sum("_n").alias("frames"))


def shape_audit(sources: DataFrame, shape: str) -> DataFrame:
    """Distinct declared shapes with the number of sources; the most frequent one is flagged."""
    counts = sources.groupBy(shape).agg(F.count(F.lit(1)).alias("sources"))
    top = counts.orderBy(F.col("sources").desc(), shape).limit(1).select(shape)
    return counts.withColumn("is_majority", F.col(shape) == top.scalar())


def merge_common_keys(keys: DataFrame, pack: str, key: str, config: str) -> DataFrame:
    """Sub-keys present in every pack; two packs declaring different configs is an error."""
    packs = keys.agg(F.count_distinct(pack).alias("n"))
    grouped = keys.groupBy(key).agg(
        F.count_distinct(pack).alias("n_packs"), F.min(config).alias(config), F.max(config).alias("_hi")
    )
    clash = F.raise_error(F.concat(F.lit("conflicting config for "), F.col(key))).cast(dict(keys.dtypes)[config])
    return grouped.where(F.col("n_packs") == packs.scalar()).select(
        key, "n_packs", F.when(F.col(config) == F.col("_hi"), F.col(config)).otherwise(clash).alias(config)
    )


def reindex(episodes: DataFrame, order: Sequence[str], name: str, packs_by: Sequence[str] = ()) -> DataFrame:
    """Dense new episode numbers in source order, per output pack or over the whole table."""
    if packs_by:
        return ordering.row_index(episodes, packs_by, list(order), name)
    return ordering.global_index(episodes, list(order), name)


def episode_offsets(episodes: DataFrame, order: Sequence[str], length: str = "length") -> DataFrame:
    """``offset`` = frames in all earlier episodes; works on the episode table only."""
    return ordering.global_index(episodes, list(order), "_ep", {"offset": F.col(length)}).drop("_ep")


def global_frame_index(frames: DataFrame, name: str = "index", length: str = "length") -> DataFrame:
    eps = ordering.episode_lengths(frames, name=length)
    offsets = episode_offsets(eps, ["episode_index"], length)
    got = ordering.per_episode(frames, offsets, length=length)
    return got.withColumn(name, F.col("offset") + F.col("frame_index")).drop("offset", length)


def locate(points: DataFrame, offsets: DataFrame, point: str, keys: Sequence[str] = ()) -> DataFrame:
    """Global index -> (episode, local frame) by an interval join on cumulative bounds."""
    from gaitworks.operators.joins import interval_join, span_width

    spans = offsets.withColumn("_end", F.col("offset") + F.col("length"))
    got = interval_join(points, spans, keys, point, "offset", "_end", span_width(offsets, F.col("length")))
    return got.withColumn("frame_index", F.col(point) - F.col("offset")).drop("_end")


def _checked(picked: DataFrame, episodes: DataFrame, group: str, k: int) -> DataFrame:
    """``picked``, or an error for a group of at most ``k`` episodes or for episodes without a group."""
    sizes = episodes.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    name = F.coalesce(F.col(group), F.lit("UNGROUPED"))
    told = F.when(name == "UNGROUPED", F.lit("episodes without a group")).when(F.col("_n") <= k, F.concat(F.lit("too few episodes to hold out in "), name))
    bad = sizes.withColumn("_t", told).where("_t is not null")
    kinds = dict(picked.dtypes)
    rows = bad.select(*[F.raise_error(F.col("_t")).cast(kinds[c]).alias(c) for c in picked.columns])
    return picked.unionByName(rows)


def holdout_first(episodes: DataFrame, group: str, k: int) -> DataFrame:
    """The first k episodes of each group; a group with at most k episodes is an error, as are ungrouped episodes."""
    return _checked(ordering.first_rows(episodes, [group], [F.col("episode_index")], k).drop("_rn"), episodes, group, k)


def holdout_random(episodes: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """As ``holdout_first``, in hash order."""
    from gaitworks.functions import hashing

    order = [hashing.draw32(seed, F.col("episode_index")), F.col("episode_index")]
    return _checked(ordering.first_rows(episodes, [group], order, k).drop("_rn"), episodes, group, k)


def holdout_near_median(episodes: DataFrame, group: str, k: int, length: str = "length") -> DataFrame:
    """The k episodes nearest the median position by length; a group with at most k episodes is an error."""
    placed = ordering.row_index(episodes, [group], [length, "episode_index"], "_pos")
    placed = ordering.with_length(placed, [group], "_pos", "_size")
    ok = F.when(F.col("_size") > k, F.col("_size")).otherwise(
        F.raise_error(F.concat(F.lit("too few episodes to hold out in "), F.col(group))).cast("bigint")
    )
    near = placed.withColumn("_away", F.abs(F.col("_pos") - F.floor(ok / 2)))
    kept = near.where(F.col("_away") <= k)  # at most 2k+1 positions per group can win
    w = Window.partitionBy(group).orderBy("_away", length, "episode_index")
    return kept.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_pos", "_size", "_away", "_rk")


def classify(text: Column, rules: Mapping[str, str], default: str = "UNGROUPED") -> Column:
    """Group of the first substring rule that matches."""
    items = list(rules.items())
    chain = F.when(F.contains(text, F.lit(items[0][0])), F.lit(items[0][1]))
    for k, g in items[1:]:
        chain = chain.when(F.contains(text, F.lit(k)), F.lit(g))
    return chain.otherwise(F.lit(default))


def merge_packs(packs: Mapping[str, DataFrame]) -> DataFrame:
    """Union of packs: new episode, frame and task numbers, provenance columns.

    Episodes are numbered by (pack order, old number) on the episode table; the
    task dictionary is the distinct text in order of first appearance; frames
    without a task share the number of the null task.
    """
    parts = [f.withColumns({"source_dataset": F.lit(n), "_pack": F.lit(i)}) for i, (n, f) in enumerate(packs.items())]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    # a row for each task of an episode holds all that is numbered; frames are read for it, and once more for the join
    seen = stored(both.groupBy("_pack", "episode_index", "task").agg(F.min("frame_index").alias("_first"), (F.max("frame_index") + 1).alias("_n")), "merged-tasks")
    eps = seen.groupBy("_pack", "episode_index").agg(F.max("_n").alias("length"))
    eps = ordering.global_index(eps, ["_pack", "episode_index"], "new_episode_index", {"offset": F.col("length")})
    first = seen.groupBy("task").agg(F.min(F.struct("_pack", "episode_index", "_first")).alias("_p")).select("task", "_p.*")
    texts = ordering.global_index(first, ["_pack", "episode_index", "_first", "task"], "new_task_index").select(F.col("task").alias("_t"), "new_task_index")
    told = seen.join(eps, ["_pack", "episode_index"]).join(texts, F.col("task").eqNullSafe(F.col("_t"))).drop("_t", "_first", "_n")
    got = ordering.per_episode(both, told.withColumnRenamed("task", "_t"), ["_pack", "episode_index"], "frame_index", "length", on=F.col("task").eqNullSafe(F.col("_t")))
    return got.select(
        "source_dataset", F.col("episode_index").alias("source_episode_index"), F.col("new_episode_index").alias("episode_index"),
        "frame_index", (F.col("offset") + F.col("frame_index")).alias("index"), F.col("new_task_index").alias("task_index"), "task",
    )


def stable_order(df: DataFrame, text: str, position: str, name: str) -> DataFrame:
    """Distinct values numbered by first appearance."""
    first = df.groupBy(text).agg(F.min(position).alias("_p"))
    return ordering.global_index(first, ["_p", text], name).drop("_p")


def union_common(sources: Mapping[str, DataFrame]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Union over the columns common to all sources, and what each source lost."""
    names = list(sources)
    common = [c for c in sources[names[0]].columns if all(c in sources[n].columns for n in names)]
    if not common:
        raise ValueError("the sources have no column in common")
    dropped = {n: [c for c in sources[n].columns if c not in common] for n in names}
    parts = [sources[n].select(*common, F.lit(n).alias("source")) for n in names]
    return reduce(lambda a, b: a.unionByName(b), parts), dropped


def split_train_val(episodes: DataFrame, val: DataFrame, key: str = "episode_index") -> DataFrame:
    """Both splits with dense new numbers; a validation episode that the source lacks raises when it is read."""
    v = val.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_v", F.lit(True))
    t = episodes.withColumn("_e", F.lit(True)).join(v, key, "full")
    unknown = F.raise_error(F.concat(F.lit("validation episode not in the source: "), F.col(key).cast("string"))).cast("string")
    split = F.when(F.col("_e").isNull(), unknown).when(F.col("_v"), "val").otherwise("train")
    return ordering.row_index(t.withColumn("split", split).drop("_v", "_e"), ["split"], [key], "new_index")


def split_statistics(statistics: DataFrame, splits: Sequence[str] = ("train", "val")) -> DataFrame:
    """Statistics of the whole data kept with each split, so that both are normalised alike."""
    return statistics.withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))


def split_by_task(frames: DataFrame, tasks: DataFrame, task: str = "task_index", key: str = "episode_index") -> tuple[DataFrame, DataFrame]:
    """Frames of the listed tasks and the remapped task table."""
    kept = tasks.select(task).distinct()
    remap = ordering.global_index(kept, [task], "new_task_index")
    return frames.join(remap, task), remap


def group_name(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Source name without trailing ``_<n>``, then without ``_new`` / ``_clean``, aliases applied."""
    base = F.regexp_replace(F.regexp_replace(name, r"_\d+$", ""), r"_(new|clean)$", "")
    if not aliases:
        return base
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, base), base)


def split_modulo(episodes: DataFrame, ratio: float, key: str = "episode_index") -> DataFrame:
    every = max(1, round(1 / ratio))
    return episodes.withColumn("split", F.when(F.col(key) % every == 0, "val").otherwise("train"))


def split_seeded(names: DataFrame, name: str, ratio: float, seed: str) -> DataFrame:
    """``max(1, int(n * ratio))`` names by hash order go to validation."""
    from gaitworks.functions import hashing

    n = names.agg(F.count(F.lit(1))).scalar()
    t = ordering.global_index(names.withColumn("_h", hashing.draw32(seed, F.col(name))), ["_h", name], "_i")
    k = F.greatest(F.lit(1), F.floor(n * F.lit(ratio)))
    return t.withColumn("split", F.when(F.col("_i") < k, "val").otherwise("train")).drop("_h", "_i")


def nested_subsets(items: DataFrame, key: str, shares: Sequence[float], seed: str) -> DataFrame:
    """One hash order; an item belongs to every prefix of size int(N*p) that reaches it."""
    from gaitworks.functions import hashing

    n = items.agg(F.count(F.lit(1))).scalar()
    t = ordering.global_index(items.withColumn("_h", hashing.draw32(seed, F.col(key))), ["_h", key], "_i")
    t = t.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return t.where(F.col("_i") < F.floor(n * F.col("share"))).select(key, "share", F.col("_i").alias("rank"))


def even_chunks(items: DataFrame, key: str, k: int) -> DataFrame:
    """k contiguous parts of ceil(n/k)."""
    n = items.agg(F.count(F.lit(1))).scalar()
    t = ordering.global_index(items, [key], "_i")
    return t.withColumn("chunk", F.floor(F.col("_i") / F.ceil(n / F.lit(float(k)))).cast("bigint")).withColumnRenamed("_i", "position")


def name_diff(source: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    a, b = source.select(name), reference.select(name)
    return a.exceptAll(b).withColumn("side", F.lit("source_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("reference_only")))


def intersect_ranges(ranges: DataFrame, low: str, high: str, lo: Column, hi: Column) -> DataFrame:
    """Half-open ranges cut to [lo, hi); empty ones are dropped."""
    a, b = F.greatest(F.col(low), lo), F.least(F.col(high), hi)
    return ranges.withColumns({"from_index": a, "to_index": b}).where(F.col("from_index") < F.col("to_index"))


def prune_features(frames: DataFrame, features: DataFrame, unread: Sequence[str], name: str = "name") -> tuple[DataFrame, DataFrame]:
    return frames.drop(*unread), features.where(~F.col(name).isin(*unread))


def rename_feature(stats: DataFrame, old: str, new: str, feature: str = "feature") -> DataFrame:
    """A statistics table with one feature under another name; a table that has both names is an error."""
    clash = stats.agg(F.max(F.col(feature) == old) & F.max(F.col(feature) == new)).scalar()
    told = F.raise_error(F.lit(f"{old} and {new} are both features")).cast("string")
    return stats.withColumn(feature, F.when(~F.col(feature).eqNullSafe(old), F.col(feature)).when(clash, told).otherwise(F.lit(new)))


def backfill_names(features: DataFrame, feature: str, groups: Mapping[str, Sequence[str]], order: Sequence[str], width: int) -> DataFrame:
    names = [n for g in order for n in groups[g]]
    if len(names) != width:
        raise ValueError(f"{feature}: {len(names)} names for {width} dimensions")
    return features.withColumn("names", F.when(F.col("name") == feature, F.array(*[F.lit(n) for n in names])).otherwise(F.col("names")))


def group_spans(joints: DataFrame, keys: Sequence[str], index: str, group: str) -> DataFrame:
    """Contiguous runs of the same group with start and (exclusive) end."""
    flagged = ordering.over_frames(joints, {"_prev": lambda w: F.lag(group, 1).over(w)}, keys, index, before=1)
    new = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col(group)), 1).otherwise(0)
    runs = ordering.running_sum(flagged, new, "_run", keys, index)
    return runs.groupBy(*keys, "_run", group).agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end")).drop("_run")
