"""Weights, hash draws, shards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.functions import hashing
from gaitworks.operators import joins, ordering
from gaitworks.session import stored


def rule_weight(text: Column, rules: Mapping[str, float]) -> Column:
    """Largest weight among the substring rules that match, else 1."""
    hits = [F.when(F.contains(text, F.lit(k)), F.lit(float(w))) for k, w in rules.items()]
    return F.coalesce(F.greatest(*hits) if len(hits) > 1 else hits[0], F.lit(1.0))


def task_weights(frames: DataFrame, tasks: DataFrame, rules: Mapping[str, float], task: str = "task", key: str = "task_index") -> DataFrame:
    weighted = tasks.select(key, rule_weight(F.col(task), rules).alias("weight"))
    return frames.join(weighted, key)


def boost_share(weighted: DataFrame, weight: str = "weight", digits: int = 6) -> DataFrame:
    w = F.col(weight)
    boosted = w != 1.0
    return weighted.agg(
        F.round(F.avg(F.when(boosted, 1.0).otherwise(0.0)), digits).alias("frame_share"),
        F.round(F.sum(F.when(boosted, w).otherwise(0.0)) / F.sum(w), digits).alias("draw_share"),
    )


def mixture_weights(episodes: DataFrame, weights: DataFrame, dataset: str, balanced: bool = True, balance_episodes: bool = True) -> DataFrame:
    """Dataset weight (times length when balanced, normalised) and episode weight.

    ``episodes`` has ``usable`` steps and a ``bad`` flag; bad episodes weigh 0.
    """
    w = F.col("usable") if balance_episodes else F.lit(1.0)
    e = episodes.withColumn("_w", F.when(F.col("bad"), F.lit(0.0)).otherwise(w.cast("double")))
    per = e.groupBy(dataset).agg(F.sum("_w").alias("_t"), F.sum("length").alias("_len")).join(weights, dataset)
    scaled = F.col("weight") * (F.col("_len") if balanced else F.lit(1.0))
    per = per.withColumn("_d", scaled)
    total = per.agg(F.sum("_d")).scalar()
    per = per.select(dataset, "_t", (F.col("_d") / total).alias("dataset_weight"))
    return e.join(per, dataset).select(
        dataset, "episode_index", "dataset_weight", F.try_divide(F.col("_w"), F.col("_t")).alias("episode_weight")
    )


REGISTRY = 10_000  # cells of an alias table that are sent to every task; a larger table is joined by an exchange


def alias_table(options: DataFrame, order: str, weight: str) -> DataFrame:
    """One cell per option of positive weight: ``cell`` from 0, ``own`` and ``other`` (structs of the remaining columns),
    and ``keep``, the share of the cell that is its own.

    A cell drawn evenly, then its own option below ``keep`` and the other one above it, gives each option its share of the
    total exactly. With n options and total t, an option of weight w holds n * w of the cells' n * t. Light options lack
    t - n * w, heavy ones have n * w - t to give; both are laid end to end along one line, so a light cell is filled by the
    heavy option that stands where its gap begins, and a heavy one that has to give beyond its own end is filled by the
    next. Running totals and two interval joins, whatever the size. Weights are integers; null, zero and negative ones are
    no options; ``order`` is unique.
    """
    if dict(options.dtypes)[weight] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{weight} must be an integer column")
    rest = [c for c in options.columns if c != weight]
    live = stored(options.where(F.col(weight) > 0).select(F.col(weight).cast("bigint").alias("_w"), F.struct(*rest).alias("own"), F.col(order).alias("_o")), "registry")
    n, total = live.agg(F.count(F.lit(1))).scalar(), live.agg(F.sum("_w")).scalar()
    mass = live.withColumns({"_m": F.col("_w") * n, "_t": total})
    mass = mass.withColumns({"_rank": F.signum(F.col("_m") - F.col("_t")).cast("int"), "_d": F.abs(F.col("_m") - F.col("_t"))})
    # light options, even ones, which lack and give nothing, and heavy ones
    cells = stored(ordering.global_index(mass, ["_rank", "_o"], "cell", {"_lo": F.col("_d")}), "cells")
    light, heavy = cells.where("_rank = -1"), cells.where("_rank = 1")
    lacking = F.coalesce(light.agg(F.sum("_d")).scalar(), F.lit(0))
    heavy = heavy.withColumn("_lo", F.col("_lo") - lacking)
    line = lambda t: t.withColumns({"_hi": F.col("_lo") + F.col("_d"), "_at": F.lit(0)})
    light, heavy = line(light), line(heavy)
    width = lambda t: joins.span_width(t, F.col("_d"))
    givers = heavy.select("_at", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), F.col("own").alias("other"))
    filled = joins.interval_join(light, givers, ["_at"], "_lo", "_from", "_to", width(heavy))
    gaps = light.select("_at", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
    ends = joins.interval_join(heavy.withColumn("_last", F.col("_hi") - 1), gaps, ["_at"], "_last", "_from", "_to", width(light))
    following = heavy.select((F.col("cell") - 1).alias("cell"), F.col("own").alias("other"))
    ends = ends.join(following, "cell", "left")
    kept = lambda t, keep: t.select("cell", "own", F.coalesce("other", "own").alias("other"), (keep / F.col("_t")).alias("keep"))
    return (
        kept(cells.where("_rank = 0").withColumn("other", F.col("own")), F.col("_t"))
        .unionByName(kept(filled, F.col("_m")))
        .unionByName(kept(ends, F.col("_t") - (F.col("_to") - F.col("_hi"))))
    )


def pick_registered(draws: DataFrame, options: DataFrame, order: str, weight: str, u: Column, coin: Column) -> DataFrame:
    """Weighted choice among registered datasets by an alias table: ``u`` names the cell, ``coin`` one of its two options.

    A table of at most ``REGISTRY`` cells is broadcast after they were counted; a larger one is joined on the cell, which
    spreads evenly whatever the weights. Without an option of positive weight nothing is drawn.
    """
    table = stored(alias_table(options, order, weight), "alias")
    n = table.count()
    cells = F.broadcast(table) if n <= REGISTRY else table
    at = draws.withColumns({"_cell": F.floor(u * n).cast("bigint"), "_coin": coin})
    got = at.join(cells, F.col("_cell") == F.col("cell")).withColumn("_o", F.when(F.col("_coin") < F.col("keep"), F.col("own")).otherwise(F.col("other")))
    return got.select(*draws.columns, *[F.col(f"_o.{c}").alias(c) for c in options.columns if c != weight])


def pick_weighted(draws: DataFrame, options: DataFrame, key: str, order: str, weight: str, u: Column) -> DataFrame:
    """Weighted choice among many options of the draw's own ``key`` (integer weights).

    floor(u * total) is located among cumulative spans by an interval join; no
    all-pairs step, and a key holding most options is cut into cells.
    """
    live = options.where(F.col(weight) > 0)
    totals = live.groupBy(key).agg(F.sum(weight).alias("_total"))
    idx = ordering.row_index(live, [key], [order], "_i")
    spans = ordering.running_sum(idx, F.col(weight), "_lo", [key], "_i", inclusive=False).withColumn("_hi", F.col("_lo") + F.col(weight))
    # draws of a popular key are many and its total is one row: salt both sides
    salts = 32
    totals = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = draws.withColumn("_salt", F.pmod(F.xxhash64(*draws.columns), F.lit(salts)).cast("int"))
    at = salted.join(totals, [key, "_salt"]).drop("_salt").withColumn("_p", F.floor(u * F.col("_total")).cast("bigint")).drop("_total")
    return joins.interval_join(at, spans.drop("_i"), [key], "_p", "_lo", "_hi", joins.span_width(live, F.col(weight))).drop("_p", "_lo", "_hi")


def _cell_and_coin(seed: str, *key: Column) -> tuple[Column, Column]:
    return hashing.uniform(seed, *key), hashing.uniform(f"{seed}-coin", *key)


def mixture_sample(draws: DataFrame, draw: str, datasets: DataFrame, episodes: DataFrame, seed: str) -> DataFrame:
    """Dataset by weight times length, episode by usable steps, step uniform in [0, usable).

    The weights are those of ``mixture_weights``: a dataset's weight counts all its steps, and bad episodes are never
    drawn (integers stand for the normalised shares). A dataset without a usable episode is not drawn either.
    """
    e = episodes.withColumn("usable", F.when(F.col("bad"), F.lit(0)).otherwise(F.col("usable")).cast("bigint"))
    per = e.groupBy("dataset").agg(F.sum("length").alias("_len"), F.sum("usable").alias("_use")).join(datasets, "dataset")
    per = per.where("_use > 0").select("dataset", (F.col("weight") * F.col("_len")).cast("bigint").alias("weight"))
    episodes = e
    d = pick_registered(draws, per, "dataset", "weight", *_cell_and_coin(f"{seed}-d", F.col(draw)))
    e = pick_weighted(
        d.select(draw, "dataset"), episodes.select("dataset", "episode_index", "usable"), "dataset", "episode_index", "usable",
        hashing.uniform(f"{seed}-e", F.col(draw)))
    step = F.floor(hashing.uniform(f"{seed}-s", F.col(draw)) * F.col("usable")).cast("bigint")
    return e.select(draw, "dataset", "episode_index", step.alias("step"))


def batch_mixture(draws: DataFrame, draw: str, datasets: DataFrame, seed: str, batch: int, world: int) -> DataFrame:
    """Dataset by ratio, uniform local index, rank = draw % world, batches of B inside a rank."""
    d = pick_registered(draws, datasets, "dataset", "weight", *_cell_and_coin(f"{seed}-d", F.col(draw)))
    local = F.floor(hashing.uniform(f"{seed}-i", F.col(draw)) * F.col("length")).cast("bigint")
    i = F.col(draw)
    return d.select(draw, "dataset", local.alias("local_index"), (i % world).alias("rank"), F.expr(f"({draw} div {world}) div {batch}").alias("batch"))


def token_batches(batches: DataFrame, batch: str, datasets: DataFrame, budget: int, world: int, seed: str, epoch: int = 0) -> DataFrame:
    """Per batch one dataset on every rank; batch size fits the token budget; samples differ by rank and epoch."""
    d = pick_registered(batches, datasets, "dataset", "weight", *_cell_and_coin(f"{seed}-d-{epoch}", F.col(batch)))
    size = F.greatest(F.lit(1), F.expr(f"{budget} div tokens")).cast("int")
    t = d.withColumn("batch_size", size).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(world - 1))))
    t = t.withColumn("slot", F.explode(F.expr("sequence(0, batch_size - 1)")))
    local = F.floor(hashing.uniform(f"{seed}-s-{epoch}", F.col(batch), F.col("rank"), F.col("slot")) * F.col("length")).cast("bigint")
    return t.select(batch, "dataset", "batch_size", "rank", "slot", local.alias("local_index"))


def balanced_shards(steps: DataFrame, key: Sequence[str], shards: int, seed: str) -> DataFrame:
    """Hash order dealt round-robin: shard sizes differ by at most one."""
    h = hashing.draw32(seed, *[F.col(k) for k in key])
    t = ordering.global_index(steps.withColumn("_h", h), ["_h", *key], "_i")
    return t.withColumn("shard", F.col("_i") % shards).drop("_h", "_i")


def shard_schedule_train(draws: DataFrame, draw: str, shards: DataFrame, weights: DataFrame, seed: str) -> DataFrame:
    """Datasets drawn by weight / mean shard size; within a dataset shards come in hash-shuffled rounds."""
    per = shards.groupBy("dataset").agg(F.avg("length").alias("_mean"), F.count(F.lit(1)).alias("_n")).join(weights, "dataset")
    ratio = per.select("dataset", F.round(F.col("weight") / F.col("_mean") * 1e9).cast("bigint").alias("weight"), "_n")
    d = pick_registered(draws, ratio, "dataset", "weight", *_cell_and_coin(f"{seed}-d", F.col(draw)))
    d = ordering.row_index(d.select(draw, "dataset", "_n"), ["dataset"], [draw], "_k")
    d = d.withColumns({"round": F.expr("_k div _n"), "_place": F.expr("_k % _n")}).drop("_n")
    rounds = d.groupBy("dataset").agg(F.max("round").alias("_r"))
    order = shards.select("dataset", "shard").join(rounds, "dataset").withColumn("round", F.explode(F.expr("sequence(0L, _r)"))).drop("_r")
    order = order.withColumn("_h", hashing.draw32(f"{seed}-o", F.col("dataset"), F.col("round"), F.col("shard")))
    order = ordering.row_index(order, ["dataset", "round"], ["_h", "shard"], "_place")
    return d.join(order, ["dataset", "round", "_place"]).select(draw, "dataset", "round", "shard")


def shard_schedule_eval(shards: DataFrame) -> DataFrame:
    """Every shard once, round-robin over datasets."""
    t = ordering.row_index(shards.select("dataset", "shard"), ["dataset"], ["shard"], "_turn")
    return ordering.global_index(t, ["_turn", "dataset"], "position").drop("_turn")


def assign_slots(schedule: DataFrame, position: str, world: int, workers: int) -> DataFrame:
    """Slot = position % (world * workers); a schedule shorter than the slots is repeated to fill them."""
    slots = world * workers
    n = schedule.agg(F.count(F.lit(1))).scalar()
    copies = F.greatest(F.ceil(F.lit(float(slots)) / n), F.lit(1)).cast("bigint")
    t = schedule.withColumn("_n", n).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
    pos = F.col(position) + F.col("_copy") * F.col("_n")
    keep = (F.col("_copy") == 0) | (pos < slots)
    slot = pos % slots
    return t.withColumn("_pos", pos).where(keep).select(
        *schedule.columns, F.col("_pos").alias("turn"), (slot % world).alias("rank"), F.floor(slot / world).alias("worker")
    )


def chunk_shuffle(items: DataFrame, index: str, chunk: int, seed: str) -> DataFrame:
    """Ranges of ``chunk`` items shuffled as wholes and inside; ``position`` is the new order."""
    t = items.withColumn("_c", F.expr(f"{index} div {chunk}"))
    h = hashing.draw32(f"{seed}-c", F.col("_c"))
    t = t.withColumns({"_hc": h, "_hi": hashing.draw32(f"{seed}-i", F.col(index))})
    return ordering.global_index(t, ["_hc", "_c", "_hi", index], "position").drop("_hc", "_hi").withColumnRenamed("_c", "chunk")


def replica_of(index: Column, n: Column, world: int) -> Column:
    """Which of ``world`` contiguous ranges, even to one item, holds an index of 0 .. n - 1."""
    return F.floor(((index + 1) * world - 1) / n).cast("bigint")


def chunk_shuffle_replicas(items: DataFrame, index: str, chunk: int, world: int, seed: str) -> DataFrame:
    """Each replica has one contiguous range of a dense ``index`` and shuffles that in chunks; positions count per replica."""
    n = items.agg(F.count(F.lit(1))).scalar()
    t = items.withColumn("replica", replica_of(F.col(index), n, world))
    start = F.floor(n * F.col("replica") / world)
    t = t.withColumn("chunk", F.floor((F.col(index) - start) / chunk).cast("bigint"))
    t = t.withColumns({"_hc": hashing.draw32(f"{seed}-c", F.col("replica"), F.col("chunk")), "_hi": hashing.draw32(f"{seed}-i", F.col(index))})
    return ordering.row_index(t, ["replica"], ["_hc", "chunk", "_hi", index], "position").drop("_hc", "_hi")


def epoch_length(lengths: DataFrame, total_weight: float) -> DataFrame:
    """Epoch length of a mixture (length, weight, primary): the longest of the primary datasets' length by share of the
    weight; without a usable primary, the longest usable dataset; 0 if none is usable."""
    usable = F.when((F.col("weight") > 0) & (F.col("length") > 0) & ~F.isnan(F.col("weight").cast("double")), F.lit(True))
    by_share = F.max(F.when(usable & F.col("primary"), F.col("length") / (F.col("weight") / F.lit(float(total_weight)))))
    return lengths.agg(F.coalesce(by_share, F.max(F.when(usable, F.col("length").cast("double"))), F.lit(0.0)).alias("epoch_length"))


def sample_fraction(df: DataFrame, keys: Sequence[str], key: str, rate: Column, seed: str) -> DataFrame:
    """Exactly ``int(n * rate)`` rows of each source, chosen by hash order."""
    t = ordering.row_index(df.withColumn("_h", hashing.draw32(seed, F.col(key))), keys, ["_h", key], "_i")
    return ordering.with_length(t, keys, "_i", "_n").where(F.col("_i") < F.floor(F.col("_n") * rate)).drop("_h", "_i", "_n")


def parse_suffix(name: Column) -> tuple[Column, Column]:
    """``name%NN`` -> name and NN / 100; no suffix means 1."""
    digits = F.regexp_extract(name, r"%(\d+)$", 1)
    return F.regexp_replace(name, r"%\d+$", ""), F.when(digits == "", F.lit(1.0)).otherwise(F.nullif(digits, F.lit("")).cast("double") / 100)


def mix_ratio_weights(shards: DataFrame, ratios: DataFrame, group: str, dataset: str) -> DataFrame:
    """Group mix ratio times the dataset's share of shards inside its group."""
    per = shards.groupBy(group, dataset).agg(F.count(F.lit(1)).alias("_n"))
    total = per.groupBy(group).agg(F.sum("_n").alias("_t"))
    return per.join(total, group).join(ratios, group).select(group, dataset, (F.col("ratio") * F.col("_n") / F.col("_t")).alias("weight"))


# --- sequential packing -----------------------------------------------------------------------

FOLD_SHARDS = 1024  # shard sizes per fold block: bounds one pandas group


def pack_sequential(episodes: DataFrame, pack: str, size: int, length: str = "length", episode: str = "episode_index",
                    fold_shards: int = FOLD_SHARDS, fan_in: int = 256) -> DataFrame:
    """Sequential shard packing of whole episodes, exact and without one task per pack.

    A shard closes once it holds ``size`` steps, or before an episode that would
    take it above 2 * size.  The fold's state between episodes is the current
    fill, so a block of episodes is a step function from fill-in to
    (shards closed, fill-out).  Blocks hold about ``fold_shards * size`` steps.
    Pass 1 tabulates that function per block; runs of ``fan_in`` blocks, and runs
    of those, are composed to one function each, and the starts go down the same
    levels again.  A task holds ``fan_in`` tables; only the top level, one table
    for fan_in**2 blocks, is walked per pack.  The last pass numbers the shards
    inside each block.
    """
    import pandas as pd

    from gaitworks.operators import fold

    idx = ordering.row_index(episodes, [pack], [episode], "_i")
    cum = ordering.running_sum(idx, F.col(length), "_off", [pack], "_i", inclusive=False)
    rows = cum.withColumn("_b", F.expr(f"_off div {size * fold_shards}")).select(pack, "_b", episode, F.col(length).alias("_len"), "_i")
    kind = dict(rows.dtypes)[pack]

    def tabulate(key, pdf):
        t = fold.tabulate(pdf.sort_values("_i")["_len"].to_numpy(), size)
        t.insert(0, "_b", key[1])
        t.insert(0, pack, key[0])
        return t

    tables = rows.groupBy(pack, "_b").applyInPandas(
        tabulate, f"`{pack}` {kind}, _b long, f_lo long, f_hi long, closed long, f_out long")

    def above(level: DataFrame) -> DataFrame:
        def compose(key, pdf):
            t = fold.compose(pdf)
            t.insert(0, "_b", key[1])
            t.insert(0, pack, key[0])
            return t

        return level.groupBy(pack, F.expr(f"_b div {fan_in}").alias("_up")).applyInPandas(compose, level.schema)

    def walk(level: DataFrame, tops: DataFrame | None) -> DataFrame:
        """Start of each block of a level, from the starts of the level above."""
        at_top = tops is None

        def chain(key, pdf):
            first = (0, 0) if at_top else (int(pdf["f_in"].iloc[0]), int(pdf["base"].iloc[0]))
            t = fold.chain(pdf, *first)
            t.insert(0, pack, key[0])
            return t

        out = f"`{pack}` {kind}, _b long, f_in long, base long"
        if at_top:
            return level.groupBy(pack).applyInPandas(chain, out)
        joined = level.withColumn("_up", F.expr(f"_b div {fan_in}")).join(tops.withColumnRenamed("_b", "_up"), [pack, "_up"])
        return joined.groupBy(pack, "_up").applyInPandas(chain, out)

    middle = above(tables)
    starts = walk(tables, walk(middle, walk(above(middle), None)))

    def number(key, pdf):
        pdf = pdf.sort_values("_i")
        ids = fold.number(pdf["_len"].to_numpy(), size, int(pdf["f_in"].iloc[0]), int(pdf["base"].iloc[0]))
        return pd.DataFrame({pack: pdf[pack].to_numpy(), episode: pdf[episode].to_numpy(), length: pdf["_len"].to_numpy(), "shard": ids})

    ek = dict(rows.dtypes)[episode]
    return rows.join(starts, [pack, "_b"]).groupBy(pack, "_b").applyInPandas(
        number, f"`{pack}` {kind}, `{episode}` {ek}, `{length}` long, shard long")
