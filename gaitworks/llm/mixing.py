"""Mixing datasets to target weights in fixed-length word blocks, in DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.llm.common import stored

ROUNDS = 12  # of the permutation


def word_count(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def permuted(x: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom one-to-one map of 0 .. size - 1 onto itself: swap-or-not rounds.

    Round r pairs x with (k_r - x) mod size; a hash of the pair's larger member decides whether they change places.
    """
    def step(at: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(key, r), size) - at, size)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(at, mate)), F.lit(2)) == 1, mate).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def mix_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source_dataset, source_size, source_no, target) of (source_dataset, source_size).

    Sources in code-point order, null last, take ``weights`` in turn. Targets share ``share`` of all words by weight;
    a source stops at ``most`` times its size, what it leaves goes to the others by weight. In closed form: with sources
    ordered by size / weight, the first ones that the level of the rest would exceed are at their limit. One row per
    source passes through the unpartitioned windows.
    """
    by_name = Window.orderBy(F.col("source_dataset").isNull(), "source_dataset")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("long")).withColumn("w", w)
    t = t.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    up = Window.orderBy(F.col("limit") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("rest", F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(up), F.lit(0.0)))
    t = t.withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    t = t.withColumn("full", F.col("limit") * F.col("rest_w") <= F.col("rest") * F.col("w"))
    first_open = F.max(F.when(~F.col("full"), F.struct((-F.col("limit") / F.col("w")).alias("a"), (-F.col("source_no")).alias("b"), (F.col("rest") / F.col("rest_w")).alias("level")))).over(every)
    t = t.withColumn("level", first_open.getField("level"))
    return t.select("source_dataset", "source_size", "source_no", F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("w"))).alias("target"))


def mix_sources(
    episodes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 32,
    shard_slots: int = 65_536, seed: int = 11,
) -> DataFrame:
    """Draw a mixture of datasets from ``episodes`` (episode_index, instruction, source_dataset).

    The words of a dataset, its episodes in hash order, are cut into blocks of ``block`` words. The mixture is a row of
    block slots in shards of ``shard_slots``: each slot draws its dataset with the target's probability, which makes the
    counts of a shard multinomial. Slots that a dataset drew beyond its target go to those that drew too few, so the
    totals meet the targets. Slot j of a dataset takes block permutation(j mod blocks), with a new permutation for each
    pass over the dataset, so no block is taken more than ``ceil(most)`` times. Blocks are joined by index.

    Returns one row per episode: episode_index, size (words), source_dataset, source_size, target, taken (words that the
    mixture takes, repeats counted), row_no. All draws are hashes of ``seed``, episode_index and dataset position; a
    repeat of the run takes the same. Everything runs on built-in functions. Hot datasets are cut into hash cells
    before any ordered sum; per-dataset tables have one row each.

    Null text has size 0 and takes nothing. A null source is a source of its own, the last. Repeated rows are episodes
    of their own (row_no tells them apart). Datasets of no words have target 0. No rows: no rows. Further columns are
    ignored.
    """
    spark = episodes.sparkSession
    rows = episodes.select(
        F.col("episode_index").cast("long").alias("episode_index"), F.col("source_dataset").cast("string").alias("source_dataset"),
        word_count("instruction").alias("size"), F.xxhash64(F.lit(seed), "episode_index").alias("h"),
    )
    rows = stored(rows.withColumn("row_no", F.monotonically_increasing_id()), "mix-sizes")
    n = rows.count()
    cells = max(8, int(n ** 0.5))
    targets = mix_targets(rows.groupBy("source_dataset").agg(F.sum("size").alias("source_size")), weights, share, most)
    # slots of each source: rounded targets, at most the whole passes that its limit leaves
    targets = targets.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
    targets = targets.withColumn("slots", F.least(F.round(F.col("target") / F.lit(block)), F.col("blocks") * F.lit(ceil(most))).cast("long"))
    targets = stored(targets, "mix-targets")
    n_slots = targets.agg(F.sum("slots")).first()[0] or 0
    counts = rows.groupBy("source_dataset", F.pmod("h", F.lit(cells)).alias("cell")).agg(F.sum("size").alias("cell_size"))

    # word offset of each episode in its source: cells in order, episodes in order within a cell
    key = F.struct(F.col("source_dataset").isNull(), F.coalesce("source_dataset", F.lit(""))).alias("k")
    to_cell = Window.partitionBy("source_dataset").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_base = counts.select(key, "cell", F.coalesce(F.sum("cell_size").over(to_cell), F.lit(0)).alias("base"))
    in_cell = Window.partitionBy("k", "cell").orderBy("h", "episode_index", "row_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.select("*", key, F.pmod("h", F.lit(cells)).alias("cell")).withColumn("within", F.coalesce(F.sum("size").over(in_cell), F.lit(0)))
        .join(cell_base, ["k", "cell"]).withColumn("at", F.col("base") + F.col("within")).drop("cell", "within", "base")
    )
    keyed = targets.select(key, "source_size", "source_no", "target", "blocks", "slots")
    placed = stored(placed.join(keyed, "k").select("row_no", "episode_index", "source_dataset", "size", "at", "source_no", "source_size", "target"), "mix-placed")

    # multinomial draws: a slot's uniform number falls into one source's span of the slots
    span = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    spans = targets.where("slots > 0").withColumn("lo", F.coalesce(F.sum("slots").over(span), F.lit(0))).withColumn("hi", F.col("lo") + F.col("slots"))
    bins = 4096
    wide = max(1, -(-n_slots // bins))
    spans = spans.select("source_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))).alias("bin"))
    slots = spark.range(n_slots).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.col("id"), F.pmod(F.xxhash64(F.lit(seed), F.lit("slot"), "id"), F.lit(max(1, n_slots))).alias("u"))
    drawn = slots.withColumn("bin", F.floor(F.col("u") / wide)).join(spans, "bin").where("u >= lo and u < hi")
    shard_counts = stored(drawn.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("c")), "mix-draws")
    # what was drawn too often is settled against what was drawn too rarely, slot by slot
    drew = targets.where("slots > 0").join(shard_counts.groupBy("source_no").agg(F.sum("c").alias("drew")), "source_no", "left").fillna(0, ["drew"])
    over = drew.select("source_no", (F.col("drew") - F.col("slots")).alias("d"))
    to_shard = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # the slots of a source in a shard are one run of its numbers; those beyond its total are surplus. The runs are few
    # and small and what is made of them is not, so they are spread by number of slots, not by their bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_slots // 500_000)
    runs = shard_counts.withColumn("from", F.coalesce(F.sum("c").over(to_shard), F.lit(0))).join(targets.select("source_no", "blocks", "slots"), "source_no")
    runs = runs.repartition(tasks, "shard", "source_no")
    own = runs.withColumn("to", F.least(F.col("from") + F.col("c"), F.col("slots"))).where("`from` < `to`").select(
        "source_no", "blocks", "shard", F.explode(F.sequence("from", F.col("to") - 1)).alias("j"))
    line = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    spare = runs.where("`from` + c > slots").select("shard", "source_no", F.explode(F.sequence(F.greatest("from", "slots"), F.col("from") + F.col("c") - 1)).alias("j"))
    spare = spare.join(targets.select("source_no", "slots"), "source_no").join(
        over.where("d > 0").select("source_no", F.coalesce(F.sum("d").over(line), F.lit(0)).alias("e0")), "source_no")
    spare = spare.select("shard", (F.col("e0") + F.col("j") - F.col("slots")).alias("e"))
    lack = over.where("d < 0").withColumn("n", -F.col("d")).withColumn("e0", F.coalesce(F.sum("n").over(line), F.lit(0)))
    lack = lack.join(drew.select("source_no", "drew", "blocks"), "source_no").select(
        "source_no", "blocks", "drew", "e0", F.explode(F.sequence("e0", F.col("e0") + F.col("n") - 1)).alias("e"))
    settled = spare.join(lack, "e").select("source_no", "blocks", "shard", (F.col("drew") + F.col("e") - F.col("e0")).alias("j"))
    taken_slots = own.unionByName(settled)
    block_no = permuted(F.pmod("j", "blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "source_no", F.floor(F.col("j") / F.col("blocks"))))
    taken_blocks = taken_slots.select("source_no", block_no.alias("block_no")).groupBy("source_no", "block_no").agg(F.count(F.lit(1)).alias("times"))

    # blocks that each episode's words fall into, with the words in each
    covers = placed.where("size > 0").select(
        "row_no", "source_no", "at", "size",
        F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block_no"))
    words = F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * block) - F.greatest(F.col("at"), F.col("block_no") * block)
    took = covers.join(taken_blocks, ["source_no", "block_no"]).groupBy("row_no").agg(F.sum(F.col("times") * words).alias("taken"))
    return placed.join(took, "row_no", "left").select(
        "episode_index", "size", "source_dataset", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row_no")


def whole_episode_times(episodes: DataFrame, seed: int = 11) -> DataFrame:
    """How often each whole episode of ``episodes`` goes into the mixture of ``mix_sources``, so that the words of each
    dataset meet its target to half an episode: source_dataset, episode_index, times (above 0).

    An episode is there as often as the mixture takes all of it. What its dataset then lacks is made up of episodes of
    which the mixture takes a part more, in the order of a hash draw divided by that part: the larger the part, the
    likelier the episode. Episodes without words weigh nothing and stay once. Repeated rows of one episode and dataset
    are one here. Null index and dataset are values of their own. No rows: no rows.
    """
    mixed = mix_sources(episodes, seed=seed).groupBy("source_dataset", "episode_index").agg(
        F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.first("target").alias("target"))
    mixed = mixed.withColumn("whole", F.when(F.col("size") == 0, 1).otherwise(F.expr("taken div size")))
    mixed = stored(mixed.withColumn("part", F.col("taken") - F.col("whole") * F.col("size")), "mixed")
    lack = mixed.groupBy("source_dataset").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("lack"))
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.lit("whole"), "episode_index"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52)) * F.col("size") / F.col("part")
    # words before each episode in that order, in cells of the draw as in mix_sources
    cells = max(8, int(mixed.count() ** 0.5))
    parts = mixed.where("part > 0").withColumn("draw", draw).withColumn("cell", F.floor(F.col("draw") / (F.col("draw") + 1) * cells))
    to_cell = Window.partitionBy("source_dataset").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("source_dataset", "cell").agg(F.sum("size").alias("words"))
    base = base.select(F.col("source_dataset").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("words").over(to_cell), F.lit(0)).alias("base"))
    in_cell = Window.partitionBy("source_dataset", "cell").orderBy("draw", "episode_index").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("within", F.coalesce(F.sum("size").over(in_cell), F.lit(0)))
    parts = parts.join(base, F.col("source_dataset").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    parts = parts.join(lack.withColumnRenamed("source_dataset", "s2"), F.col("source_dataset").eqNullSafe(F.col("s2")))
    once_more = F.when(F.col("base") + F.col("within") + F.col("size") / 2 <= F.col("lack"), 1).otherwise(0)
    times = parts.select("source_dataset", "episode_index", (F.col("whole") + once_more).alias("times"))
    times = times.unionByName(mixed.where("part <= 0 or size = 0").select("source_dataset", "episode_index", F.col("whole").alias("times")))
    return times.where("times > 0").withColumn("times", F.col("times").cast("int"))
