import pytest

from gaitworks.operators import packs, sampling


@pytest.mark.parametrize("pick", [lambda e, k: packs.holdout_first(e, "g", k), lambda e, k: packs.holdout_random(e, "g", k, "s")])
def test_small_groups_and_ungrouped_episodes_are_errors(spark, pick):
    rows = [(i, "a") for i in range(5)] + [(i, "b") for i in range(5, 8)]
    e = spark.createDataFrame(rows, "episode_index long, g string")
    assert pick(e, 2).groupBy("g").count().orderBy("g").collect() == [("a", 2), ("b", 2)]
    with pytest.raises(Exception, match="too few episodes to hold out in b"):
        pick(e, 3).collect()
    for name in ("UNGROUPED", None):
        with pytest.raises(Exception, match="without a group"):
            pick(e.unionByName(spark.createDataFrame([(9, name)] * 9, e.schema)), 2).collect()


def test_replica_ranges_are_even_and_contiguous(spark):
    from pyspark.sql import functions as F

    for n in (1, 3, 10, 11):
        got = [r.r for r in spark.range(n).select(sampling.replica_of(F.col("id"), F.lit(n), 3).alias("r")).collect()]
        assert got == sorted(got) and got == [r for r in range(3) for _ in range(n * r // 3, n * (r + 1) // 3)]


def test_epoch_length_fallbacks(spark):
    schema = "length long, weight double, primary boolean"
    at = lambda rows: sampling.epoch_length(spark.createDataFrame(rows, schema), 4.0).first()[0]
    assert at([(10, 1.0, True), (50, 3.0, False)]) == 40.0
    assert at([(10, 0.0, True), (50, 3.0, False), (70, float("nan"), False)]) == 50.0
    assert at([(10, 0.0, True)]) == 0.0


def test_conflicting_configs_are_an_error(spark):
    rows = [("p", "arm", 7), ("q", "arm", 7), ("p", "hand", 1)]
    keys = spark.createDataFrame(rows, "pack string, key string, width long")
    assert packs.merge_common_keys(keys, "pack", "key", "width").collect() == [("arm", 2, 7)]
    with pytest.raises(Exception, match="conflicting config for arm"):
        packs.merge_common_keys(keys.replace(7, 8).limit(1).unionByName(keys.where("pack = 'q'")), "pack", "key", "width").collect()


def test_a_renamed_feature_takes_no_other_name(spark):
    stats = spark.createDataFrame([("states/action", 1.0), ("states", 2.0), (None, 3.0)], "feature string, mean double")
    assert sorted(packs.rename_feature(stats, "states/action", "state/actions").collect(), key=lambda r: r.mean)[:2] == [("state/actions", 1.0), ("states", 2.0)]
    with pytest.raises(Exception, match="are both features"):
        packs.rename_feature(stats, "states/action", "states").collect()


def test_gripper_units_there_and_back(spark):
    from math import asin

    from pyspark.sql import functions as F

    from gaitworks.functions import projections as P

    x = F.col("id") / 10
    got = spark.range(11).select(P.gripper(P.gripper(x, "turn from start", "joint share"), "joint share", "turn from start").alias("same"), P.gripper(x, "slider share", "turn share").alias("turn")).collect()
    for k, r in enumerate(got):
        s = 0.01844 + k / 10 * (0.058 - 0.01844)
        want = asin(min(1, max(-1, (0.022**2 + s**2 - 0.036**2) / (2 * 0.022 * s))))
        assert abs(r.same - k / 10) < 1e-12 and abs(r.turn - (want - 0.5476) / (1.6296 - 0.5476)) < 1e-12


def test_split_of_unknown_validation_episodes_raises(spark):
    episodes = spark.createDataFrame([(1, 4), (2, 6), (5, 1)], "episode_index long, length long")
    val = lambda *ids: spark.createDataFrame([(i,) for i in ids], "episode_index long")
    got = packs.split_train_val(episodes, val(2, 2, None)).select("episode_index", "length", "split", "new_index")
    assert sorted(map(tuple, got.collect())) == [(1, 4, "train", 0), (2, 6, "val", 0), (5, 1, "train", 1)]
    with pytest.raises(Exception, match="not in the source: 7"):
        packs.split_train_val(episodes, val(2, 7)).collect()


def test_both_splits_carry_the_statistics_of_the_whole(spark):
    whole = spark.createDataFrame([(0, 1.5), (1, None)], "dim int, mean double")
    got = packs.split_statistics(whole).select("split", "dim", "mean").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == [("train", 0, 1.5), ("train", 1, None), ("val", 0, 1.5), ("val", 1, None)]
