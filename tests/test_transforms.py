import pytest
from pyspark.sql import functions as F

from gaitworks.operators import transforms as T


def steps():
    return T.Chain((
        T.column_step("double", "x", lambda c: c * 2, lambda c: c / 2),
        T.column_step("noise", "x", lambda c: c + 100, training_only=True),
        T.column_step("less", "x", lambda c: c - 1, lambda c: c + 1),
    ))


def test_chain_training_and_inverse(spark):
    df = spark.createDataFrame([(3.0,), (None,)], "x double")
    values = lambda t: [r.x for r in t.collect()]
    assert values(steps().apply(df)) == [105.0, None]
    assert values(steps().apply(df, training=False)) == [5.0, None]
    assert values(steps().undo(steps().apply(df, training=False))) == [3.0, None]
    with pytest.raises(ValueError, match="no inverse"):
        steps().then(T.column_step("abs", "x", F.abs)).undo(df)
    with pytest.raises(ValueError, match="repeat"):
        steps().then(steps())


def test_mixture_errors(spark):
    schema = "mixture string, dataset string, weight double, embodiment string"
    good = T.mixture_ratios(spark.createDataFrame([("m", "a", 1.0, "b"), ("m", "c", 3.0, "b"), ("n", "a", 2.0, "b")], schema)).collect()
    assert {(r.mixture, r.dataset): r.ratio for r in good} == {("m", "a"): 0.25, ("m", "c"): 0.75, ("n", "a"): 1.0}
    for rows in ([("m", "a", -1.0, "b")], [("m", "a", 1.0, "b"), ("m", "a", 1.0, "b")], [("m", "a", 0.0, "b")]):
        with pytest.raises(Exception, match="weigh|twice"):
            T.mixture_ratios(spark.createDataFrame(rows, schema)).collect()


def test_registry_places_spans(spark):
    config = spark.createDataFrame([("g", 0, 2, 2), ("g", 2, 3, 0), ("h", 1, 2, 3)], "embodiment string, source_start long, source_stop long, slot_start long")
    df = spark.createDataFrame([("g", [1.0, 2.0, 3.0]), ("h", [7.0, 8.0])], "body string, v array<double>")
    got = {r.body: r.p for r in T.place_by_registry(df, config, "v", "body", 4, "p").collect()}
    assert got == {"g": [3.0, 0.0, 1.0, 2.0], "h": [0.0, 0.0, 0.0, 8.0]}
    with pytest.raises(Exception, match="unknown embodiment"):
        T.place_by_registry(df.withColumn("body", F.lit("z")), config, "v", "body", 4, "p").collect()
    with pytest.raises(Exception, match="leave the width"):
        T.place_by_registry(df, config, "v", "body", 3, "p").collect()


def test_rows_stay_where_they_are_when_statistics_are_attached(spark):
    """Whatever Spark thinks of the sizes: a row per embodiment or dimension would send the table to as many tasks."""
    from gaitworks.operators import normalise, scoring

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).selectExpr("id % 2 as embodiment", "cast(id % 4 as int) as dim", "array(cast(id as double)) as v", "cast(id as double) as err")
        st = spark.createDataFrame([(0, [0.0], [9.0]), (1, [0.0], [5.0])], "embodiment long, min array<double>, max array<double>")
        bounds = spark.createDataFrame([(i, 0.0, 2.0) for i in range(4)], "dim int, lo double, hi double")
        for df in (normalise.with_stats(rows, st, ["embodiment"]), scoring.denormalised_l1(rows, bounds, {"all": (0, 4)})):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert df.first().l1 == 49.5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paths_keep_all_digits_of_an_episode(spark):
    from pyspark.sql import functions as F

    from gaitworks.functions import projections

    rows = [("a/episode_000012.mp4", 12, 19), ("a/episode_1000000.mp4", 1000000, 1000007), ("a/episode_1000000.mp4", 100000, 5), ("a/episode_999999.mp4", 999999, 1000006)]
    df = spark.createDataFrame(rows, "p string, old long, new long")
    got = [r.q for r in df.select(projections.renumber_path(F.col("p"), F.col("old"), F.col("new")).alias("q")).collect()]
    assert got == ["a/episode_000019.mp4", "a/episode_1000007.mp4", "a/episode_1000000.mp4", "a/episode_1000006.mp4"]
