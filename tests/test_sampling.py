from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitworks.functions import hashing
from gaitworks.operators import sampling as K

SCHEMA = "dataset string, weight bigint, length bigint"


def registry(spark, weights):
    return spark.createDataFrame([(f"d{i:04}", w, i) for i, w in enumerate(weights)], SCHEMA)


def shares(table, total):
    """Share of the draws that each option gets, exactly."""
    got = {}
    cells = table.collect()
    assert sorted(r.cell for r in cells) == list(range(len(cells)))
    for r in cells:
        assert 0 <= r.keep <= 1
        own = Fraction(round(r.keep * total), total)
        for option, share in ((r.own.dataset, own), (r.other.dataset, 1 - own)):
            got[option] = got.get(option, 0) + share / len(cells)
    return {k: v for k, v in got.items() if v}


@pytest.mark.parametrize("weights", [
    [1, 2, 3, 1, 5], [7], [2, 2, 2], [1, 1, 1, 1000], [1000, 1, 1, 1], [0, 3, None, -2, 1], [5, 1, 5, 1, 2, 4],
    [1, 1, 1, 1, 1, 1, 7, 4, 4], [0, 0],
])
def test_alias_table_gives_each_its_share(spark, weights):
    live = {f"d{i:04}": w for i, w in enumerate(weights) if w and w > 0}
    total = sum(live.values())
    assert shares(K.alias_table(registry(spark, weights), "dataset", "weight"), total) == {k: Fraction(w, total) for k, w in live.items()}


def test_alias_table_of_many_parts(spark, many_parts):
    weights = [int(w) for w in np.random.default_rng(3).zipf(1.5, 400) % 10_000]
    total = sum(weights)
    got = shares(K.alias_table(registry(spark, weights), "dataset", "weight"), total)
    assert got == {f"d{i:04}": Fraction(w, total) for i, w in enumerate(weights) if w}


def test_draws_follow_weights_joined_either_way(spark, monkeypatch):
    draws = spark.range(20_000).withColumnRenamed("id", "draw")
    pick = lambda: K.pick_registered(
        draws, registry(spark, [1, 0, 3, 6]), "dataset", "weight", hashing.uniform("s", F.col("draw")), hashing.uniform("s-coin", F.col("draw")))
    small = pick()
    assert small.columns == ["draw", "dataset", "length"]
    rows = sorted(small.collect())
    assert [r.draw for r in rows] == list(range(20_000))
    count = {d: sum(r.dataset == d for r in rows) / 20_000 for d in ("d0000", "d0001", "d0002", "d0003")}
    assert count == pytest.approx({"d0000": 0.1, "d0001": 0, "d0002": 0.3, "d0003": 0.6}, abs=0.015)
    monkeypatch.setattr(K, "REGISTRY", 2)
    assert sorted(pick().collect()) == rows


def test_nothing_to_draw_and_wrong_weights(spark):
    draws = spark.range(3).withColumnRenamed("id", "draw")
    half = F.lit(0.5)
    assert K.pick_registered(draws, registry(spark, [0]), "dataset", "weight", half, half).count() == 0
    with pytest.raises(ValueError, match="integer"):
        K.alias_table(registry(spark, [1]).withColumn("weight", F.lit(0.5)), "dataset", "weight")
