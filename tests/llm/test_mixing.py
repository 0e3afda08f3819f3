import re

import pytest
from pyspark.sql import functions as F

from gaitworks.llm import mixing


def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 64, 1001):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("p"))
        got = [r.p for r in df.collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got)


@pytest.mark.parametrize("share", [0.3, 1.5, 2.0])
def test_targets_and_draws(spark, share):
    rows = [(i, " ".join(["w"] * (i * 7 % 300)), ["a", "b", "c", None, "zz", "é"][min(i % 17, 5)]) for i in range(900)]
    df = spark.createDataFrame(rows, "episode_index long, instruction string, source_dataset string").withColumn("size", F.lit(1)).withColumn("k", F.lit(2))
    got = mixing.mix_sources(df, share=share, block=16, shard_slots=256).collect()
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes, (3, 1, 2), share, 2.0)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == len(rows[r.episode_index][1].split()) and r.source_size == sizes[r.source_dataset]
        assert abs(r.target - want[r.source_dataset]) < 1e-6 and r.taken <= 2 * r.size
        taken[r.source_dataset] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40
    again = mixing.mix_sources(df.repartition(5), share=share, block=16, shard_slots=256).collect()
    assert sorted((r.episode_index, r.taken) for r in got) == sorted((r.episode_index, r.taken) for r in again)
    if share == 0.3:  # a source with less than its size is taken from all over, not from its start
        early, late = (sum(r.taken for r in got if r.source_dataset == "é" and (r.episode_index < 450) == first) for first in (True, False))
        assert 0.5 < early / late < 2


def test_odd_rows(spark, odd, none):
    got = mixing.mix_sources(odd, block=8).collect()
    given = odd.collect()
    assert len(got) == len(given)
    want = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.instruction or "")) for r in given)
    assert sorted(r.size for r in got) == want and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix_sources(none).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "episode_index long, instruction string, source_dataset string")
    assert {(r.episode_index, r.target, r.taken) for r in mixing.mix_sources(empty).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_built_in_functions_only(spark, odd):
    plan = mixing.mix_sources(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_limit_between_whole_passes(spark):
    rows = [(i, "w " * 100, "ab"[i % 10 == 0]) for i in range(200)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "episode_index long, instruction string, source_dataset string"), weights=(1, 9), share=1.2, most=1.5, shard_slots=256).collect()
    target = {r.source_dataset: r.target for r in got}
    assert target == {"a": 21_000.0, "b": 3_000.0}
    for s, t in target.items():
        assert abs(sum(r.taken for r in got if r.source_dataset == s) - t) <= 64
