"""What chunk queries cost: how rows are gathered, and how often they are shuffled."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF
from gaitworks.functions import tokens
from gaitworks.operators import windows
from gaitworks.plans import tables

FRAMES = "episode_index long, frame_index long, a array<double>, s array<double>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark, lengths=(1, 2, 7)):
    return spark.createDataFrame([(e, i, [e + 0.5 * i, -1.0 * i], [1.0, 2.0 * i]) for e, n in enumerate(lengths) for i in range(n)], FRAMES)


def test_dct_of_known_width_equals_any_width(spark):
    xs = np.random.default_rng(1).normal(size=(50, 4, 3))
    df = spark.createDataFrame([(x.tolist(),) for x in xs], "c array<array<double>>")
    for width in (3, None):
        sym = tokens.dct_quantise(F.col("c"), 4, width=width)
        df = df.withColumns({f"s{width}": sym, f"r{width}": tokens.dct_reconstruct(sym, 4, width=width)})
    assert df.where("s3 = sNone and r3 = rNone").count() == 50


def test_votes_are_shuffled_as_vectors(spark):
    chunks = windows.action_chunk(frames(spark), "a", 3)
    got = windows.temporal_ensemble(chunks, "chunk", 0.1)
    assert "hashpartitioning(episode_index" in plan(got) and "dim" not in "".join(x for x in plan(got).split("\n") if "hashpartitioning" in x)
    rows = {(r.episode_index, r.tick, r.dim): (r.value, r.votes) for r in got.collect()}
    votes = [0.5 * i + 2 for i in (2, 2, 2)]  # every chunk predicts the recorded row of a tick inside the episode
    w = np.exp(-0.1 * np.arange(3))
    assert rows[(2, 2, 0)][1] == 3 and np.isclose(rows[(2, 2, 0)][0], (w * votes).sum() / w.sum(), rtol=1e-12)


def test_relative_rows_are_cut_once(spark):
    got = windows.relative_long(frames(spark), "a", "s", 3)
    assert "Window" not in plan(got)  # two passes of the quantiles read what is written
    rows = sorted((r.horizon, r.dim, r.value) for r in got.collect())
    want = sorted((h, d, [2 + 0.5 * (i + h), -1.0 * (i + h)][d] - [1.0, 2.0 * i][d]) for i in range(5) for h in range(3) for d in range(2))
    assert rows == want


def test_chunks_are_not_gathered_as_sliding_lists(spark):
    rows = [(0, 0, [0.0]), (0, 1, None), (0, 2, [2.0]), (0, 3, [3.0]), (1, 0, [9.0])]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, a array<double>").where("a is not null or frame_index = 1")
    got = windows.action_chunk(df, "a", 3)
    assert "collect_list" not in plan(got)
    chunks = {(r.episode_index, r.frame_index): [v[0] for v in r.chunk] for r in got.collect()}
    assert chunks == {(0, 0): [0, 2, 2], (0, 1): [2, 3, 3], (0, 2): [2, 3, 3], (0, 3): [3, 3, 3], (1, 0): [9, 9, 9]}
    full = windows.action_chunk(df, "a", 2, pad=False)
    assert sorted((r.episode_index, r.frame_index) for r in full.collect()) == [(0, 2)]


def test_frames_shuffle_only_what_is_asked_for(spark):
    assert tables.frames(spark, SF, "action").columns == ["episode_index", "frame_index", "action"]
    assert "l_returnflag" not in plan(tables.frames(spark, SF, "action"))
