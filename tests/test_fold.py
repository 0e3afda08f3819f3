import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from gaitworks.operators import fold, sampling


def brute(lengths, size):
    ids, fill, shard = [], 0, 0
    for n in lengths:
        if fill > 0 and fill + n > 2 * size:
            shard, fill = shard + 1, 0
        ids.append(shard)
        fill += n
        if fill >= size:
            shard, fill = shard + 1, 0
    return ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(1, 12), st.integers(1, 4))
def test_block_fold_equals_sequential(lengths, size, per_block):
    arr = np.array(lengths)
    off = np.concatenate([[0], np.cumsum(arr)[:-1]])
    block = off // (size * per_block)
    tables = []
    for b in np.unique(block):
        t = fold.tabulate(arr[block == b], size)
        t.insert(0, "_b", b)
        tables.append(t)
    starts = fold.chain(pd.concat(tables))
    got = []
    for _, s in starts.iterrows():
        got += list(fold.number(arr[block == s["_b"]], size, int(s["f_in"]), int(s["base"])))
    assert got == brute(lengths, size)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(1, 12), st.integers(1, 3), st.integers(1, 4))
def test_composed_blocks_are_one_block(lengths, size, per_block, fan_in):
    arr = np.array(lengths)
    block = np.concatenate([[0], np.cumsum(arr)[:-1]]) // (size * per_block)
    tables = pd.concat([fold.tabulate(arr[block == b], size).assign(_b=b) for b in np.unique(block)])
    for up in np.unique(block // fan_in):
        part = tables[tables["_b"] // fan_in == up]
        t = fold.compose(part)
        for fill in range(size):
            last = fold.chain(part.assign(_b=part["_b"] * 2), fill, 0)
            hit = t[(t["f_lo"] <= fill) & (fill <= t["f_hi"])]
            assert len(hit) == 1
            end, shards = fill, 0
            for n in arr[block // fan_in == up]:
                if end > 0 and end + n > 2 * size:
                    shards, end = shards + 1, 0
                end += n
                if end >= size:
                    shards, end = shards + 1, 0
            out = int(hit["f_out"].iloc[0])
            assert (int(hit["closed"].iloc[0]), out if out >= 0 else fill - 1 - out) == (shards, end) and last["f_in"].iloc[0] == fill


def test_pack_sequential_on_spark(spark):
    rng = np.random.default_rng(5)
    rows = [(p, e, int(n)) for p in (0, 1) for e, n in enumerate(rng.integers(1, 25, 150))]
    df = spark.createDataFrame(rows, "pack long, episode_index long, length long")
    got = sampling.pack_sequential(df, "pack", 10, fold_shards=3, fan_in=3).collect()
    for p in (0, 1):
        mine = sorted((r.episode_index, r.shard) for r in got if r.pack == p)
        assert [s for _, s in mine] == brute([n for q, _, n in rows if q == p], 10)
