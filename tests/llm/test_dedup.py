import hashlib
import random
import re

import pytest

from gaitworks.llm import neardup
from gaitworks.llm.common import components
from gaitworks.llm.cuckoo import CuckooIndex, exact_duplicates


def test_cuckoo_index_against_a_dict():
    rnd, index, known = random.Random(5), CuckooIndex(2), {}
    for step in range(6000):
        d = hashlib.sha256(str(rnd.randint(0, 1500)).encode()).digest()
        if rnd.random() < 0.3:
            assert index.remove(d) == (known.pop(d, None) is not None)
        elif d in known:
            assert index.find(d)[1] == known[d]
        else:
            assert index.find(d) is None
            index.add([d, step])
            known[d] = step
    assert index.n == len(known) and all(index.find(d)[1] == v for d, v in known.items())
    assert index.buckets > 2


@pytest.mark.parametrize("order", ["little", "big"])
def test_cuckoo_index_of_keys_that_start_or_end_alike(order):
    index = CuckooIndex(1)
    keys = [b"\x01\x00" + i.to_bytes(30, order) for i in range(300)]
    for k in keys:
        index.add([k])
    assert index.buckets < 1024 and all(index.find(k) for k in keys) and index.find(b"\x01\x00" + b"\xff" * 30) is None


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_exact_duplicates(spark, odd, none):
    want = brute_exact([(r.episode_index, r.instruction) for r in odd.collect()])
    for salts in (1, 64):
        assert sorted(map(tuple, exact_duplicates(odd, salts=salts).collect()), key=repr) == want
    assert exact_duplicates(none).count() == 0


def test_a_text_that_most_rows_share(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i % 40}") for i in range(900)]
    df = spark.createDataFrame(rows, "episode_index long, instruction string")
    assert sorted(map(tuple, exact_duplicates(df).collect()), key=repr) == brute_exact(rows)


def test_withdrawn_episodes_leave_the_index(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a  b"), (4, "c")], "episode_index long, instruction string")
    gone = spark.createDataFrame([(1,), (4,)], "episode_index long")
    got = {r.episode_index: (r.keep_index, r.group_size, r.kept) for r in exact_duplicates(df, gone).collect()}
    assert got == {1: (None, 0, False), 2: (2, 2, True), 3: (2, 2, False), 4: (None, 0, False)}


def brute_near(rows, percent=85):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    low = {}
    for i, (e, _) in enumerate(rows):
        if e is not None:
            low[top(i)] = min(low.get(top(i), e), e)
    return sorted(((e, len(sets[i]), low.get(top(i)) if sets[i] else e, e == (low.get(top(i)) if sets[i] else e)) for i, (e, _) in enumerate(rows)), key=repr)


def near_rows(seed=1):
    rnd = random.Random(seed)
    text = lambda n: [f"w{rnd.randint(0, 400)}" for _ in range(n)]
    base, rows = text(120), []
    for k in range(90):  # a hot group: copies with one or more words changed, near the threshold
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randint(0, 119)] = f"x{rnd.randint(0, 9)}"
        rows.append(" ".join(w))
    passage = text(60)
    rows += [" ".join(text(40) + passage + text(20)) for _ in range(40)]
    for _ in range(30):
        w = text(80)
        rows += [" ".join(w), " ".join(w[:-2] + text(2)).upper()]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [60_000, 1500])
def test_near_duplicates_of_a_hot_group(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_rows()
    df = spark.createDataFrame(rows, "episode_index long, instruction string")
    assert sorted(map(tuple, neardup.near_duplicates(df).collect()), key=repr) == brute_near(rows)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = [(r.episode_index, r.instruction) for r in odd.collect()]
    assert sorted(map(tuple, neardup.near_duplicates(odd).collect()), key=repr) == brute_near(rows)
    assert neardup.near_duplicates(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_matches_follow_the_threshold():
    assert [neardup.choose_matches(p) for p in (80, 85, 100)] == [15, 18, 32]


def test_near_duplicates_of_few_equal_coordinates(spark):
    """Pairs at 0.80 or more whose signatures agree in 15 to 17 of 32 coordinates."""
    rnd, rows = random.Random(8), []
    while len(rows) < 6:
        w = [f"w{rnd.randint(0, 10**9)}" for _ in range(54)]
        v = w[:25] + [f"x{rnd.randint(0, 10**9)}"] + w[26:]
        a, b = (neardup.shingle_set(" ".join(x)) for x in (w, v))
        if 15 <= (neardup.signature(a) == neardup.signature(b)).sum() < 18:
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    df = spark.createDataFrame(rows, "episode_index long, instruction string")
    assert sorted(map(tuple, neardup.near_duplicates(df, percent=80).collect())) == brute_near(rows, 80)
    assert sum(r[3] for r in brute_near(rows, 80)) == 3


def test_a_table_that_overflows_while_it_is_rebuilt(monkeypatch):
    from gaitworks.llm import cuckoo

    monkeypatch.setattr(cuckoo, "KICKS", 0)
    for seed in range(300):
        rnd, index = random.Random(seed), CuckooIndex(1)
        keys = [rnd.randbytes(8) for _ in range(60)]
        for k in keys:
            index.add([k])
        assert sorted(e[0] for e in index.entries if e is not None) == sorted(keys) and index.n == 60
        assert all(index.remove(k) and index.find(k) is None for k in keys)
