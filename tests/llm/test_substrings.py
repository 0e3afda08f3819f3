import random
import re

import numpy as np
import pytest

from gaitworks.llm import substrings
from gaitworks.llm.neardup import shingle_set

def word_shingle(words):
    """The hash of five words, from the shared shingle function on exactly those words."""
    return int(shingle_set(" ".join(words))[0])


def plain_paragraphs(text):
    """(number, start, end, shingle set) by loops over words."""
    w = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    low = [re.sub("[A-Z]", lambda c: c[0].lower(), x[2]) for x in w]
    v = [word_shingle(low[i:i + 5]) for i in range(len(w) - 4)]
    r = substrings.REACH
    cuts = [0] + [i for i in range(r, len(v) - r) if all(v[i] < x for x in v[i - r:i]) and all(v[i] <= x for x in v[i + 1:i + r + 1])]
    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(w)])):
        if b - a >= 5:
            yield k, w[a][0], w[b - 1][1], {v[i] for i in range(a, b - 4)}


def brute(rows):
    found = [(e, k, a, b, s) for e, t in rows for k, a, b, s in plain_paragraphs(t)]
    root = list(range(len(found)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, x in enumerate(found):
        for g in x[4]:
            by.setdefault(g, []).append(i)
    for i, x in enumerate(found):
        for j in {j for g in x[4] for j in by[g] if j < i}:
            both = len(x[4] & found[j][4])
            if 100 * both >= 80 * len(x[4] | found[j][4]):
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(found)):
        groups.setdefault(top(i), []).append(found[i])
    out = []
    for g in groups.values():
        if len(g) > 1:
            f = min(g, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            out += [(e, k, a, b, f[0], f[1], (e, k) == f[:2]) for e, k, a, b, _ in g]
    return sorted(out, key=repr)


def test_paragraphs_against_loops():
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["w%d" % rnd.randint(0, 60), "É", "東京", "Ab", "x\n"]) + rnd.choice(["", " ", "\t\n"]) for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    texts += ["", "one two", "a " * 50, " \n lead and trail \n", "a b c d e"]
    p = substrings.Paragraphs([t.encode() for t in texts])
    got = [(int(d), int(k), int(a), int(b), set(p.set_of(i).tolist())) for i, (d, k, a, b) in enumerate(zip(p.doc, p.number, p.start, p.end))]
    assert got == [(d, k, a, b, s) for d, t in enumerate(texts) for k, a, b, s in plain_paragraphs(t)]
    assert len(substrings.Paragraphs([b""]).doc) == 0 and substrings.Paragraphs([b""]).keys().size == 0


@pytest.mark.parametrize("members", [4096, 3])
def test_passages_against_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(substrings, "MEMBERS", members)
    rnd = random.Random(3)
    line = lambda n: " ".join(f"w{rnd.randint(0, 900)}" for _ in range(n))
    common, rows = line(60), []
    for i in range(60):
        near = common.split()
        for _ in range(rnd.randint(0, 2)):
            near[rnd.randint(0, 59)] = f"x{rnd.randint(0, 3)}"
        rows.append((i, "\n".join([line(30), line(4), " ".join(near) if i % 2 else common.upper(), "é " + line(25)])))
    rows += [(100, rows[0][1]), (None, rows[1][1]), (101, None), (102, ""), (103, line(3000)), (3, "other text " + common), (3, "other text " + common)]
    df = spark.createDataFrame(rows, "episode_index long, instruction string")
    got, want = [tuple(r) for r in substrings.repeated_passages(df).collect()], brute(rows)
    place = lambda rs: sorted((r[:4] for r in rs), key=repr)
    assert len(place(got)) >= 0.99 * len(want) and set(place(got)) <= set(place(want))
    wide = {r[:4]: r[4:6] for r in want}
    assert sum(wide[r[:4]] != r[4:6] for r in got) <= 0.01 * len(got)
    assert sum(r[6] for r in got) == len({r[4:6] for r in got})


def test_a_passage_is_found_whatever_surrounds_it(spark):
    """Twice inside longer lines, twice as four short lines, the last two texts equal."""
    rnd = random.Random(11)
    some = lambda n: [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
    passage = some(60)
    broken = "\n".join(" ".join(passage[i:i + 15]) for i in range(0, 60, 15))
    rows = [(1, " ".join(some(40) + passage + some(33))), (2, " ".join(some(21) + passage + some(50))), (3, broken), (4, broken), (5, " ".join(some(200)))]
    got = substrings.repeated_passages(spark.createDataFrame(rows, "episode_index long, instruction string")).collect()
    assert {r.episode_index for r in got} == {1, 2, 3, 4}
    places = {}
    for r in got:
        places.setdefault((r.component_index, r.component_paragraph), set()).add(r.episode_index)
    assert all(len(p) > 1 for p in places.values()) and any({1, 2} <= p for p in places.values()) and any(p & {1, 2} and p & {3, 4} for p in places.values())
    text = dict(rows)
    assert all(len(set(text[r.episode_index][r.start:r.end].split()) - set(passage)) <= 2 for r in got)  # 0.8 allows a little beyond


def test_recall_of_fifty_word_windows(spark):
    rnd = random.Random(5)
    some = lambda n: [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
    rows, pairs = [], 300
    for k in range(pairs):
        passage = some(51)
        rows += [(2 * k, " ".join(some(rnd.randint(0, 60)) + passage + some(rnd.randint(0, 60)))), (2 * k + 1, "\n".join(some(rnd.randint(0, 60)) + passage + some(rnd.randint(0, 60))))]
    rows += [(10_000 + k, " ".join(some(150))) for k in range(300)]
    got = {r.episode_index for r in substrings.repeated_passages(spark.createDataFrame(rows, "episode_index long, instruction string")).collect()}
    assert sum(2 * k in got and 2 * k + 1 in got for k in range(pairs)) >= 0.9 * pairs
    assert not any(e >= 10_000 for e in got)


def test_odd_and_no_rows(spark, odd, none):
    got = substrings.repeated_passages(odd).collect()  # only the long text, which repeats 701 words over and over
    assert {r.episode_index for r in got} == {6} and len({(r.component_index, r.component_paragraph) for r in got}) < 60
    assert substrings.repeated_passages(none).count() == 0


def test_bands_reach_the_recall():
    bands, rows = substrings.choose_bands(0.8)
    assert (1 - 0.8**rows) ** bands <= 0.05 < (1 - 0.8**rows) ** (bands - 1) and bands * rows <= 256


def test_packed_bands_are_read_as_they_were(spark):
    rnd = np.random.default_rng(4)
    for n in (1, 3, 5):
        bands = [rnd.integers(0, 1 << 64, 50, dtype=np.uint64) for _ in range(n)]
        words = substrings.packed_bands(bands)
        assert len(words) * 64 < n * substrings.BITS + 64
        names = [f"w{k}" for k in range(len(words))]
        df = spark.createDataFrame([tuple(int(x) for x in r) for r in zip(*[w.view(np.int64) for w in words])], ", ".join(f"{c} long" for c in names))
        got = df.select(*[substrings.band_of(names, b).alias(f"b{b}") for b in range(n)]).collect()
        assert sorted(tuple(r) for r in got) == sorted(tuple(int(x) >> 64 - substrings.BITS for x in r) for r in zip(*bands))


def test_scratch_and_shuffles_stay_near_the_input(spark):
    """Bytes shuffled over texts that share one passage, against their own."""
    rnd = random.Random(13)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 10))) for _ in range(3000)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    common = some(60)
    rows = [(i, " ".join([some(rnd.randint(100, 500)), common if i % 2 else "", some(100)])) for i in range(4000)]
    df = spark.createDataFrame(rows, "episode_index long, instruction string").repartition(4)
    store = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: store.executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    assert substrings.repeated_passages(df).count() >= 4000
    assert shuffled() - before < 2.25 * sum(len(t) for _, t in rows)
