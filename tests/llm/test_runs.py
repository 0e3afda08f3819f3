"""Periodic runs against plain scans over every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaitworks.llm import queries, runs


def brute_runs(w):
    """(start, end, period), by comparing each word with the one q before it."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)
            i = max(i, s + 1) if i == s else i
    return sorted((s, e, q) for (s, e), q in out.items())


def brute(index, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    drop = {i for s, e, q in found for i in range(s + q, e)}
    told = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (index, len(found), *four, sha(told), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda t: tuple((x is None, x) for x in t))


part = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 6)).map(lambda p: p[0] * p[1] + p[0][:p[2]])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(part, max_size=5).map(lambda ps: [x for p in ps for x in p]), max_size=4))
def test_runs_of_many_documents(docs):
    flat, n = np.array([x for d in docs for x in d], np.int64), [len(d) for d in docs]
    start, end, q = runs.runs(flat, np.repeat(np.arange(len(n)), n))
    base = np.cumsum([0, *n])
    got = sorted(zip(start.tolist(), end.tolist(), q.tolist()))
    assert got == sorted((s + b, e + b, p) for d, b in zip(docs, base.tolist()) for s, e, p in brute_runs(d))


def test_wavelet_tree_successors():
    rnd = random.Random(4)
    values = np.array([rnd.randrange(60) for _ in range(200)])
    tree = runs.WaveletTree(values)
    asked = [(lo := rnd.randrange(200), rnd.randint(lo, 200), rnd.randrange(150)) for _ in range(500)]
    got = tree.successor(*(np.array(c) for c in zip(*asked)))
    assert got.tolist() == [min((int(v) for v in values[lo:hi] if v >= x), default=-1) for lo, hi, x in asked]


def test_suffix_order():
    words, doc = np.array([0, 1, 0, 1, 0, 0, 1, 0]), np.array([0, 0, 0, 0, 0, 1, 1, 1])
    sa = runs.SuffixOrder(words, doc)
    spans = [words[i:5].tolist() if i < 5 else words[i:].tolist() for i in range(8)]
    for i in range(8):
        for j in range(i + 1, 8):
            want = next((k for k, (a, b) in enumerate(zip(spans[i], spans[j])) if a != b), min(len(spans[i]), len(spans[j]))) if doc[i] == doc[j] else 0
            assert sa.ahead(np.array([i]), np.array([j]))[0] == want


def looped(index, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(index).encode()), len(w)
    if index is None or h % 10 or not n:
        return text
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_periodic_runs"](spark, d)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = ordered(brute(i, looped(i, t)) for i, t in rows)
    assert ordered(got.collect()) == want and any(r[1] for r in want)


def test_odd_rows(spark, odd, none):
    assert runs.periodic_runs(none).count() == 0
    rows = [tuple(r) for r in odd.select("episode_index", "instruction").collect()]
    got = ordered(r[:1] + r[2:] for r in map(tuple, runs.periodic_runs(odd).collect()))
    quick = [r for r in rows if r[0] != 6]
    assert [g for g in got if g[0] != 6] == ordered(brute(*r) for r in quick)
    six = next(g for g in got if g[0] == 6)
    assert six[1:6] == (1, 0, 30_000, 701, 1000 * 30_000 // 701)
    with pytest.raises(ValueError):
        runs.periodic_runs(none, times=3)
    few = spark.createDataFrame([(1, "a " * 50_000 + "b"), (2, " \x0b\x0c a\x0ba\x0ca a\ra a a ")], "episode_index long, instruction string")
    assert {r.episode_index: (r.n_runs, r.length, r.period) for r in runs.periodic_runs(few).collect()} == {1: (1, 50_000, 1), 2: (1, 7, 1)}
