import hashlib
import random
import re

import numpy as np
import pytest

from gaitworks.llm import licences, pii, quality, topk

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_exact_patterns_against_plain_ones():
    rnd = random.Random(2)
    parts = ["1", "22", "255", "256", ".", "..", "@", "a", "B-", "+", "+1", " ", "(", ")", "-", "é", "4111111111111111", "4111 1111-1111 1111", "x@y.z", "1.2.3.4", "%", "+1 (555) 123-4567", "\n"]
    for _ in range(6000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert sorted(pii.base_spans(t)) == brute_spans(t), repr(t)


def test_contexts_find_unseen_identifiers(spark, none):
    rows = [(i, f"hello call me at +1 (555) 123-45{i:02d} today please {i}", "s") for i in range(30)]
    rows += [(100 + i, f"so call me at 555 987-65{i:02d} today please", "s") for i in range(3)]
    rows += [(200, "an order of 5559876599 parts", "s"), (201, None, "s"), (202, "", None), (None, "mail a@b.cc", "s"), (203, "é call me at 555 987-6599 today", "s"), (203, "x", "s")]
    df = spark.createDataFrame(rows, "episode_index long, instruction string, k string")
    found = pii.find_pii(df).collect()
    assert len(found) == len(rows)
    got = {(r.episode_index, r.base_spans): r for r in found}
    text = {r[0]: r[1] for r in rows if r[0] != 203}
    for (e, base), r in got.items():
        assert set(filter(None, base.split(","))) <= set(r.spans.split(",")) | {""}
        if e is not None and 100 <= e < 200:
            s = text[e].index("555")
            assert base == "" and r.spans == f"phone:{s}:{s + 12}" and r.n_phone == 0
        if e == 200:  # known from another place
            assert r.spans == "phone:12:22"
    assert got[(None, "email:5:11")].n_email == 1
    assert pii.find_pii(none).count() == 0


def test_clean_contexts_add_nothing(spark):
    df = spark.createDataFrame([(i, f"part number 12345678{i} is in box {i}, mail {'ab'[i % 2]}{i}@x.org now") for i in range(20)], "episode_index long, instruction string")
    for r in pii.find_pii(df).collect():
        assert r.spans == r.base_spans


def brute_base(text):
    t = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found = [(k, label) for phrase, label in licences.BASE.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(k for k, _ in found), ",".join(sorted({x for _, x in found}))


def test_licences(spark, odd, none):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "MIT-licensed; see the MIT License. mit LICENSE", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "the general public licence", "by 4 nc cc 0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "general public license " * 40, "ümit license",
    ]
    df = odd.select("episode_index", "instruction", "score").unionByName(spark.createDataFrame([(50 + i, t, "x") for i, t in enumerate(texts)], "episode_index long, instruction string, score string"))
    rows = licences.scan_licences(df).collect()
    want = sorted((r.episode_index, *brute_base(r.instruction)) for r in df.collect() if r.episode_index is not None)
    got = sorted((r.episode_index, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows if r.episode_index is not None)
    assert [(e, n, len(p), p[0] if p else None, p[-1] if p else None, b) for e, n, p, b in want] == got
    labels = {r.episode_index: r.labels for r in rows}
    assert [labels[50 + i] for i in range(9)] == ["apache,apache-2.0", "mit", "gpl,gpl-3.0", "cc-by-nc-4.0", "", "", "mit", "gpl", ""]
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert licences.scan_licences(none).count() == 0


def brute_top(frames, queries, k):
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    to_int = lambda v: [int(np.floor(1024 * float(x))) for x in v]
    out = []
    for q, v in queries:
        if fine(v):
            scored = sorted((-sum(a * b for a, b in zip(to_int(v), to_int(w))), i) for i, w in frames if fine(w) and i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block,query_block", [(16_384, 512), (40, 3)])
def test_top_k_against_brute_force(spark, block, query_block):
    rng = np.random.default_rng(4)
    frames = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    frames += [(300 + i, [0.5, -0.25, 0.0, 0.0, 1.0, 0.0]) for i in range(30)]  # ties
    frames += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [1.0]), (405, []), (406, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in frames], "index long, states array<double>, b int")
    asked = [f for f in frames if f[0] % 10 == 0 or f[0] > 403]
    got = topk.top_k(df, df.where("index % 10 = 0 or index > 403"), 10, block=block, query_block=query_block).collect()
    assert sorted(map(tuple, got)) == brute_top(frames, asked, 10)
    assert topk.top_k(df.limit(0), df, 10).count() == 0 and topk.top_k(df, df.limit(0), 10).count() == 0


@pytest.mark.parametrize("kind", [np.int64, np.float64])
def test_threshold_search_stops_early(kind):
    rng = np.random.default_rng(1)
    base = rng.integers(-50, 50, (5000, 3)).astype(kind)
    base[:20] += 1000
    lists = np.argsort(base, axis=0, kind="stable").T
    scored = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            scored.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    for query in ([2, 3, 1], [2, 0, 1], [-3, 1, 0]):
        query = np.array(query, kind)
        rows, scores = topk.threshold_search(base.view(Counted), np.arange(5000), lists, query, -1, 10)
        want = sorted(zip((-(base @ query)).tolist(), range(5000)))[:10]
        assert [(-s, r) for s, r in zip(np.asarray(scores).tolist(), rows.tolist())] == want
    assert scored[0] + scored[1] < 1000


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**29 + i), float(2**30 - 3 * i)]) for i in range(50)]
    df = spark.createDataFrame(rows, "index long, states array<double>")
    got = topk.top_k(df, df.where("index < 3"), 10, scale=1).collect()
    want = []
    for q in range(3):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(rows[q][1], v)), i) for i, v in rows if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == want


def test_features_are_those_of_a_plain_loop():
    a, b = quality.features("ab  cd\nab ab"), quality.features(" ab cd ab\tab ")
    assert sorted(a.tolist()) == sorted(b.tolist())
    assert len(quality.features("")) == len(quality.features(None)) == len(quality.features(" \n"))
    # 2-grams: " a" "ab" "b "; 3-grams: " ab" "ab "; 4-grams: " ab "; the word
    assert len(quality.features("ab")) == 7


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id as episode_index", "text as instruction", "n_chars as score", "lang")
    labels = spark.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id as episode_index", "quality as good", "toxic as instruction")
    scored = quality.score_quality(docs, quality.fit(docs, labels)).join(labels, "episode_index").where("held_out").toPandas()
    right = (scored["predicted"] == scored["good"])
    assert len(scored) > 50 and right.mean() >= 0.97 and right[scored["good"] == 1].mean() >= 0.98
    assert all(not quality.learnable(i) for i in scored["episode_index"])


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (4, 0), (5, None), (None, 1), (0, 1)], "episode_index long, good int")
    for model in (quality.fit(odd, labels), quality.fit(none, labels), quality.fit(odd, labels.limit(0))):
        rows = quality.score_quality(odd, model, keep=("instruction",)).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
        assert quality.score_quality(none, model).count() == 0
    assert hashlib.md5(quality.fit(odd, labels).logit.tobytes()).digest() == hashlib.md5(quality.fit(odd.repartition(3), labels).logit.tobytes()).digest()


def test_other_spellings_of_exact_matches(spark):
    rows = [(0, "call me at +1 555 123 4567 today"), (1, "call me at 1 555 123 4567 today"), (2, "+1 555 123 9999"), (3, "15551239999"),
            (4, "card 4111 1111 1111 1111 ok"), (5, "the card 4111.1111.1111.1111 ok"), (6, "call me at 1 555 123 0000 today")]
    df = spark.createDataFrame(rows, "episode_index long, instruction string")
    got = {r.episode_index: (r.base_spans, r.spans) for r in pii.find_pii(df).collect()}
    assert got[1] == ("", "phone:11:25") and got[3] == ("", "phone:0:11") and got[5] == ("", "card:9:28")
    assert got[6] == ("", "") and all(got[i][0] == got[i][1] for i in (0, 2, 4))
