import collections
import re

import numpy as np
import pytest

import corpus_pipeline as P
from gaitworks.llm import mixing, quality, queries

from .test_dedup import brute_near

D = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.select(*P.COLUMNS).collect()]


def test_stages_by_hand(spark, vocabulary):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert [f for _, f in P.STAGES] == [P.quality_filter, P.exact_dedup, P.near_dedup, P.mix_to_targets, P.pack]
    given = rows_of(docs)

    one = P.quality_filter(spark, docs, D).cache()
    model = quality.fit(queries.episodes(docs), queries.good_labels(spark, D))
    score = lambda t: 1 / (1 + np.exp(-(model.offset + model.logit[quality.features(t)].mean(dtype=np.float64))))
    assert sorted(rows_of(one)) == sorted(r for r in given if score(r[1]) >= 0.7)
    assert 0.5 * len(given) < one.count() < len(given)

    two = P.exact_dedup(spark, one, D).cache()
    first = {}
    for r in sorted(rows_of(one)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    assert sorted(rows_of(two)) == sorted(first.values())

    three = P.near_dedup(spark, two, D).cache()
    texts = [(r[0], r[1]) for r in rows_of(two)]
    kept = {i for i, _, _, k in brute_near(texts, 80) if k}
    assert sorted(rows_of(three)) == sorted(r for r in rows_of(two) if r[0] in kept)

    four = P.mix_to_targets(spark, three, D).cache()
    target = {r.source_dataset: r.target for r in mixing.mix_sources(queries.episodes(three)).collect()}
    times, words, longest = collections.Counter(r[0] for r in rows_of(four)), collections.Counter(), collections.Counter()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in rows_of(four):
        words[r[3]] += size(r[1])
        longest[r[3]] = max(longest[r[3]], size(r[1]))
    assert set(rows_of(four)) <= set(rows_of(three)) and max(times.values()) <= 2
    assert all(abs(words[s] - t) <= max(longest[s], max(size(r[1]) for r in rows_of(three) if r[3] == s)) for s, t in target.items())

    five = P.pack(spark, four, D).collect()
    whole = {}
    for r in five:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    tokens = {r.doc_id: r.doc_tokens for r in five}
    assert whole == {i: tokens[i] * times[i] for i in times}


def test_run_is_the_stages_in_order(spark):
    rows = P.run(spark, D).collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(rows[0].asDict())
    filled = collections.Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert sorted(filled) == list(range(len(filled))) and all(n == 2048 for s, n in filled.items() if s < max(filled))


@pytest.mark.parametrize("keep", [0, 1])
def test_stages_take_odd_and_no_rows(spark, keep):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, "a  b c", "en", None, 6), (3, "a  b c", "en", None, 6), (4, "x " * 5000, "en", "t", 10000)]
    docs = spark.createDataFrame(rows if keep else [], schema)
    for stage in (P.quality_filter, P.exact_dedup, P.near_dedup, P.mix_to_targets):
        out = stage(spark, docs, D)
        assert out.columns == list(P.COLUMNS)
        found = rows_of(out)
        assert set(found) <= set(rows) and (keep or not found)
    if keep:
        # equal texts: the smallest doc_id, once; null and "" are equal texts
        assert sorted(rows_of(P.exact_dedup(spark, docs, D)), key=repr) == sorted([rows[0], rows[3], rows[5]], key=repr)
    packed = P.pack(spark, docs, D).collect()
    assert {r.doc_id for r in packed} == {r[0] for r in rows if keep}


def test_whole_documents_meet_the_targets(spark):
    # documents of many blocks: all of a source lie close to one ratio of taken to size
    rows = [(i, " ".join(f"w{k}" for k in range(400 + i % 7)), "en", ["a", "b", None][min(i % 8, 2)], i) for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()
    target = {r.source_dataset: r.target for r in mixing.mix_sources(queries.episodes(docs)).collect()}
    out = rows_of(P.mix_to_targets(spark, docs, D))
    words, times = collections.Counter(), collections.Counter(r[0] for r in out)
    for r in out:
        words[r[3]] += len(r[1].split())
    assert set(out) <= set(rows) and max(times.values()) <= 2 and set(target) == {"a", "b", None}
    for s, t in target.items():
        assert abs(words[s] - t) <= 203, (s, words[s], t)
    assert sorted(rows_of(P.mix_to_targets(spark, docs.repartition(5), D)), key=repr) == sorted(out, key=repr)


def test_near_dedup_from_80_percent(spark):
    w = [f"w{k}" for k in range(54)]
    texts = [w, w[:25] + ["x"] + w[26:], w[:20] + ["x"] + w[21:35] + ["y"] + w[36:]]  # 0.82 and 0.67 to the first
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r[0] for r in rows_of(P.near_dedup(spark, docs, D))) == [0, 2]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_share_an_id_are_judged_apart(spark):
    rows = [(3, "b b", "en", "s", 3), (5, "a a", "en", "s", 3), (5, "b b", "en", "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(rows_of(P.exact_dedup(spark, docs, D))) == rows[:2]
    w = [f"w{k}" for k in range(60)]
    near = [(3, " ".join(w), "en", "s", 1), (5, "all other words are in this one", "en", "s", 1), (5, " ".join(w[:-1] + ["x"]), "en", "s", 1)]
    assert sorted(rows_of(P.near_dedup(spark, spark.createDataFrame(near, SCHEMA), D))) == near[:2]


def test_stages_leave_clashing_columns_behind(spark):
    rows = [(i, "pick the cup " * (1 + i % 3) + f"w{i}" + " long" * 40_000 * (i == 7), "en", "s", i, "x", "y") for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA + ", episode_index string, digest string").selectExpr("*", "'z' as row_no", "'z' as times", "'z' as kept", "'z' as score", "'z' as size")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == list(P.COLUMNS) and set(rows_of(out)) <= {r[:5] for r in rows}
    assert {r.doc_id for r in P.pack(spark, docs, D).collect()} == set(range(12))
