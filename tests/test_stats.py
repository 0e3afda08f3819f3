import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitworks.functions import embodiment, hashing
from gaitworks.functions import projections as P
from gaitworks.functions import vectors as V
from gaitworks.operators import normalise as N
from gaitworks.operators import sampling, scoring
from gaitworks.operators import stats as S


@pytest.mark.parametrize("accuracy", [50, 100_000])
def test_exact_quantiles_on_skewed_values(spark, accuracy):
    """Coarse sketches widen the brackets, the answer stays exact."""
    rng = np.random.default_rng(1)
    data = {0: rng.normal(size=3001), 1: np.where(rng.random(2000) < 0.93, 0.0, rng.normal(size=2000)), 2: np.array([4.0]), 3: np.arange(7.0)}
    rows = [(d, float(x)) for d, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "dim int, value double").repartition(4)
    probs = [0.01, 0.25, 0.5, 0.99]
    got = S.full_stats(df, ["dim"], probs, ["a", "b", "c", "d"], accuracy=accuracy).collect()
    assert len(got) == 4
    for r in got:
        xs = data[r.dim]
        np.testing.assert_allclose([r.a, r.b, r.c, r.d], np.quantile(xs, probs), rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose([r["mean"], r.std], [xs.mean(), xs.std()], rtol=1e-9, atol=1e-12)


def test_masked_quantile_ignores_zero_fill(spark):
    rows = [("neck" if i % 14 == 0 else "plain", float(i % 100) if i % 14 == 0 else 0.0) for i in range(1400)]
    df = spark.createDataFrame(rows, "body string, value double")
    real = [v for b, v in rows if b == "neck"]
    got = S.full_stats(df.where("body = 'neck'").withColumn("dim", F.lit(0)), ["dim"]).first()
    np.testing.assert_allclose([got.q01, got.q99], np.quantile(real, [0.01, 0.99]))


def test_partial_merge_equals_direct(spark):
    df = spark.createDataFrame([(i % 5, float(i * i % 17)) for i in range(200)], "part int, value double").withColumn("dim", F.lit(0))
    merged = S.merge_partials(S.partial_moments(df, ["part", "dim"]), ["dim"]).first()
    xs = np.array([float(i * i % 17) for i in range(200)])
    np.testing.assert_allclose([merged["mean"], merged.std, merged["min"], merged["max"]], [xs.mean(), xs.std(), xs.min(), xs.max()])
    dead = S.merge_partials(S.partial_moments(df, ["dim"], valid=F.lit(False)), ["dim"]).first()
    assert (dead["count"], dead["mean"], dead.std, dead["min"], dead["max"]) == (0, 0.0, 0.0, 0.0, 0.0)


def test_midpoint_normalises_to_zero(spark):
    df = spark.createDataFrame([([1.5, 0.0],)], "v array<double>").withColumns({"min": V.literal([1, -2]), "max": V.literal([2, 2])})
    assert df.select(N.min_max("v").alias("y")).first().y == [0.0, 0.0]


def test_nan_state_becomes_zero(spark):
    df = spark.createDataFrame([([float("nan"), 5.0],)], "v array<double>").withColumns({"lo": V.literal([0, 0]), "hi": V.literal([1, 1])})
    assert df.select(N.tolerant("v", "lo", "hi", False).alias("y")).first().y == [0.0, 1.0]


def test_grasp_known_answers(spark):
    lo, hi = V.literal([0] * 7), V.literal([0.1] * 3 + [1.7] * 4)
    df = spark.createDataFrame([(o / 10,) for o in range(11)], "o double")
    for invert in (False, True):
        back = P.openness(P.hand_from_openness(F.col("o"), lo, hi, invert=invert), lo, hi, invert=invert)
        for r in df.select("o", back.alias("b")).collect():
            assert r.b == pytest.approx(r.o)
    ends = df.limit(1).select(P.openness(hi, lo, hi).alias("a"), P.openness(V.literal([9] * 7), lo, hi).alias("b"), P.openness(V.literal([-9] * 7), lo, hi).alias("c")).first()
    assert tuple(ends) == (1.0, 1.0, 0.0)


def test_unknown_body_and_width_are_errors(spark):
    df = spark.createDataFrame([("g1", [0.0] * 42)], "body string, v array<double>")
    with pytest.raises(Exception, match="width 42"):
        df.select(embodiment.canonical(F.col("v"), F.col("body"), embodiment.STATE_SLOTS, 45)).collect()


def test_permutation_errors():
    with pytest.raises(ValueError):
        P.permutation(["a", "b"], ["a", "c"])
    with pytest.raises(ValueError):
        P.permutation(["a", "a"], ["a", "a"])
    with pytest.raises(ValueError):
        P.recorded_order([(0, 3)], 5)


def test_draw_is_portable(spark):
    row = spark.range(1).select(F.conv(F.substring(F.sha2(F.lit("a"), 256), 1, 8), 16, 10).cast("bigint").alias("h")).first()
    assert row.h == 3398926610
    assert spark.range(1).select(hashing.key("s", F.lit(1), F.lit(2)).alias("k")).first().k == "s-1-2"


def test_token_batches_share_dataset_and_differ_by_rank(spark):
    ds = spark.createDataFrame([(0, 1, 100_000, 540), (1, 1, 100_000, 320)], "dataset long, weight int, length long, tokens int")
    batches = spark.range(8).withColumnRenamed("id", "batch")
    runs = [sampling.token_batches(batches, "batch", ds, 8640, 4, "t", epoch=e).collect() for e in (0, 0, 1)]
    assert sorted(runs[0]) == sorted(runs[1])
    by = {}
    for r in runs[0]:
        by.setdefault(r.batch, []).append(r)
    for rows in by.values():
        assert len({(r.dataset, r.batch_size) for r in rows}) == 1
        assert len(rows) == 4 * rows[0].batch_size
        assert rows[0].batch_size == (16 if rows[0].dataset == 0 else 27)
        samples = {rank: tuple(r.local_index for r in sorted(rows, key=lambda r: r.slot) if r.rank == rank) for rank in range(4)}
        assert len(set(samples.values())) == 4
    first, later = ({(r.batch, r.rank, r.slot, r.local_index) for r in x} for x in (runs[0], runs[2]))
    assert len(first & later) < 3


def test_repack_rejects_duplicates(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        P.rename_by_patterns(df, {"a": "c", "b": "c"})
    with pytest.raises(ValueError):
        P.repack(df, {"x": "a", "x/y": "b"})


def test_frechet_against_whole_matrix_roots(spark):
    rng = np.random.default_rng(8)
    n, groups = 5, {"wide": (40, 40), "flat": (3, 3), "one": (1, 1), "same": (30, 30)}
    rows, data = [], {}
    for name, (steps, _) in groups.items():
        x = rng.normal(size=(steps, n)) @ rng.normal(size=(n, n))
        y = x if name == "same" else rng.normal(size=(steps, n)) @ rng.normal(size=(n, n)) + 1
        data[name] = x, y
        rows += [(name, *map(float, a), *map(float, b)) for a, b in zip(x, y)]
    rows.append(("wide", None, *[1.0] * (2 * n - 1)))
    p, t = [f"p{i}" for i in range(n)], [f"t{i}" for i in range(n)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in p + t))

    def root(m, eps):
        w, v = np.linalg.eigh(m)
        return v @ np.diag(np.sqrt(np.maximum(w, eps))) @ v.T

    eps = 1e-6
    got = {r.g: r for r in scoring.frechet_distance(df, ["g"], p, t, eps).collect()}
    for name, (x, y) in data.items():
        a, b = (np.cov(z.T) if len(z) > 1 else np.zeros((n, n)) for z in (x, y))
        a, b = a + eps * np.eye(n), b + eps * np.eye(n)
        s = root(b, eps)
        want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * np.trace(root(s @ a @ s, eps))
        assert got[name].steps == len(x)
        assert got[name].frechet == pytest.approx(max(want, 0), rel=1e-6, abs=1e-6)
    assert scoring.frechet_distance(df.limit(0), ["g"], p, t).count() == 0


def test_eigenvalues_of_equal_and_zero_matrices(spark):
    rng = np.random.default_rng(9)
    ms = [np.zeros((4, 4)), np.eye(4) * 3, np.diag([1e8, 1.0, 1e-8, 0.0])] + [(lambda b: b @ b.T)(rng.normal(size=(4, 4))) for _ in range(20)]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(ms)], "i int, m array<array<double>>")
    for r in df.select("i", scoring.symmetric_eigenvalues(F.col("m"), 4).alias("e")).collect():
        np.testing.assert_allclose(sorted(r.e), np.linalg.eigvalsh(ms[r.i]), rtol=1e-10, atol=1e-9 * np.abs(ms[r.i]).max())


@pytest.mark.parametrize("few_groups", [True, False])
def test_quantiles_when_every_pass_meets_the_rows_in_another_order(spark, many_parts, few_groups):
    """As on a cluster, where the parts of a sketch arrive in any order."""
    def dealt(parts):
        rng = np.random.default_rng()  # a new seed each time
        for pdf in parts:
            yield pdf.assign(part=rng.integers(0, 1000, len(pdf)))

    xs = np.random.default_rng(3).lognormal(size=40_000)
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(xs)], "dim int, value double")
    df = df.mapInPandas(dealt, "dim int, value double, part long").repartition(8, "part").drop("part")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = S.full_stats(df, ["dim"], [0.1, 0.5, 0.9], ["a", "b", "c"], accuracy=400, few_groups=few_groups).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    for r in got:
        np.testing.assert_allclose([r.a, r.b, r.c], np.quantile(xs[r.dim::2], [0.1, 0.5, 0.9]), rtol=1e-12)


def test_chunk_report_shuffles_no_frames(spark):
    """Levels by hand, a null error left out; the frame level needs no exchange."""
    rows = [(0, 0, [1.0, 3.0], [2.0, None]), (0, 1, [5.0, 7.0], [4.0, 0.0])]
    t = scoring.chunk_report(spark.createDataFrame(rows, "e long, f long, arm array<double>, leg array<double>"), ["e", "f"], ["arm", "leg"])
    got = {(r.level, r.f, r.modality, r.step): (r.l1, r.first_step_l1) for r in t.collect()}
    assert got == {
        ("frame", 0, "arm", None): (2.0, 1.0), ("frame", 0, "leg", None): (2.0, 2.0), ("frame", 1, "arm", None): (6.0, 5.0), ("frame", 1, "leg", None): (2.0, 4.0),
        ("modality", None, "arm", None): (4.0, 3.0), ("modality", None, "leg", None): (2.0, 3.0), ("step", None, None, 0): (3.0, 3.0),
        ("step", None, None, 1): (pytest.approx(10 / 3), None), ("all", None, None, None): (pytest.approx(22 / 7), 3.0)}
    assert t.where("level = 'frame'")._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1


def test_grouped_stats_of_small_large_and_null_groups(spark, monkeypatch):
    """Both ways beside numpy: one group above the limit, a null key, null and NaN elements, a dimension without a value."""
    monkeypatch.setattr(S.ordering, "BLOCK", 50)
    rng = np.random.default_rng(4)
    data = {k: rng.normal(size=(n, 2)) for k, n in {"large": 400, "small": 9, "one": 1, None: 30}.items()}
    rows = [(k, [float(x), float(y), None]) for k, xs in data.items() for x, y in xs] + [("small", [None, float("nan"), None])]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(4)
    got = {(r.g, r.dim): r for r in S.grouped_stats(df, "v", ["g"], [0.25, 0.9], ["a", "b"]).collect()}
    assert len(got) == 12
    for k, xs in data.items():
        for dim in (0, 1):
            r, x = got[k, dim], xs[:, dim]
            assert r["count"] == len(x)
            np.testing.assert_allclose([r.a, r.b, r["mean"], r.std, r["min"], r["max"]], [*np.quantile(x, [0.25, 0.9]), x.mean(), x.std(), x.min(), x.max()], rtol=1e-9, atol=1e-12)
        assert tuple(got[k, 2])[2:] == (0, None, None, None, None, None, None)


def test_pooled_stats_sketches_no_small_group(spark, monkeypatch):
    """Nothing is written per small group; the sketch of one is wider than its values."""
    import __spark_entry__ as entry
    from conftest import SF
    from gaitworks import session

    written = []

    def stored(df, name):
        t = session.stored(df, name)
        written.append((name, t.count()))
        return t

    for module in (S, S.ordering):
        monkeypatch.setattr(module, "stored", stored)
    assert entry.queries()["pooled_stats"](spark, SF).count() == 4
    assert sum(n for _, n in written) == 0, written
