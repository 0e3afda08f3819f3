import random
from collections import defaultdict

from pyspark.sql import functions as F

from gaitworks.operators import joins, ordering, packs, windows


def groups(df):
    by = defaultdict(list)
    for r in df.collect():
        by[r.episode_index].append(r)
    for g in by.values():
        g.sort(key=lambda r: r.frame_index)
    return by


def parts_of(df):
    """Rows of each partition that a numbering wrote."""
    folder, = {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/ranges-" in f}
    return df.sparkSession.read.parquet(folder).groupBy(F.input_file_name()).count().collect()


def test_row_index_splits_hot_groups(tiny_blocks, skewed):
    got = ordering.row_index(skewed.withColumn("t", F.col("frame_index") * 7 + 3), ["episode_index"], ["t"], "pos")
    assert all(r.pos == r.frame_index for r in got.collect())
    assert len(parts_of(got)) == 4 and max(r[1] for r in parts_of(got)) < 61  # one episode has 61 of 74 rows


def test_row_index_with_ties_nulls_and_outliers(tiny_blocks, spark, skewed):
    t = F.when(F.col("frame_index") == 0, F.lit(-(10**15))).otherwise(F.lit(1))  # all but one are ties
    got = ordering.row_index(skewed.withColumn("t", t), ["episode_index"], ["t", "frame_index"], "pos")
    assert all(r.pos == r.frame_index for r in got.collect())
    rows = [(k, None if k % 3 else 1, None if k % 5 else "x") for k in range(200)]
    got = ordering.row_index(spark.createDataFrame(rows, "k long, a int, b string"), ["a", "b"], [F.desc("k")], "pos").collect()
    for a in (None, 1):
        for b in (None, "x"):
            assert [r.pos for r in sorted((r for r in got if (r.a, r.b) == (a, b)), key=lambda r: -r.k)] == list(range(sum(x[1:] == (a, b) for x in rows)))
    assert ordering.row_index(skewed.limit(0), ["episode_index"], ["frame_index"], "pos").count() == 0


def test_the_input_is_in_the_plan_once(tiny_blocks, spark, skewed):
    """Numberings in a chain do not multiply: each starts from what the one before has written."""
    t = skewed
    for name in ("a", "b", "c"):
        t = ordering.row_index(t, ["episode_index"], ["frame_index"], name)
    assert t._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert all(r.a == r.b == r.c == r.frame_index for r in t.collect())


def test_texts_with_one_beginning_are_split(many_parts, spark):
    texts = spark.range(50_000).select(F.format_string("pick up the object number %06d", (F.col("id") * 7919) % 50_000).alias("text"), "id")
    got = ordering.global_index(texts, ["text"], "g", {"before": F.lit(2)})
    assert len(parts_of(got)) == 4
    assert got.where("g <> cast(right(text, 6) as long) or before <> 2 * g").count() == 0 and got.select("g").distinct().count() == 50_000


def test_global_index(many_parts, skewed):
    got = ordering.global_index(skewed, ["episode_index", "frame_index"], "g", {"s": F.col("x")}).collect()
    got.sort(key=lambda r: (r.episode_index, r.frame_index))
    assert [r.g for r in got] == list(range(len(got)))
    assert [r.s for r in got] == [sum(q.x for q in got[:i]) for i in range(len(got))]
    assert ordering.global_index(skewed.limit(0), ["frame_index"], "g").count() == 0


def test_merge_keeps_frames_without_a_task(many_parts, spark):
    rows = [(e, f, t) for e, ts in ((3, ["b", None]), (1, [None, "a"]), (7, ["b", "b"])) for f, t in enumerate(ts)]
    one = spark.createDataFrame(rows, "episode_index long, frame_index long, task string")
    got = packs.merge_packs({"p": one, "q": one.where("episode_index > 1")}).collect()
    got.sort(key=lambda r: r["index"])
    assert [r["index"] for r in got] == list(range(10)) and [r.episode_index for r in got] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert [(r.task, r.task_index) for r in got] == [(None, 0), ("a", 1), ("b", 2), (None, 0), ("b", 2), ("b", 2), ("b", 2), (None, 0), ("b", 2), ("b", 2)]
    assert [(r.source_dataset, r.source_episode_index) for r in got[::2]] == [("p", 1), ("p", 3), ("p", 7), ("q", 3), ("q", 7)]


def test_chunks_stay_whole_when_hashes_collide(many_parts, spark, monkeypatch):
    from gaitworks.operators import sampling

    draw = sampling.hashing.draw32
    monkeypatch.setattr(sampling.hashing, "draw32", lambda seed, *c: F.lit(5) if seed.endswith("-c") else draw(seed, *c))
    got = sampling.chunk_shuffle(spark.range(20_000), "id", 10_000, "s").orderBy("position").collect()
    assert sum(a.chunk != b.chunk for a, b in zip(got, got[1:])) == 1


def test_running_sum_and_fill(tiny_blocks, skewed):
    t = ordering.running_sum(skewed, F.col("x"), "s")
    t = ordering.running_sum(t, F.col("x"), "before", inclusive=False)
    t = ordering.fill(t, F.col("maybe"), forward="last", backward="next")
    for g in groups(t).values():
        total, last = 0.0, None
        for r in g:
            assert r.before == total
            total += r.x
            assert r.s == total
            last = r.maybe if r.maybe is not None else last
            assert r["last"] == last
        nxt = None
        for r in reversed(g):
            nxt = r.maybe if r.maybe is not None else nxt
            assert r["next"] == nxt


def test_windows_cross_block_edges(tiny_blocks, skewed):
    t = windows.action_chunk(skewed, "v", 4)
    t = windows.delta_window(t, "v", [-3, 0, 2], "w")
    t = windows.done_flag(t)
    t = ordering.with_length(t)
    for g in groups(t).values():
        n = len(g)
        for i, r in enumerate(g):
            assert r.chunk == [g[min(i + k, n - 1)].v for k in range(4)]
            assert r.w == [g[min(max(i + k, 0), n - 1)].v for k in (-3, 0, 2)]
            assert r.is_pad == [not 0 <= i + k < n for k in (-3, 0, 2)]
            assert r.done == (i == n - 1)
            assert r.length == n


def test_observation_history_and_previous(tiny_blocks, skewed):
    t = windows.observation_history(skewed, "v", 2, 2)
    t = windows.previous_or(t, "x", F.lit(-1.0), "prev")
    for g in groups(t).values():
        for i, r in enumerate(g):
            start = max(i - 3, 0)
            picked = [g[k].v for k in range(start, i + 1, 2)]
            assert r.history == [picked[0]] * (2 - len(picked)) + picked
            assert r.prev == (g[i - 1].x if i else -1.0)


def test_global_frame_index(tiny_blocks, skewed):
    got = packs.global_frame_index(skewed.select("episode_index", "frame_index"), "g").collect()
    got.sort(key=lambda r: (r.episode_index, r.frame_index))
    assert [r.g for r in got] == list(range(len(got)))


def test_group_spans(tiny_blocks, skewed):
    spans = packs.group_spans(skewed.select("episode_index", "frame_index", "x"), ["episode_index"], "frame_index", "x").collect()
    for ep, g in groups(skewed).items():
        want, start = [], 0
        for i in range(1, len(g) + 1):
            if i == len(g) or g[i].x != g[start].x:
                want.append((start, i, g[start].x))
                start = i
        assert sorted((s.start, s.end, s.x) for s in spans if s.episode_index == ep) == sorted(want)


def test_nearest_asof(tiny_blocks, spark):
    import random

    rnd = random.Random(3)
    robot = [(e, i, 10.0 + i * 0.033 + rnd.uniform(-0.005, 0.005)) for e in (1, 2) for i in range(30)]
    ik = [(e, j, 10.0 + j * 0.07 + (0.2 if e == 2 else -0.1), 100 * e + j) for e in (1, 2) for j in range(10)]
    left = spark.createDataFrame(robot, "episode_index long, frame_index long, t double")
    right = spark.createDataFrame(ik, "episode_index long, ord long, u double, payload long")
    got = joins.nearest_asof(left, right, ["episode_index"], "t", "u", "ord", ["payload"], 1 / 60)
    for ep, g in groups(got).items():
        own = [r for r in ik if r[0] == ep]
        last = own[0][3] if own[0][2] <= g[0].t else None
        for r in g:
            best = min(own, key=lambda k: (abs(k[2] - r.t), k[1]))
            if abs(best[2] - r.t) <= 1 / 60:
                last = best[3]
            assert r.payload == last


def test_forward_asof_and_spans(tiny_blocks, spark):
    frames = spark.createDataFrame([(1, i) for i in range(23)], "episode_index long, frame_index long")
    marks = spark.createDataFrame([(1, 3, "a"), (1, 11, "b"), (1, 18, "c")], "episode_index long, at long, goal string")
    got = {r.frame_index: r.goal for r in joins.forward_asof(frames, marks, ["episode_index"], "frame_index", "at", "goal", F.lit("end")).collect()}
    assert got == {i: "a" if i <= 3 else "b" if i <= 11 else "c" if i <= 18 else "end" for i in range(23)}
    spans = spark.createDataFrame([(1, 2, 8, 1, "x"), (1, 5, 9, 0, "y")], "episode_index long, a long, z long, o long, text string")
    got = {r.frame_index: r.text for r in joins.first_span(frames, spans, ["episode_index"], "frame_index", "a", "z", "o", "text").collect()}
    assert got == {i: "y" if 5 <= i <= 9 else "x" if 2 <= i <= 8 else "" for i in range(23)}


def test_first_span_against_all_pairs(many_parts, spark, monkeypatch):
    rnd = random.Random(11)
    monkeypatch.setattr(ordering, "BLOCK", 16)
    monkeypatch.setattr(joins, "TOP", 3)
    frames = [(e, i, e * 100 + i) for e in (1, 2, 3) for i in range(-4, 90)] + [(1, 7, 0), (1, 7, 0), (None, 3, 0), (2, None, 0)]
    spans = []
    for _ in range(150):
        a = rnd.randint(-6, 90)
        spans.append((rnd.choice([1, 1, 1, 2]), a, a + rnd.choice([-1, 0, 1, 5, 40, 90]), rnd.randint(0, 60), rnd.choice(["x", "y", None])))
    spans += [(1, None, 4, -9, "no"), (None, 0, 99, -9, "no"), (9, 0, 5, 0, "elsewhere")]
    f = spark.createDataFrame(frames, "episode_index long, frame_index long, text_id long")
    s = spark.createDataFrame(spans, "episode_index long, a long, z long, o long, text string")
    got = joins.first_span(f, s, ["episode_index"], "frame_index", "a", "z", "o", "text")

    def first(e, i):
        open_ = [(o, text is not None, text or "") for k, a, z, o, text in spans if None not in (e, i, k, a, z) and k == e and a <= i <= z]
        return min(open_)[2] if open_ else ""

    rows = sorted(tuple(r) for r in got.where("episode_index is not null and frame_index is not null").collect())
    assert rows == sorted((e, i, t, first(e, i)) for e, i, t in frames if e is not None and i is not None)
    assert got.where("episode_index is null or frame_index is null").select("text").collect() == [("",), ("",)]
    assert {r.text for r in joins.first_span(f, s.limit(0), ["episode_index"], "frame_index", "a", "z", "o", "text").collect()} == {""}


def test_a_frame_under_many_spans_is_one_row(spark):
    f = spark.range(2000).selectExpr("1L episode_index", "id frame_index")
    s = spark.range(10_000).selectExpr("1L episode_index", "id % 7 a", "2000 + id % 5 z", "10000 - id o", "cast(id as string) text")
    got = joins.first_span(f, s, ["episode_index"], "frame_index", "a", "z", "o", "text")
    seen = []

    def walk(node):
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined() and "Join" in node.nodeName():
            seen.append(rows.get().value())
        kids = [node.finalPhysicalPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        children = node.children()
        for kid in kids + [children.apply(i) for i in range(children.size())]:
            walk(kid)

    assert {r.text for r in got.where("frame_index > 6").collect()} == {"9999"}
    df = got
    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    assert seen and max(seen) < 3000


def test_small_groups_are_shuffled_as_rows_and_large_ones_as_partial_aggregates(spark, skewed):
    from pyspark.sql import functions as F

    from gaitworks.operators import ordering

    made = lambda r: r.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))
    got = ordering.per_group(skewed, ["episode_index"], made, most=8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [episode_index" in plan and "LeftAnti" in plan and "LeftSemi" in plan
    assert sorted(got.collect()) == sorted(made(skewed).collect()) and got.count() == 4


def test_moments_per_episode_equal_a_plain_aggregate(spark, skewed, monkeypatch):
    from gaitworks.functions import vectors as V
    from gaitworks.operators import ordering
    from gaitworks.operators import stats as S

    monkeypatch.setattr(ordering, "BLOCK", 8)
    want = S.moment_stats(V.explode_vector(skewed, "v", ["episode_index"]), ["episode_index", "dim"])
    rows = lambda t: sorted(tuple(round(x, 9) for x in r) for r in t.collect())
    assert rows(S.episode_moments(skewed, "v")) == rows(want)
