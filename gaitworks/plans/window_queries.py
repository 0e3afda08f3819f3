"""Chunks, histories, deltas, goals and positions over the frames of an episode."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.functions import hashing
from gaitworks.functions import vectors as V
from gaitworks.operators import ordering, packs, windows
from gaitworks.plans.registry import query
from gaitworks.plans.tables import FRAMES, SIGNAL, frames, signal, steps, table

NFR = FRAMES + """, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM frames)"""
FROM_S = "s0, s1, s2, s3"


def steps_sql(deltas) -> str:
    return ", ".join(f"({i},{d})" for i, d in enumerate(deltas))


def long_window(df, column: str, *extra):
    """(episode, frame, step, v0..v3) rows of an array-of-vectors column."""
    t = df.select("episode_index", "frame_index", *extra, F.posexplode(column).alias("step", "_v"))
    return t.select("episode_index", "frame_index", F.col("step").cast("bigint").alias("step"), *extra, *V.spread(F.col("_v"), 4, "v"))


@query("delta_timestamp_window", f"""WITH {NFR}, d(step, delta) AS (VALUES (0,-2),(1,0),(2,3))
SELECT b.episode_index, b.frame_index, d.step::bigint AS step, round(t.s0,6) AS v0, round(t.s1,6) AS v1, round(t.s2,6) AS v2, round(t.s3,6) AS v3,
 (b.frame_index+d.delta < 0 OR b.frame_index+d.delta >= b.n) AS is_pad
FROM n b, d, frames t WHERE t.episode_index=b.episode_index AND t.frame_index=least(greatest(b.frame_index+d.delta,0),b.n-1)""")
def delta_timestamp_window(spark, d):
    w = windows.delta_window(frames(spark, d), "state", [-2, 0, 3], "w")
    z = w.select("episode_index", "frame_index", F.posexplode(F.arrays_zip("w", "is_pad")).alias("step", "z"))
    return z.select("episode_index", "frame_index", F.col("step").cast("bigint").alias("step"), *V.spread(F.col("z.w"), 4, "v"), F.col("z.is_pad").alias("is_pad"))


@query("action_chunk", f"""WITH {NFR}, d(step) AS (VALUES (0),(1),(2),(3))
SELECT b.episode_index, b.frame_index, d.step::bigint AS step, t.a0 AS v0, t.a1 AS v1, t.a2 AS v2, t.a3 AS v3
FROM n b, d, frames t WHERE t.episode_index=b.episode_index AND t.frame_index=least(b.frame_index+d.step,b.n-1)""")
def action_chunk(spark, d):
    return long_window(windows.action_chunk(frames(spark, d), "action", 4), "chunk")


@query("window_pad_first_last", f"""WITH {NFR}, d(step, delta) AS (VALUES (0,-1),(1,0),(2,1),(3,2))
SELECT b.episode_index, b.frame_index, d.step::bigint AS step, t.s0 AS v0, t.s1 AS v1, t.s2 AS v2, t.s3 AS v3
FROM n b, d, frames t WHERE t.episode_index=b.episode_index AND t.frame_index=least(greatest(b.frame_index+d.delta,0),b.n-1)""")
def window_pad_first_last(spark, d):
    return long_window(windows.delta_window(frames(spark, d), "state", [-1, 0, 1, 2], "w"), "w")


@query("window_pad_zero", f"""WITH {NFR}, d(step, delta) AS (VALUES (0,-1),(1,0),(2,1),(3,2))
SELECT b.episode_index, b.frame_index, d.step::bigint AS step, coalesce(t.s0,0) AS v0, coalesce(t.s1,0) AS v1, coalesce(t.s2,0) AS v2, coalesce(t.s3,0) AS v3
FROM n b CROSS JOIN d LEFT JOIN frames t ON t.episode_index=b.episode_index AND t.frame_index=b.frame_index+d.delta""")
def window_pad_zero(spark, d):
    return long_window(windows.delta_window(frames(spark, d), "state", [-1, 0, 1, 2], "w", pad="zero"), "w")


@query("observation_history", f"""WITH {FRAMES}, d(j) AS (VALUES (0),(1),(2)),
 x AS (SELECT b.episode_index, b.frame_index, greatest(b.frame_index-5,0) AS st, (b.frame_index-greatest(b.frame_index-5,0))//2+1 AS m, j FROM frames b, d)
SELECT x.episode_index, x.frame_index, x.j::bigint AS step, t.s0 AS v0, t.s1 AS v1, t.s2 AS v2, t.s3 AS v3
FROM x JOIN frames t ON t.episode_index=x.episode_index AND t.frame_index = x.st + 2*greatest(x.j-(3-x.m),0)""")
def observation_history(spark, d):
    return long_window(windows.observation_history(frames(spark, d), "state", 3, 2), "history")


@query("strided_chunk", f"""WITH {NFR}, d(step) AS (VALUES (0),(1),(2))
SELECT b.episode_index, b.frame_index, d.step::bigint AS step, t.a0 AS v0, t.a1 AS v1, t.a2 AS v2, t.a3 AS v3,
 (CASE WHEN b.frame_index+2*d.step < b.n THEN 1 ELSE 0 END)::bigint AS mask
FROM n b, d, frames t WHERE t.episode_index=b.episode_index AND t.frame_index=least(b.frame_index+2*d.step,b.n-1)""")
def strided_chunk(spark, d):
    w = windows.strided_chunk(frames(spark, d), "action", 3, 2)
    z = w.select("episode_index", "frame_index", F.posexplode(F.arrays_zip("chunk", "mask")).alias("step", "z"))
    return z.select("episode_index", "frame_index", F.col("step").cast("bigint").alias("step"), *V.spread(F.col("z.chunk"), 4, "v"), F.col("z.mask").cast("bigint").alias("mask"))


@query("subsample_actions", f"""WITH {NFR}, d(step) AS (VALUES (0),(1))
SELECT b.episode_index, b.frame_index, d.step::bigint AS step, t.a0 AS v0, t.a1 AS v1, t.a2 AS v2, t.a3 AS v3
FROM n b, d, frames t WHERE t.episode_index=b.episode_index AND t.frame_index=least(b.frame_index+2*d.step,b.n-1)""")
def subsample_actions(spark, d):
    w = windows.action_chunk(frames(spark, d), "action", 4)
    return long_window(w.withColumn("sub", windows.subsample(F.col("chunk"), 2)), "sub")


@query("delta_chunk", f"""WITH {NFR}, d(step) AS (VALUES (0),(1),(2))
SELECT b.episode_index, b.frame_index, d.step::bigint AS step, round(t.a0-p.a0,6) AS v0, round(t.a1-p.a1,6) AS v1, round(t.a2-p.a2,6) AS v2, round(t.a3-p.a3,6) AS v3
FROM n b, d, frames t, frames p WHERE t.episode_index=b.episode_index AND t.frame_index=least(b.frame_index+d.step,b.n-1)
 AND p.episode_index=b.episode_index AND p.frame_index=least(b.frame_index+greatest(d.step-1,0),b.n-1)""")
def delta_chunk(spark, d):
    w = windows.action_chunk(frames(spark, d, "action"), "action", 3)
    return long_window(w.withColumn("delta", windows.delta_chunk(F.col("chunk"))), "delta")


@query("relative_chunk", f"""WITH {NFR}, d(step) AS (VALUES (0),(1),(2))
SELECT b.episode_index, b.frame_index, d.step::bigint AS step, round(t.a0-b.s0,6) AS v0, round(t.a1-b.s1,6) AS v1, round(t.a2-b.s2,6) AS v2, round(t.a3,6) AS v3
FROM n b, d, frames t WHERE t.episode_index=b.episode_index AND t.frame_index=least(b.frame_index+d.step,b.n-1)""")
def relative_chunk(spark, d):
    w = windows.action_chunk(frames(spark, d), "action", 3)
    rel = windows.relative_chunk(F.col("chunk"), F.col("state"), [True, True, True, False])
    return long_window(w.withColumn("rel", rel), "rel")


@query("absolute_chunk", f"""WITH {NFR}, d(step) AS (VALUES (0),(1),(2))
SELECT b.episode_index, b.frame_index, d.step::bigint AS step, round(t.a0,6) AS v0, round(t.a1,6) AS v1, round(t.a2,6) AS v2, round(t.a3,6) AS v3
FROM n b, d, frames t WHERE t.episode_index=b.episode_index AND t.frame_index=least(b.frame_index+d.step,b.n-1)""")
def absolute_chunk(spark, d):
    """The inverse restores the recorded chunk."""
    w = windows.action_chunk(frames(spark, d), "action", 3)
    mask = [True, True, True, False]
    rel = windows.relative_chunk(F.col("chunk"), F.col("state"), mask)
    back = w.withColumn("rel", rel).withColumn("abs", windows.absolute_chunk(F.col("rel"), F.col("state"), mask))
    return long_window(back, "abs")


@query("reindex_episode", """WITH e AS (SELECT DISTINCT l_orderkey AS old_index, (l_orderkey % 3)::bigint AS pack FROM lineitem)
SELECT pack, old_index, row_number() OVER (PARTITION BY pack ORDER BY old_index) - 1 AS episode_index FROM e""")
def reindex_episode(spark, d):
    e = steps(spark, d).select(F.col("episode_index").alias("old_index"), (F.col("episode_index") % 3).cast("bigint").alias("pack")).distinct()
    return packs.reindex(e, ["old_index"], "episode_index", packs_by=["pack"])


@query("global_frame_index", f"""WITH {FRAMES}
SELECT episode_index, frame_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS global_index FROM frames""")
def global_frame_index(spark, d):
    f = frames(spark, d).select("episode_index", "frame_index")
    return packs.global_frame_index(f, "global_index")


@query("locate_global_index", """WITH e AS (SELECT l_orderkey AS episode_index, count(*) AS length FROM lineitem GROUP BY 1),
 o AS (SELECT *, sum(length) OVER (ORDER BY episode_index) - length AS off FROM e),
 p AS (SELECT event_id, (event_id*7 % (SELECT count(*) FROM lineitem))::bigint AS global_index FROM events)
SELECT event_id, global_index, episode_index, (global_index-off)::bigint AS frame_index FROM p JOIN o ON global_index >= off AND global_index < off+length""")
def locate_global_index(spark, d):
    eps = steps(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    n = table(spark, d, "lineitem").agg(F.count(F.lit(1)))
    pts = table(spark, d, "events").select("event_id").withColumn("global_index", F.col("event_id") * 7 % n.scalar())
    return packs.locate(pts, packs.episode_offsets(eps, ["episode_index"]), "global_index").select(
        "event_id", "global_index", "episode_index", "frame_index")


@query("holdout_near_median", """WITH e AS (SELECT o_orderpriority AS grp, o_orderkey AS episode_index, count(*) AS length FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1,2),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY length, episode_index)-1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM e),
 k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(pos - n//2), length, episode_index) AS rk FROM r)
SELECT grp, episode_index, length FROM k WHERE rk <= 5""")
def holdout_near_median(spark, d):
    return packs.holdout_near_median(_grouped_episodes(spark, d), "grp", 5)


def _grouped_episodes(spark, d):
    eps = steps(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_index"), F.col("o_orderpriority").alias("grp"))
    return eps.join(o, "episode_index").select("grp", "episode_index", "length")


@query("holdout_first", """WITH e AS (SELECT DISTINCT o_orderpriority AS grp, o_orderkey AS episode_index FROM orders JOIN lineitem ON o_orderkey=l_orderkey)
SELECT grp, episode_index FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY episode_index) AS r FROM e) WHERE r <= 7""")
def holdout_first(spark, d):
    return packs.holdout_first(_grouped_episodes(spark, d), "grp", 7).select("grp", "episode_index")


@query("holdout_random", """WITH e AS (SELECT DISTINCT o_orderpriority AS grp, o_orderkey AS episode_index FROM orders JOIN lineitem ON o_orderkey=l_orderkey)
SELECT grp, episode_index FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ('0x'||substr(sha256('holdout-'||episode_index::varchar),1,8))::bigint, episode_index) AS r FROM e) WHERE r <= 7""")
def holdout_random(spark, d):
    return packs.holdout_random(_grouped_episodes(spark, d), "grp", 7, "holdout").select("grp", "episode_index")


@query("initial_action", f"""WITH {FRAMES} SELECT episode_index, a0 AS v0, a1 AS v1, a2 AS v2, a3 AS v3 FROM frames WHERE frame_index=0""")
def initial_action(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("episode_index"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"),
        F.array("l_discount", "l_tax", "l_quantity", "l_extendedprice").alias("action"))
    first = li.groupBy("episode_index").agg(F.min_by("action", "at").alias("a"))
    return first.select("episode_index", *V.spread(F.col("a"), 4, "v"))


@query("episode_bounds", """WITH e AS (SELECT l_orderkey AS episode_index, count(*) AS length FROM lineitem GROUP BY 1)
SELECT episode_index, length, (sum(length) OVER (ORDER BY episode_index) - length)::bigint AS from_index, (sum(length) OVER (ORDER BY episode_index) - 1)::bigint AS to_index FROM e""")
def episode_bounds(spark, d):
    eps = steps(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    o = packs.episode_offsets(eps, ["episode_index"])
    return o.select("episode_index", "length", F.col("offset").alias("from_index"), (F.col("offset") + F.col("length") - 1).alias("to_index"))


@query("timestamp_sync_check", f"""WITH {SIGNAL}, g AS (SELECT user_id AS episode_index, frame_index, us - lag(us) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM signal)
SELECT episode_index, frame_index, gap AS gap_us FROM g WHERE abs(gap - 36000000000) > 18000000000""")
def timestamp_sync_check(spark, d):
    """Gaps that miss a ten-hour period by more than five hours."""
    s = signal(spark, d).withColumnRenamed("user_id", "episode_index")
    got = ordering.over_frames(s, {"gap_us": lambda w: F.col("us") - F.lag("us", 1).over(w)}, before=1)
    return got.where(F.abs(F.col("gap_us") - 36_000_000_000) > 18_000_000_000).select("episode_index", "frame_index", "gap_us")


@query("resample_linear", f"""WITH {NFR}, c AS (SELECT b.episode_index, b.frame_index, list([t.a0, t.a1, t.a2, t.a3] ORDER BY t.frame_index) AS l FROM n b JOIN frames t ON t.episode_index=b.episode_index AND t.frame_index BETWEEN b.frame_index AND b.frame_index+3 WHERE b.frame_index+3 < b.n GROUP BY 1,2),
 p AS (SELECT episode_index, frame_index, l, unnest(range(0,7)) AS step FROM c), q AS (SELECT *, step*3/6.0 AS pos FROM p)
SELECT episode_index, frame_index, step, """ + ", ".join(f"round(l[floor(pos)::int+1][{i + 1}] + (l[least(floor(pos)::int+1,3)+1][{i + 1}]-l[floor(pos)::int+1][{i + 1}])*(pos-floor(pos)),6) AS v{i}" for i in range(4)) + " FROM q")
def resample_linear(spark, d):
    w = windows.action_chunk(frames(spark, d), "action", 4, pad=False)
    t = w.select("episode_index", "frame_index", F.posexplode(windows.resample_linear(F.col("chunk"), 7)).alias("step", "v"))
    return t.select("episode_index", "frame_index", F.col("step").cast("bigint").alias("step"), *[F.round(F.get("v", i), 6).alias(f"v{i}") for i in range(4)])


@query("resample_at_times", f"""WITH {SIGNAL}, b AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM signal GROUP BY 1),
 q AS (SELECT user_id, lo, hi, unnest(range(1,20)) AS k FROM b), t AS (SELECT user_id, k, lo + (hi-lo)//20*k AS tt FROM q),
 m AS (SELECT t.*, (SELECT max(us) FROM signal s WHERE s.user_id=t.user_id AND s.us<=tt) AS u0, (SELECT min(us) FROM signal s WHERE s.user_id=t.user_id AND s.us>=tt) AS u1 FROM t)
SELECT m.user_id AS episode_index, k, round(CASE WHEN u1=u0 THEN x.value ELSE x.value+(y.value-x.value)*(tt-u0)/(u1-u0) END,4) AS value
FROM m JOIN signal x ON x.user_id=m.user_id AND x.us=u0 JOIN signal y ON y.user_id=m.user_id AND y.us=u1""")
def resample_at_times(spark, d):
    from gaitworks.operators import resample

    s = table(spark, d, "events").select(F.col("user_id").alias("episode_index"), "event_id", F.lit(None).cast("bigint").alias("k"), "value", us(spark))
    b = s.groupBy("episode_index").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    q = b.select("episode_index", F.explode(F.sequence(F.lit(1), F.lit(19))).alias("k"), "lo", "hi").select(
        "episode_index", F.col("k").cast("bigint").alias("k"), (F.col("lo") + F.expr("(hi - lo) div 20") * F.col("k")).alias("us"))
    got = resample.at_times(s.drop("k"), q, ["episode_index"], "us", "event_id", "value", "k")
    return got.select("episode_index", "k", F.round("value", 4).alias("value"))


def us(spark):
    from gaitworks.plans.tables import micros

    return micros("ts").alias("us")


@query("unwrap_angles", f"""WITH {SIGNAL}, a AS (SELECT user_id AS episode_index, frame_index, (value % 6.0) - 3.0 AS x FROM signal),
 d AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY episode_index ORDER BY frame_index),0) AS dx FROM a),
 f AS (SELECT *, CASE WHEN abs(dx) < pi() THEN 0 ELSE -floor((dx+pi())/(2*pi()))*2*pi() END AS fix FROM d)
SELECT episode_index, frame_index, round(x + sum(fix) OVER (PARTITION BY episode_index ORDER BY frame_index),5) AS angle FROM f""")
def unwrap_angles(spark, d):
    s = signal(spark, d).select(F.col("user_id").alias("episode_index"), "frame_index", ((F.col("value") % 6.0) - 3.0).alias("x"))
    return windows.unwrap_column(s, "x", "angle").select("episode_index", "frame_index", F.round("angle", 5).alias("angle"))


@query("resample_angles", f"""WITH {NFR}, ang AS (SELECT episode_index, frame_index, n, (s0*1.7 % 6.0) - 3.0 AS x FROM n),
 w AS (SELECT episode_index, frame_index, x AS x0, lead(x) OVER v AS x1, lead(x,2) OVER v AS x2 FROM ang WINDOW v AS (PARTITION BY episode_index ORDER BY frame_index)),
 u AS (SELECT episode_index, frame_index, x0, x1 - floor((x1-x0+pi())/(2*pi()))*2*pi() AS y1, x2 FROM w WHERE x2 IS NOT NULL),
 v AS (SELECT episode_index, frame_index, x0, y1, x2 - floor((x2-y1+pi())/(2*pi()))*2*pi() AS y2 FROM u),
 r AS (SELECT episode_index, frame_index, unnest([0,1,2,3,4]) AS step, unnest([x0,(x0+y1)/2,y1,(y1+y2)/2,y2]) AS z FROM v)
SELECT episode_index, frame_index, step::bigint AS step, round((z+pi()) - floor((z+pi())/(2*pi()))*2*pi() - pi(),5) AS angle FROM r""")
def resample_angles(spark, d):
    f = frames(spark, d).withColumn("x", (F.get("state", 0) * 1.7 % 6.0) - 3.0)
    w = windows.action_chunk(f, "x", 3, pad=False)
    t = w.select("episode_index", "frame_index", F.posexplode(windows.resample_angles(F.col("chunk"), 5)).alias("step", "angle"))
    return t.select("episode_index", "frame_index", F.col("step").cast("bigint").alias("step"), F.round("angle", 5).alias("angle"))


HASH = "('0x'||substr(sha256('{s}-'||b.episode_index::varchar||'-'||b.frame_index::varchar),1,8))::bigint"


@query("future_goal_step", f"""WITH {NFR}, g AS (SELECT b.*, least(1,n-1-frame_index)+floor({HASH.format(s='goal')}/4294967296.0*(least(5,n-frame_index)-least(1,n-1-frame_index)))::bigint AS goal_offset FROM n b)
SELECT g.episode_index, g.frame_index, g.goal_offset, t.s0 AS g0, t.s1 AS g1, t.s2 AS g2, t.s3 AS g3 FROM g JOIN frames t ON t.episode_index=g.episode_index AND t.frame_index=g.frame_index+g.goal_offset""")
def future_goal_step(spark, d):
    g = windows.future_goal(frames(spark, d), "state", 1, 5, "goal")
    return g.select("episode_index", "frame_index", F.col("goal_offset").cast("bigint").alias("goal_offset"), *[F.get("goal", i).alias(f"g{i}") for i in range(4)])


@query("future_goal_pinned", f"""WITH {NFR}, g AS (SELECT b.*, least(least(3, greatest(n-1-frame_index,1)), n-1-frame_index) AS goal_offset FROM n b)
SELECT g.episode_index, g.frame_index, g.goal_offset, t.s0 AS g0, t.s1 AS g1, t.s2 AS g2, t.s3 AS g3 FROM g JOIN frames t ON t.episode_index=g.episode_index AND t.frame_index=g.frame_index+g.goal_offset""")
def future_goal_pinned(spark, d):
    g = windows.future_goal(frames(spark, d), "state", 3, 4, None)
    return g.select("episode_index", "frame_index", F.col("goal_offset").cast("bigint").alias("goal_offset"), *[F.get("goal", i).alias(f"g{i}") for i in range(4)])


@query("state_jitter", f"""WITH {NFR}, g AS (SELECT b.*, CASE WHEN {HASH.format(s='jit-p')}/4294967296.0 < 0.7 THEN floor({HASH.format(s='jit')}/4294967296.0*5)::bigint-2 ELSE 0 END AS jitter FROM n b)
SELECT g.episode_index, g.frame_index, g.jitter, t.s0 AS v0, t.s1 AS v1, t.s2 AS v2, t.s3 AS v3 FROM g JOIN frames t ON t.episode_index=g.episode_index AND t.frame_index=least(greatest(g.frame_index+g.jitter,0),g.n-1)""")
def state_jitter(spark, d):
    g = windows.state_jitter(frames(spark, d), "state", 2, "jit", p=0.7)
    return g.select("episode_index", "frame_index", F.col("jitter").cast("bigint").alias("jitter"), *[F.get("jittered", i).alias(f"v{i}") for i in range(4)])


@query("chunked_sequence", f"""WITH {NFR}, m AS (SELECT *, least(ceil((n-frame_index)/2.0),3)::bigint AS k FROM n), s AS (SELECT *, unnest(range(0, k*2)) AS step FROM m)
SELECT s.episode_index, s.frame_index, s.k AS n_blocks, s.step, s.step//2 AS block, t.a0 AS v0, t.a1 AS v1, t.a2 AS v2, t.a3 AS v3
FROM s JOIN frames t ON t.episode_index=s.episode_index AND t.frame_index=least(s.frame_index+s.step, s.n-1)""")
def chunked_sequence(spark, d):
    w = windows.chunked_sequence(frames(spark, d), "action", 3, 2)
    t = w.select("episode_index", "frame_index", "n_blocks", F.posexplode("blocks").alias("step", "v"))
    return t.select("episode_index", "frame_index", F.col("n_blocks").cast("bigint").alias("n_blocks"), F.col("step").cast("bigint").alias("step"),
                    F.expr("step div 2").alias("block"), *[F.get("v", i).alias(f"v{i}") for i in range(4)])


@query("pad_to_max_chunks", f"""WITH {NFR}, m AS (SELECT *, least(ceil((n-frame_index)/2.0),3)::bigint AS k FROM n), s AS (SELECT *, unnest(range(0, 6)) AS step FROM m)
SELECT s.episode_index, s.frame_index, s.step, s.step//2 < k AS chunk_mask, CASE WHEN s.step//2 < k THEN t.a2 ELSE 0.0 END AS v2, CASE WHEN s.step//2 < k THEN t.a0 ELSE 0.0 END AS v0, CASE WHEN s.step//2 < k THEN t.a1 ELSE 0.0 END AS v1, CASE WHEN s.step//2 < k THEN t.a3 ELSE 0.0 END AS v3
FROM s JOIN frames t ON t.episode_index=s.episode_index AND t.frame_index=least(s.frame_index+s.step, s.n-1)""")
def pad_to_max_chunks(spark, d):
    w = windows.chunked_sequence(frames(spark, d), "action", 3, 2)
    padded, mask = windows.pad_blocks(F.col("blocks"), F.col("n_blocks"), 3, 2)
    w = w.withColumns({"p": padded, "m": mask})
    t = w.select("episode_index", "frame_index", "m", F.posexplode("p").alias("step", "v"))
    return t.select("episode_index", "frame_index", F.col("step").cast("bigint").alias("step"),
                    F.get("m", F.expr("int(step div 2)")).alias("chunk_mask"), *[F.get("v", i).alias(f"v{i}") for i in range(4)])


@query("temporal_ensemble", f"""WITH {NFR}, d(i) AS (VALUES (0),(1),(2)),
 p AS (SELECT b.episode_index, b.frame_index+d.i AS tick, b.frame_index AS made_at, [t.a0, t.a1, t.a2, t.a3] AS v, 1+0.01*b.frame_index AS f FROM n b, d, frames t
  WHERE t.episode_index=b.episode_index AND t.frame_index=least(b.frame_index+d.i,b.n-1)),
 r AS (SELECT *, row_number() OVER (PARTITION BY episode_index, tick ORDER BY made_at)-1 AS i FROM p)
SELECT episode_index, tick, dim, round(sum(exp(-0.01*i)*v[dim+1]*f)/sum(exp(-0.01*i)),6) AS value, count(*) AS votes
FROM r, (VALUES (0::bigint),(1),(2),(3)) k(dim) GROUP BY 1,2,3""")
def temporal_ensemble(spark, d):
    w = windows.action_chunk(frames(spark, d, "action"), "action", 3)
    cell = lambda i, j: F.get(F.get("chunk", i), j) * (1 + 0.01 * F.col("frame_index"))
    drift = F.array(*[F.array(*[cell(i, j) for j in range(4)]) for i in range(3)])
    got = windows.temporal_ensemble(w.withColumn("chunk", drift), "chunk", 0.01)
    return got.select("episode_index", "tick", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"), "votes")


@query("first_k_poses", f"""WITH {FRAMES} SELECT episode_index, frame_index, s0 AS v0, s2 AS v1 FROM frames WHERE frame_index < 3""")
def first_k_poses(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("episode_index"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    top = ordering.first_rows(li, ["episode_index"], [F.col(c) for c in order], 3)
    return top.select("episode_index", (F.col("_rn") - 1).cast("bigint").alias("frame_index"), F.col("l_quantity").alias("v0"), F.col("l_discount").alias("v1"))


@query("prev_action_as_state", f"""WITH {FRAMES} SELECT episode_index, frame_index,
 coalesce(lag(a2) OVER w, 0.0) AS rpy, coalesce(lag(a3) OVER w, 0.75) AS height FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)""")
def prev_action_as_state(spark, d):
    f = frames(spark, d).withColumn("prev", F.slice("action", 3, 2))
    got = windows.previous_or(f, "prev", V.literal([0.0, 0.75]), "from_prev")
    return got.select("episode_index", "frame_index", F.get("from_prev", 0).alias("rpy"), F.get("from_prev", 1).alias("height"))


@query("task_progress", f"""WITH {NFR} SELECT episode_index, frame_index, round(frame_index/n,6) AS progress FROM n""")
def task_progress(spark, d):
    f = ordering.with_length(frames(spark, d).select("episode_index", "frame_index"))
    return f.select("episode_index", "frame_index", F.round(F.col("frame_index") / F.col("length"), 6).alias("progress"))


@query("add_done_flag", f"""WITH {NFR} SELECT episode_index, frame_index, frame_index = n-1 AS done FROM n""")
def add_done_flag(spark, d):
    return windows.done_flag(frames(spark, d).select("episode_index", "frame_index"))
