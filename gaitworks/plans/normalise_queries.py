"""Normalisation driven by a statistics join, and its inverses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.functions import vectors as V
from gaitworks.operators import normalise as N
from gaitworks.operators import stats as S
from gaitworks.plans.registry import query
from gaitworks.plans.tables import EMB_LONG, FRAMES, STATE_LONG, emb, frames, steps

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ST = """st AS (SELECT dim, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS mn, max(value) AS mx,
 quantile_cont(value,0.01) AS q01, quantile_cont(value,0.99) AS q99 FROM emb_long GROUP BY dim)"""


def _stats(spark, d):
    long = V.explode_vector(emb(spark, d), "embedding")
    t = S.full_stats(long, ["dim"], few_groups=True)
    # two dimensions are declared constant so that every zero-range rule is exercised
    flat = F.col("dim").isin(5, 9)
    t = t.withColumns({
        "max": F.when(flat, F.col("min")).otherwise(F.col("max")), "q99": F.when(flat, F.col("q01")).otherwise(F.col("q99")),
        "std": F.when(flat, F.lit(0.0)).otherwise(F.col("std")),
    })
    return S.stats_vectors(t, [])


ROWS = f"""WITH {EMB_LONG}, s0 AS (SELECT dim, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS mn, max(value) AS mx,
  quantile_cont(value,0.01) AS q01, quantile_cont(value,0.99) AS q99 FROM emb_long GROUP BY dim),
 st AS (SELECT dim, mean, CASE WHEN dim IN (5,9) THEN 0 ELSE std END AS std, mn AS lo, CASE WHEN dim IN (5,9) THEN mn ELSE mx END AS hi,
  q01, CASE WHEN dim IN (5,9) THEN q01 ELSE q99 END AS q99 FROM s0),
 x AS (SELECT vec_id, e.dim, value AS x, mean, std, lo, hi, q01, q99, abs(hi-lo) < 1e-4*(abs(hi)+abs(lo)+1e-8) AS flat,
  abs(q99-q01) < 1e-4*(abs(q99)+abs(q01)+1e-8) AS qflat FROM emb_long e JOIN st ON e.dim=st.dim)
SELECT vec_id, dim, round($,6) AS value FROM x"""


def sql(expr: str) -> str:
    return ROWS.replace("$", expr)


def clip(e: str) -> str:
    return f"least(greatest({e},-1),1)"


def run(expr):
    def go(spark, d):
        t = N.with_stats(emb(spark, d), _stats(spark, d)).withColumn("y", expr(F.col("embedding")))
        out = t.select("vec_id", F.posexplode("y").alias("dim", "value"))
        return out.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))

    return go


MM = clip("CASE WHEN lo<>hi THEN 2*(x-lo)/(hi-lo)-1 ELSE 0 END")
Q = clip("CASE WHEN q01<>q99 THEN 2*(x-q01)/(q99-q01)-1 ELSE x END")
query("normalise_min_max", sql(MM))(run(lambda v: N.min_max(v)))
query("normalise_q99", sql(Q))(run(lambda v: N.q99(v)))
query("normalise_mean_std", sql("CASE WHEN std<>0 THEN (x-mean)/std ELSE x END"))(run(lambda v: N.mean_std(v)))
query("normalise_scale", sql("CASE WHEN greatest(abs(lo),abs(hi))<>0 THEN x/greatest(abs(lo),abs(hi)) ELSE 0 END"))(run(lambda v: N.scale(v)))
query("normalise_binary", sql("CASE WHEN x*20>0.5 THEN 1.0::double ELSE 0.0::double END"))(run(lambda v: N.binary(F.transform(v, lambda x: x * 20))))
query("denormalise", sql(f"({MM}+1)/2*(hi-lo)+lo"))(run(lambda v: V.let(N.min_max(v), lambda y: N.undo_range(y, "min", "max"))))
query("denormalise_q99", sql(f"({Q}+1)/2*(q99-q01)+q01"))(run(lambda v: V.let(N.q99(v), lambda y: N.undo_range(y, "q01", "q99"))))
query("denormalise_mean_std", sql("x"))(run(lambda v: V.let(N.mean_std(v), lambda y: N.undo_mean_std(y))))
query("normalise_bounds_tolerant", sql(clip("CASE WHEN flat THEN x ELSE 2*(x-lo)/(hi-lo)-1 END")))(run(lambda v: N.tolerant(v, "min", "max", True)))
query("normalise_state_tolerant", sql(clip("CASE WHEN qflat THEN 0 ELSE 2*(x-q01)/(q99-q01)-1 END")))(run(lambda v: N.tolerant(v, "q01", "q99", False)))
query("normalise_masked_tolerant", sql(clip("CASE WHEN dim%2=0 THEN CASE WHEN flat THEN x ELSE 2*(x-lo)/(hi-lo)-1 END ELSE x END")))(
    run(lambda v: N.tolerant(v, "min", "max", True, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i % 2 == 0))))
query("zscore_eps", sql("(x-mean)/(std+1e-6)"))(run(lambda v: F.transform(N.zscore_eps(v), lambda x: x)))
query("zscore_eps_inverse", sql("CASE WHEN dim < 60 THEN x*(std+1e-6)+mean ELSE x END"))(
    run(lambda v: N.undo_zscore_eps(v, F.slice("mean", 1, 60), F.slice("std", 1, 60))))
query("quantile_eps", sql("CASE WHEN qflat THEN 0 ELSE " + clip("(x-q01)/(q99-q01+1e-6)*2-1") + " END"))(run(lambda v: N.quantile_eps(v)))
query("quantile_eps_inverse", sql("CASE WHEN dim < 60 THEN (x+1)/2*(q99-q01+1e-6)+q01 ELSE x END"))(
    run(lambda v: N.undo_quantile_eps(v, F.slice("q01", 1, 60), F.slice("q99", 1, 60))))
query("clamp_then_standardise", sql("(least(greatest(x,q01),q99)-mean)/(std+1e-6)"))(run(lambda v: N.clamp_standardise(v, "q01", "q99")))
query("rescale_range", sql("CASE WHEN hi<>lo THEN 3*(x-lo)/(hi-lo)+2 ELSE 2 END"))(run(lambda v: N.rescale(v, "min", "max", 2.0, 5.0)))
query("rescale_range_inverse", sql("CASE WHEN hi<>lo THEN x ELSE lo END"))(
    run(lambda v: V.let(N.rescale(v, "min", "max", 2.0, 5.0), lambda y: N.undo_rescale(y, "min", "max", 2.0, 5.0))))
query("state_dropout", sql("CASE WHEN ('0x'||substr(sha256('drop-'||vec_id::varchar),1,8))::bigint/4294967296.0 < 0.3 THEN 0 ELSE x END"))(
    run(lambda v: N.dropout(v, 0.3, "drop", [F.col("vec_id")])))
HR = "('0x'||substr(sha256('noise-r-'||vec_id::varchar||'-'||dim::varchar),1,8))::bigint"
HA = "('0x'||substr(sha256('noise-a-'||vec_id::varchar||'-'||dim::varchar),1,8))::bigint"
query("perturb_state", sql(clip(f"x + CASE WHEN flat THEN 0 ELSE 0.05*sqrt(-2*ln(({HR}+1)/4294967297.0::double))*cos(2*pi()*({HA}/4294967296.0)) END")))(
    run(lambda v: N.perturb(v, "min", "max", 0.05, "noise", [F.col("vec_id")])))


@query("normalise_per_horizon", f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM frames), d(horizon) AS (VALUES (0),(1)),
 p AS (SELECT b.episode_index, b.frame_index, d.horizon, t.a0-b.s0 AS x0, t.a1-b.s1 AS x1, t.a2-b.s2 AS x2, t.a3-b.s3 AS x3 FROM n b, d, frames t WHERE t.episode_index=b.episode_index AND t.frame_index=b.frame_index+d.horizon AND b.frame_index < b.n-1),
 s AS (SELECT horizon, """ + ", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in range(4)) + " FROM p GROUP BY horizon) SELECT episode_index, frame_index, p.horizon::bigint AS horizon, "
       + ", ".join(f"round(least(greatest(2*(x{i}-lo{i})/(hi{i}-lo{i})-1,-1),1),6) AS v{i}" for i in range(4)) + " FROM p JOIN s ON p.horizon=s.horizon")
def normalise_per_horizon(spark, d):
    from gaitworks.operators import windows

    pairs = windows.relative_pairs(frames(spark, d), "action", "state", 2)
    long = pairs.select("horizon", F.posexplode("relative").alias("dim", "value"))
    st = S.stats_vectors(S.moment_stats(long, ["horizon", "dim"]), ["horizon"], columns=("min", "max"))
    t = N.with_stats(pairs, st, ["horizon"]).withColumn("y", N.min_max("relative"))
    return t.select("episode_index", "frame_index", F.col("horizon").cast("bigint").alias("horizon"), *[F.round(F.get("y", i), 6).alias(f"v{i}") for i in range(4)])


@query("concat_bounds", f"""WITH {EMB_LONG}, {ST}, f AS (SELECT 'arm' AS feature, 1 AS r, dim, mean-std AS lo, mean+std AS hi FROM st WHERE dim < 10
  UNION ALL SELECT 'hand', 0, dim-10, mn, mx FROM st WHERE dim >= 10 AND dim < 16 UNION ALL SELECT 'leg', 2, dim-16, q01, q99 FROM st WHERE dim >= 16)
SELECT feature, row_number() OVER (ORDER BY r, dim)-1 AS position, round(lo,6) AS lo, round(hi,6) AS hi FROM f""")
def concat_bounds(spark, d):
    t = S.full_stats(V.explode_vector(emb(spark, d), "embedding"), ["dim"], few_groups=True)
    dim = F.col("dim")
    named = t.withColumns({
        "feature": F.when(dim < 10, "arm").when(dim < 16, "hand").otherwise("leg"),
        "dim": F.when(dim < 10, dim).when(dim < 16, dim - 10).otherwise(dim - 16),
    })
    b = N.concat_bounds(named, [("hand", "min_max"), ("arm", "mean_std"), ("leg", "q99")])
    return b.select("feature", "position", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("fill_constant_episode", f"""WITH {STATE_LONG}, s AS (SELECT dim, (min(value)+max(value))/2 AS mid FROM state_long GROUP BY dim)
SELECT l_orderkey AS episode_index, l_linenumber, l_partkey, CASE WHEN o_orderstatus='P' THEN (SELECT mid FROM s WHERE dim=0) ELSE l_quantity END AS v0,
 CASE WHEN o_orderstatus='P' THEN (SELECT mid FROM s WHERE dim=1) ELSE l_extendedprice END AS v1, CASE WHEN o_orderstatus='P' THEN (SELECT mid FROM s WHERE dim=2) ELSE l_discount END AS v2,
 CASE WHEN o_orderstatus='P' THEN (SELECT mid FROM s WHERE dim=3) ELSE l_tax END AS v3 FROM lineitem JOIN orders ON l_orderkey=o_orderkey""")
def fill_constant_episode(spark, d):
    from gaitworks.plans.tables import table

    f = steps(spark, d).withColumnRenamed("task_index", "l_partkey")
    bad = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("episode_index"))
    st = S.stats_vectors(S.moment_stats(V.explode_vector(f, "state"), ["dim"]), [], columns=("min", "max"))
    t = N.fill_constant(f, bad, st, "state")
    return t.select("episode_index", "l_linenumber", "l_partkey", *[F.get("state", i).alias(f"v{i}") for i in range(4)])


@query("fill_constant_stats", f"""WITH {STATE_LONG}, s AS (SELECT dim, (min(value)+max(value))/2 AS mid FROM state_long GROUP BY dim),
 e AS (SELECT episode_index, dim, avg(value) AS mean, stddev_pop(value) AS std FROM state_long GROUP BY 1,2)
SELECT episode_index, e.dim::bigint AS dim, round(CASE WHEN o_orderstatus='P' THEN mid ELSE mean END,6) AS mean, round(CASE WHEN o_orderstatus='P' THEN 0 ELSE std END,6) AS std
FROM e JOIN s ON e.dim=s.dim JOIN orders ON o_orderkey=episode_index""")
def fill_constant_stats(spark, d):
    """The listed episodes' statistics rows are those of one constant vector."""
    from gaitworks.plans.tables import table

    long = V.explode_vector(steps(spark, d), "state")
    per = S.episode_moments(steps(spark, d), "state")
    mids = S.moment_stats(long, ["dim"]).select("dim", ((F.col("min") + F.col("max")) / 2).alias("mid"))
    bad = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("episode_index"), F.lit(True).alias("bad"))
    t = per.join(F.broadcast(mids), "dim").join(bad, "episode_index", "left")
    return t.select("episode_index", F.col("dim").cast("bigint").alias("dim"),
                    F.round(F.when(F.col("bad"), F.col("mid")).otherwise(F.col("mean")), 6).alias("mean"),
                    F.round(F.when(F.col("bad"), 0.0).otherwise(F.col("std")), 6).alias("std"))
