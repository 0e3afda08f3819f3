"""Prediction against ground truth: rates, errors, latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.functions import vectors as V
from gaitworks.operators import scoring as X
from gaitworks.operators import stats as S
from gaitworks.plans.registry import query
from gaitworks.plans.tables import FRAMES, STATE_LONG, emb, frames, steps, table

# the prediction is a deterministic distortion of the recorded state
ERR = STATE_LONG + """, er AS (SELECT *, abs(value*0.01*(1+dim) - 0.5) AS err, value*0.01*(1+dim) - 0.5 AS signed FROM state_long)"""
SEG = "CASE WHEN dim < 2 THEN 'arm' ELSE 'hand' END"
SEGMENTS = {"arm": (0, 2), "hand": (2, 4)}


def errors(spark, d):
    long = V.explode_vector(steps(spark, d), "state", ["episode_index", "embodiment", "dataset_id"])
    signed = F.col("value") * 0.01 * (1 + F.col("dim")) - 0.5
    return long.withColumns({"signed": signed, "err": F.abs(signed)})


def r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("success_rate_by_task", """WITH e AS (SELECT event_type AS task, CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END AS s,
  CASE WHEN value > 40 THEN 3 ELSE 0 + (CASE WHEN value > 20 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END) END / 3.0::double AS p FROM events),
 t AS (SELECT task, avg(s) AS m, avg(p) AS q FROM e GROUP BY 1),
 o AS (SELECT * FROM (VALUES ('view',1),('purchase',2),('click',3)) o(task,place))
SELECT t.task, coalesce(place,4)::bigint AS place, round(m*100,4) AS rate, round(q*100,4) AS progress_rate FROM t LEFT JOIN o ON t.task=o.task
UNION ALL SELECT 'mean', 5, round(avg(m)*100,4), round(avg(q)*100,4) FROM t""")
def success_rate_by_task(spark, d):
    """A trial's scores: success, and two subtasks that may have begun without it."""
    won = F.when(F.col("value") > 40, 1.0).otherwise(0.0)
    steps = F.array(won, F.when(F.col("value") > 20, 0.5).otherwise(0.0), (F.col("event_id") % 3).cast("double"))
    e = table(spark, d, "events").select(F.col("event_type").alias("task"), (won * 100).alias("score"), (X.subtask_progress(steps) * 100).alias("progress"))
    return r(X.success_rates(e, "task", "score", ["view", "purchase", "click"], "progress"), 4, "rate", "progress_rate")


@query("l1_error_by_group", f"""WITH {ERR}, p AS (SELECT dim, avg(err) AS m, max(err) AS x FROM er GROUP BY dim)
SELECT {SEG} AS grp, round(avg(m),4) AS l1, round(max(x),4) AS worst FROM p GROUP BY 1 UNION ALL SELECT 'all', round(avg(m),4), round(max(x),4) FROM p""")
def l1_error_by_group(spark, d):
    return r(X.l1_by_group(errors(spark, d), SEGMENTS), 4, "l1", "worst")


@query("openloop_error", f"""WITH {ERR}, p AS (SELECT episode_index, dim, avg(err) AS m FROM er GROUP BY 1,2)
SELECT episode_index, {SEG} AS segment, round(sqrt(sum(m*m)),5) AS norm FROM p GROUP BY 1,2""")
def openloop_error(spark, d):
    return r(X.segment_norms(errors(spark, d), ["episode_index"], SEGMENTS), 5, "norm")


@query("denormalised_l1", f"""WITH {ERR}, b AS (SELECT dim, min(value) AS lo, max(value) AS hi FROM state_long GROUP BY dim)
SELECT {SEG.replace('dim', 'er.dim')} AS segment, round(avg(CASE WHEN embodiment <> 'R' THEN 0.5*err*(hi-lo) END),3) AS l1 FROM er JOIN b ON er.dim=b.dim GROUP BY 1""")
def denormalised_l1(spark, d):
    e = errors(spark, d).withColumn("valid", F.col("embodiment") != "R")
    b = e.groupBy("dim").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return r(X.denormalised_l1(e, b, SEGMENTS, mask="valid"), 3, "l1")


@query("token_accuracy", """WITH t AS (SELECT l_returnflag AS embodiment, l_partkey % 8 AS p, l_suppkey % 8 AS t FROM lineitem)
SELECT embodiment, count(*) FILTER (t>=2 AND t<7 AND p=t) AS correct, count(*) FILTER (t>=2 AND t<7) AS counted, round(count(*) FILTER (t>=2 AND t<7 AND p=t)/count(*) FILTER (t>=2 AND t<7),6) AS accuracy FROM t GROUP BY 1""")
def token_accuracy(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("embodiment"), (F.col("l_partkey") % 8).alias("p"), (F.col("l_suppkey") % 8).alias("t"))
    return r(X.token_accuracy(t, "p", "t", 2, 7, ["embodiment"]), 6, "accuracy")


@query("decode_error_summary", f"""WITH {ERR} SELECT round(avg(CASE WHEN err < 1000 THEN err END),5) AS mean_l1, round(avg(CASE WHEN err < 1000 THEN abs(signed-1) END),5) AS mean_horizon_error,
 count(*) AS items, count(*) FILTER (err >= 1000) AS undecodable FROM er""")
def decode_error_summary(spark, d):
    ok = F.col("err") < 1000
    t = errors(spark, d).agg(
        F.avg(F.when(ok, F.col("err"))).alias("mean_l1"), F.avg(F.when(ok, F.abs(F.col("signed") - 1))).alias("mean_horizon_error"),
        F.count(F.lit(1)).alias("items"), F.count_if(~ok).alias("undecodable"))
    return r(t, 5, "mean_l1", "mean_horizon_error")


@query("box_iou", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, l_discount*100 AS y FROM lineitem),
 i AS (SELECT *, greatest(least(x+20, 45)-greatest(x,15),0)*greatest(least(y+8,14)-greatest(y,4),0) AS n, 20*8.0 AS a, 30*10.0 AS c FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(n/(a+c-n),6) AS iou FROM i""")
def box_iou(spark, d):
    t = table(spark, d, "lineitem").withColumns({"x": F.col("l_quantity"), "y": F.col("l_discount") * 100})
    a = [F.col("x"), F.col("y"), F.col("x") + 20, F.col("y") + 8]
    b = [F.lit(v) for v in (15.0, 4.0, 45.0, 14.0)]
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(X.box_iou(a, b), 6).alias("iou"))


@query("mean_action_distance", f"""WITH {ERR}, p AS (SELECT dataset_id, sqrt(sum(err*err))/count(*) AS dd FROM er GROUP BY 1) SELECT round(avg(dd),5) AS distance, count(*) AS batches FROM p""")
def mean_action_distance(spark, d):
    return r(X.action_distance(errors(spark, d), "dataset_id"), 5, "distance")


PCT = ", ".join(f"round(quantile_cont(value,{p / 100}),6) AS p{p}" for p in (25, 50, 75, 90, 95, 99))


@query("latency_percentiles", f"""SELECT event_type AS timing, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std, {PCT} FROM events GROUP BY 1""")
def latency_percentiles(spark, d):
    ps = (25, 50, 75, 90, 95, 99)
    e = table(spark, d, "events").select(F.col("event_type").alias("timing"), "value")
    t = S.full_stats(e, ["timing"], [p / 100 for p in ps], [f"p{p}" for p in ps], few_groups=True)
    return r(t.drop("count", "min", "max"), 6, "mean", "std", *[f"p{p}" for p in ps])


@query("dim_threshold_count", f"""WITH {ERR} SELECT count(*) FILTER (err > 0.1) AS above, round(avg(err),5) AS mean_error, round(avg(dim+3),6) AS tokens_mean, min(dim+3)::bigint AS tokens_min, max(dim+3)::bigint AS tokens_max FROM er""")
def dim_threshold_count(spark, d):
    t = X.threshold_report(errors(spark, d).withColumn("tokens", (F.col("dim") + 3).cast("bigint")), "err", "tokens")
    return r(r(t, 5, "mean_error"), 6, "tokens_mean")


@query("distinct_tasks", """SELECT l_suppkey AS grp, count(DISTINCT l_partkey) AS tasks FROM lineitem GROUP BY 1 UNION ALL SELECT -1, count(DISTINCT l_partkey) FROM lineitem""")
def distinct_tasks(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("grp"), "l_partkey").distinct()
    per = pairs.groupBy("grp").agg(F.count(F.lit(1)).alias("tasks"))
    total = pairs.select("l_partkey").distinct().agg(F.count(F.lit(1)).alias("tasks")).select(F.lit(-1).cast("bigint").alias("grp"), "tasks")
    return per.unionByName(total)


CH = f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM frames), d(step) AS (VALUES (0),(1),(2)), k(dim) AS (VALUES (0),(1),(2),(3)),
 c AS (SELECT b.episode_index, b.frame_index, d.step, CASE k.dim WHEN 0 THEN 'discount' WHEN 1 THEN 'tax' WHEN 2 THEN 'amount' ELSE 'price' END AS modality,
  abs(CASE k.dim WHEN 0 THEN t.a0*100 WHEN 1 THEN t.a1*100 WHEN 2 THEN t.a2 ELSE t.a3/1000 END * 0.0131713717*(d.step+1)) AS err FROM n b, d, k, frames t WHERE t.episode_index=b.episode_index AND t.frame_index=least(b.frame_index+d.step,b.n-1))"""


@query("chunk_error_report", CH + """ SELECT 'modality' AS level, modality AS label, round(avg(err),6) AS l1, round(avg(CASE WHEN step=0 THEN err END),6) AS first_step_l1 FROM c GROUP BY modality
UNION ALL SELECT 'step', step::varchar, round(avg(err),6), round(avg(CASE WHEN step=0 THEN err END),6) FROM c GROUP BY step
UNION ALL SELECT 'frame', episode_index::varchar||'/'||frame_index::varchar||'/'||modality, round(avg(err),6), round(avg(CASE WHEN step=0 THEN err END),6) FROM c GROUP BY episode_index, frame_index, modality
UNION ALL SELECT 'all', '', round(avg(err),6), round(avg(CASE WHEN step=0 THEN err END),6) FROM c""")
def chunk_error_report(spark, d):
    from gaitworks.operators import windows

    w = windows.action_chunk(frames(spark, d).select("episode_index", "frame_index", "action"), "action", 3)
    scaled = {"discount": lambda a: F.get(a, 0) * 100, "tax": lambda a: F.get(a, 1) * 100, "amount": lambda a: F.get(a, 2), "price": lambda a: F.get(a, 3) / 1000}
    errors = [F.array(*[F.abs(of(F.get("chunk", i)) * 0.0131713717 * (i + 1)) for i in range(3)]).alias(m) for m, of in scaled.items()]
    g = X.chunk_report(w.select("episode_index", "frame_index", *errors), ["episode_index", "frame_index"], list(scaled))
    label = F.when(F.col("level") == "modality", F.col("modality")).when(F.col("level") == "step", F.col("step").cast("string")).when(
        F.col("level") == "frame", F.concat_ws("/", F.col("episode_index").cast("string"), F.col("frame_index").cast("string"), "modality")).otherwise("")
    return r(g.select("level", label.alias("label"), "l1", "first_step_l1"), 6, "l1", "first_step_l1")


@query("warm_latency", """WITH o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT user_id, max(CASE WHEN rn=1 THEN value END) AS first, round(avg(CASE WHEN rn>1 THEN value END),5) AS mean, round(stddev_pop(CASE WHEN rn>1 THEN value END),5) AS std FROM o GROUP BY 1""")
def warm_latency(spark, d):
    return r(X.warm_latency(table(spark, d, "events"), "user_id", F.struct("ts", "event_id"), "value"), 5, "mean", "std")


@query("sample_mse_by_dataset", f"""WITH {ERR}, z AS (SELECT dataset_id, episode_index, CASE WHEN dim=1 THEN err/1000 ELSE err END AS err, CASE WHEN dim=1 THEN abs(value)/1000 ELSE abs(value) END AS norm FROM er),
 p AS (SELECT dataset_id, episode_index, avg(err*err) AS m, avg(err/(norm+1e-3)) AS l FROM z GROUP BY 1,2)
SELECT dataset_id, round(avg(m),4) AS mse, round(avg(l),4) AS l2, count(*) AS samples FROM p GROUP BY 1 UNION ALL SELECT NULL, round(avg(m),4), round(avg(l),4), count(*) FROM p""")
def sample_mse_by_dataset(spark, d):
    unit = F.when(F.col("dim") == 1, F.lit(1000.0)).otherwise(F.lit(1.0))  # the price in thousands
    e = errors(spark, d).withColumns({"err": F.col("err") / unit, "norm": F.abs("value") / unit})
    return X.mse_by_dataset(e, "dataset_id", "episode_index")


COV = ["l_quantity", "l_extendedprice/1000", "l_discount", "l_tax"]
PR = ["l_quantity*1.1031717+1", "l_extendedprice/1000*0.9533171+2", "l_discount*0.9071317", "l_tax+0.01*l_linenumber"]


def frechet_sql() -> str:
    import itertools

    n = len(COV)
    var, cov = (lambda f, *x: f"coalesce({f}({', '.join(x)}),0)"), list(itertools.combinations(range(n), 2))  # one frame: no spread
    aggs = [f"avg({PR[i]})-avg({COV[i]}) AS g{i}, {var('var_samp', PR[i])} AS vp{i}, {var('var_samp', COV[i])} AS vt{i}" for i in range(n)]
    aggs += [f"{var('covar_samp', PR[i], PR[j])}-{var('covar_samp', COV[i], COV[j])} AS c{i}{j}" for i, j in cov]
    dist, tp, tt = "+".join(f"g{i}*g{i}" for i in range(n)), "+".join(f"vp{i}" for i in range(n)), "+".join(f"vt{i}" for i in range(n))
    gap = "+".join(f"(vp{i}-vt{i})*(vp{i}-vt{i})" for i in range(n)) + "+" + "+".join(f"2*c{i}{j}*c{i}{j}" for i, j in cov)
    root = "+".join(f"sqrt(greatest(vp{i}*vt{i},0))" for i in range(n))
    return f"""WITH g AS (SELECT l_orderkey AS episode_index, count(*) AS steps, {', '.join(aggs)} FROM lineitem GROUP BY 1)
SELECT episode_index, steps, round({dist},5) AS mean_sq, round({tp},5) AS trace_pred, round({tt},5) AS trace_true, round(sqrt({gap}),5) AS cov_gap, round({dist}+{tp}+{tt}-2*({root}),5) AS frechet_diag FROM g"""


@query("frechet_moments", frechet_sql())
def frechet_moments(spark, d):
    n = range(len(COV))
    t = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("episode_index"), *[F.expr(e).alias(f"p{i}") for i, e in enumerate(PR)], *[F.expr(c).alias(f"t{i}") for i, c in enumerate(COV)])
    m = X.frechet_moments(t, ["episode_index"], [f"p{i}" for i in n], [f"t{i}" for i in n])
    return r(m, 5, "mean_sq", "trace_pred", "trace_true", "cov_gap", "frechet_diag")


FIT = range(4)
PULL = [[{0: 2.0, 1: 0.5}.get(abs(i - j), 0.0) for j in FIT] for i in FIT]  # positive definite, not diagonal


def frechet_distance_sql() -> str:
    """For p = S t + c with S symmetric and positive definite, C1 C2 = (S C2)^2: the root's trace is the trace of S C2."""
    made = ", ".join("+".join(f"{PULL[i][j]}*v[{j + 1}]" for j in FIT) + f"+{i} AS p{i}, v[{i + 1}] AS t{i}" for i in FIT)
    gap = "+".join(f"power(avg(p{i})-avg(t{i}),2)" for i in FIT)
    trace = "+".join(f"var_samp(p{i})+var_samp(t{i})" for i in FIT)
    root = "+".join(f"{PULL[i][j]}*covar_samp(t{i},t{j})" for i in FIT for j in FIT if PULL[i][j])
    return f"""WITH e AS (SELECT label, embedding::double[] AS v FROM embeddings), p AS (SELECT label, {made} FROM e)
SELECT label, count(*) AS steps, round({gap}+{trace}-2*({root}),6) AS frechet FROM p GROUP BY 1"""


@query("frechet_distance", frechet_distance_sql())
def frechet_distance(spark, d):
    v = lambda j: F.get("embedding", j)
    t = emb(spark, d).select("label", *[(sum(PULL[i][j] * v(j) for j in FIT) + float(i)).alias(f"p{i}") for i in FIT], *[v(i).alias(f"t{i}") for i in FIT])
    return r(X.frechet_distance(t, ["label"], [f"p{i}" for i in FIT], [f"t{i}" for i in FIT], eps=0.0), 6, "frechet")


@query("sample_density_kl", """WITH s AS (SELECT vec_id, unnest(range(3)) AS m, embedding::double[] AS v FROM embeddings),
 p AS (SELECT a.vec_id, a.m AS i, b.m AS j, list_sum(list_transform(range(16), lambda k: (a.v[a.m*16+k+1]-a.v[b.m*16+k+1])*(a.v[a.m*16+k+1]-a.v[b.m*16+k+1]))) AS d2,
  list_sum(list_transform(range(16), lambda k: (a.v[a.m*16+k+1]-a.v[48+k+1])*(a.v[a.m*16+k+1]-a.v[48+k+1]))) AS dt FROM s a JOIN s b ON a.vec_id=b.vec_id),
 q AS (SELECT vec_id, i, ln(sum(exp(-0.5*d2))/3) + 0.5*max(dt) AS x FROM p GROUP BY 1,2)
SELECT vec_id, round(avg(x),6) AS kl FROM q GROUP BY 1""")
def sample_density_kl(spark, d):
    """Three samples and a target of 16 dimensions each: the whole vector."""
    e = emb(spark, d).select("vec_id", F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(3)]).alias("s"), F.slice("embedding", 49, 16).alias("t"))
    return e.select("vec_id", F.round(X.density_kl(F.col("s"), F.col("t")), 6).alias("kl"))
