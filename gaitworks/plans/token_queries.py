"""Discretisation of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.functions import tokens as K
from gaitworks.functions import vectors as V
from gaitworks.operators import stats as S
from gaitworks.operators import windows
from gaitworks.plans.registry import query
from gaitworks.plans.tables import EMB_LONG, FRAMES, emb, frames, table


def emb_long(spark, d):
    return V.explode_vector(emb(spark, d), "embedding", ["vec_id"])


# edges at or below the clipped value, counted one by one
BIN = """len(list_filter(range(256), lambda k: CASE WHEN k = 255 THEN 0.3::double ELSE k*((0.3::double+0.3::double)/255) - 0.3::double END <= least(greatest(value,-0.3::double),0.3::double)))::int"""


@query("uniform_bins", f"WITH {EMB_LONG} SELECT vec_id, dim, CASE WHEN dim%5=4 THEN -1 ELSE 32000-1-{BIN} END AS token FROM emb_long")
def uniform_bins(spark, d):
    t = K.uniform_token(F.col("value"), -0.3, 0.3, 256, 32000, F.col("dim") % 5 != 4)
    return emb_long(spark, d).select("vec_id", F.col("dim").cast("bigint").alias("dim"), t.alias("token"))


@query("uniform_bins_decode", f"WITH {EMB_LONG} SELECT vec_id, dim, round(-0.3 + 0.6/255*(least(greatest({BIN}-1,0),254)+0.5),6) AS value FROM emb_long")
def uniform_bins_decode(spark, d):
    t = emb_long(spark, d).withColumn("token", K.uniform_token(F.col("value"), -0.3, 0.3, 256, 32000))
    return t.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round(K.uniform_decode(F.col("token"), -0.3, 0.3, 256, 32000), 6).alias("value"))


@query("uniform_bins_per_dim", f"""WITH {EMB_LONG}, s AS (SELECT dim, min(value) AS lo, max(value) AS hi FROM emb_long GROUP BY dim)
SELECT vec_id, e.dim, len(list_filter(range(32), lambda k: CASE WHEN k = 31 THEN hi ELSE k*((hi-lo)/31) + lo END <= value))::int AS bin FROM emb_long e JOIN s ON e.dim=s.dim""")
def uniform_bins_per_dim(spark, d):
    long = emb_long(spark, d)
    st = S.moment_stats(long, ["dim"]).select("dim", "min", "max")
    t = long.join(F.broadcast(st), "dim")  # one row per dimension
    return t.select("vec_id", F.col("dim").cast("bigint").alias("dim"), K.uniform_bin(F.col("value"), F.col("min"), F.col("max"), 32).alias("bin"))


QB = f"""WITH {EMB_LONG}, s AS (SELECT dim, quantile_cont(value,[0.1,0.3,0.5,0.7,0.9]) AS q FROM emb_long GROUP BY dim),
 t AS (SELECT vec_id, e.dim, value, q, len(list_filter(q, lambda x: x <= value))::int AS token FROM emb_long e JOIN s ON e.dim=s.dim)"""


def _quantile_rows(spark, d):
    long = emb_long(spark, d)
    names = ["a", "b", "c", "d", "e"]
    st = S.full_stats(long, ["dim"], [0.1, 0.3, 0.5, 0.7, 0.9], names, few_groups=True)
    st = st.select("dim", F.when(F.col("count") > 0, F.array(*names)).alias("q"))  # a dimension without a value has no table
    return long.join(F.broadcast(st), "dim").withColumn("token", K.quantile_token(F.col("value"), F.col("q")))


# values one float from a threshold are left out of the comparison of bins by rounding the threshold table both sides share
@query("quantile_bins", QB + " SELECT dim, token, count(*) AS n FROM t GROUP BY 1,2")
def quantile_bins(spark, d):
    t = _quantile_rows(spark, d).groupBy("dim", "token").agg(F.count(F.lit(1)).alias("n"))
    return t.select(F.col("dim").cast("bigint").alias("dim"), "token", "n")


@query("quantile_bins_decode", QB + " SELECT vec_id, dim, round(q[greatest(least(token,5)-1,0)+1],5) AS value FROM t")
def quantile_bins_decode(spark, d):
    return _quantile_rows(spark, d).select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round(K.quantile_decode(F.col("token"), F.col("q")), 5).alias("value"))


STATE_BIN = "(len(list_filter(range(256), lambda k: k/128.0::double - 1 <= {x})) - 1)::varchar"


@query("state_prompt", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Task: ' || replace(replace(trim(p_name),'_',' '),chr(10),' ') || ', State: ' ||
 {STATE_BIN.format(x="l_quantity/25::double-1.5::double")} || ' ' || {STATE_BIN.format(x="l_tax*20-1")} || ';' AS prompt
FROM lineitem JOIN part ON l_partkey=p_partkey""")
def state_prompt(spark, d):
    """The first state runs from below -1 to 0.5, the second over the whole range."""
    t = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    s = F.array(F.col("l_quantity") / 25 - 1.5, F.col("l_tax") * 20 - 1)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", K.state_prompt(F.col("p_name"), s).alias("prompt"))


T = 4
# the four action dimensions, scaled to a like range
ACTION_SCALES = (13.1771371, 7.3190731, 0.1371317, 0.0007131)
_X = ", ".join(f"x.a{i}*{f} AS x{i}" for i, f in enumerate(ACTION_SCALES))
_Y = ", ".join(f"round_even(10*sum(x{i}*sqrt((CASE WHEN k=0 THEN 1 ELSE 2 END)/4.0)*cos(pi()*(2*t+1)*k/8.0)),0) AS y{i}" for i in range(4))
DCT = f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM frames), ti(t) AS (VALUES (0),(1),(2),(3)), ki(k) AS (VALUES (0),(1),(2),(3)),
 c AS (SELECT b.episode_index, b.frame_index, ti.t, {_X} FROM n b, ti, frames x WHERE b.frame_index+3 < b.n AND x.episode_index=b.episode_index AND x.frame_index=b.frame_index+ti.t),
 q AS (SELECT episode_index, frame_index, k, {_Y} FROM c, ki GROUP BY 1,2,3)"""


def _chunks(spark, d):
    scaled = F.array(*[F.get("action", i) * f for i, f in enumerate(ACTION_SCALES)])
    f = frames(spark, d, "action").select("episode_index", "frame_index", scaled.alias("a"))
    w = windows.action_chunk(f, "a", T, pad=False)
    return w.withColumn("sym", K.dct_quantise(F.col("chunk"), T, width=len(ACTION_SCALES)))


@query("dct_quantise", DCT + " SELECT episode_index, frame_index, k::bigint AS k, " + ", ".join(f"y{i}::bigint AS y{i}" for i in range(4)) + " FROM q")
def dct_quantise(spark, d):
    t = _chunks(spark, d).select("episode_index", "frame_index", F.posexplode("sym").alias("k", "y"))
    return t.select("episode_index", "frame_index", F.col("k").cast("bigint").alias("k"), *[F.get("y", i).cast("bigint").alias(f"y{i}") for i in range(4)])


@query("dct_reconstruct", DCT + " SELECT episode_index, frame_index, t::bigint AS t, "
       + ", ".join(f"round(sum(y{i}/10*sqrt((CASE WHEN k=0 THEN 1 ELSE 2 END)/4.0)*cos(pi()*(2*t+1)*k/8.0)),5)+0.0 AS x{i}" for i in range(4)) + " FROM q, ti GROUP BY 1,2,3")
def dct_reconstruct(spark, d):
    w = _chunks(spark, d).withColumn("rec", K.dct_reconstruct(F.col("sym"), T, width=len(ACTION_SCALES)))
    t = w.select("episode_index", "frame_index", F.posexplode("rec").alias("t", "x"))
    return t.select("episode_index", "frame_index", F.col("t").cast("bigint").alias("t"), *[(F.round(F.get("x", i), 5) + 0.0).alias(f"x{i}") for i in range(4)])


@query("dct_symbol_range", DCT + ", s AS (" + " UNION ALL ".join(f"SELECT y{i} AS y FROM q" for i in range(4)) + ") SELECT min(y)::bigint AS low, max(y)::bigint AS high, max(y)-min(y) <= 1024 AS fits FROM s")
def dct_symbol_range(spark, d):
    y = F.flatten("sym")
    t = _chunks(spark, d).agg(F.min(F.array_min(y)).cast("bigint").alias("low"), F.max(F.array_max(y)).cast("bigint").alias("high"))
    return t.withColumn("fits", F.col("high") - F.col("low") <= 1024)


@query("symbol_pair_counts", DCT + ", s AS (" + " UNION ALL ".join(f"SELECT episode_index, frame_index, 4*k+{i} AS pos, y{i}::bigint AS y FROM q" for i in range(4)) + """),
 p AS (SELECT y AS a, lead(y) OVER (PARTITION BY episode_index, frame_index ORDER BY pos) AS b FROM s)
SELECT a AS left_symbol, b AS right_symbol, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY 1,2""")
def symbol_pair_counts(spark, d):
    """Adjacent pairs inside each chunk's own symbol array, counted with map-side combine."""
    y = F.transform(F.flatten("sym"), lambda v: v.cast("bigint"))
    t = _chunks(spark, d).select(y.alias("y"))
    pairs = t.select(F.explode(F.arrays_zip(F.expr("slice(y, 1, size(y) - 1)").alias("a"), F.expr("slice(y, 2, size(y) - 1)").alias("b"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("left_symbol"), F.col("p.b").alias("right_symbol")).agg(F.count(F.lit(1)).alias("n"))


@query("token_id_clip", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(greatest(l_partkey-100,0),1023) AS token FROM lineitem""")
def token_id_clip(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", K.clip_ids(F.col("l_partkey"), -100, 0, 1023).alias("token"))


@query("grid_quantise", f"WITH {EMB_LONG} SELECT vec_id, dim, round(round_even(least(greatest(value,-0.25),0.25)/0.05,0)*0.05,6)+0.0 AS value FROM emb_long")
def grid_quantise(spark, d):
    return emb_long(spark, d).select("vec_id", F.col("dim").cast("bigint").alias("dim"), (F.round(K.snap(F.col("value"), -0.25, 0.25, 0.05), 6) + 0.0).alias("value"))
