"""Statistics over whole tables: plain, per episode, masked, mixed, histogram, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.functions import vectors as V
from gaitworks.operators import ordering
from gaitworks.operators import stats as S
from gaitworks.plans.registry import query
from gaitworks.plans.tables import EMB_LONG, FRAMES, STATE_LONG, emb, frames, steps, table


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


STAT = ("mean", "std", "min", "max", "q01", "q99")


def emb_long(spark, d):
    return V.explode_vector(emb(spark, d), "embedding", ["label"])


def state_long(spark, d):
    return V.explode_vector(steps(spark, d), "state", ["episode_index", "embodiment", "dataset_id"])


def big(df, *columns):
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


SIX = """round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std, round(min(value),6) AS min,
 round(max(value),6) AS max, round(quantile_cont(value,0.01),6) AS q01, round(quantile_cont(value,0.99),6) AS q99"""
SIX_RAW = """count(*) AS count, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
 quantile_cont(value,0.01) AS q01, quantile_cont(value,0.99) AS q99"""


@query("feature_stats", f"""WITH {EMB_LONG}
SELECT dim, count(*) AS count, {SIX} FROM emb_long GROUP BY dim""")
def feature_stats(spark, d):
    t = S.full_stats(emb_long(spark, d), ["dim"], few_groups=True)
    return big(rounded(t, STAT), "dim")


@query("feature_stats_frames", f"""WITH {STATE_LONG}
SELECT dim::bigint AS dim, count(*) AS count, {SIX} FROM state_long GROUP BY dim""")
def feature_stats_frames(spark, d):
    t = S.full_stats(state_long(spark, d), ["dim"], few_groups=True)
    return big(rounded(t, STAT), "dim")


@query("episode_stats", f"""WITH {STATE_LONG}
SELECT episode_index, dim::bigint AS dim, count(*) AS count, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std,
 min(value) AS min, max(value) AS max FROM state_long GROUP BY episode_index, dim""")
def episode_stats(spark, d):
    t = S.episode_moments(steps(spark, d), "state")
    return big(rounded(t, ["mean", "std"]), "dim")


def valid_dims(embodiment, dim):
    """Registered validity: embodiment N lacks the last dimension, R the last two."""
    return (dim < 2) | ((dim == 2) & (embodiment != "R")) | ((dim == 3) & (embodiment == "A"))


VALID = "(dim < 2 OR (dim = 2 AND embodiment <> 'R') OR (dim = 3 AND embodiment = 'A'))"


@query("merge_partial_moments", f"""WITH {STATE_LONG}, t AS (
 SELECT dim::bigint AS dim, count(value) AS count, sum(value) AS s, sum(value*value) AS q, min(value) AS mn, max(value) AS mx
 FROM (SELECT dim, CASE WHEN {VALID} THEN value END AS value FROM state_long) GROUP BY dim)
SELECT dim, count, round(s/greatest(count,1),4) AS mean,
 round(sqrt(greatest(q/greatest(count,1)-(s/greatest(count,1))*(s/greatest(count,1)),0)),4) AS std,
 coalesce(mn,0) AS min, coalesce(mx,0) AS max FROM t""")
def merge_partial_moments(spark, d):
    long = lambda f: V.explode_vector(f, "state", ["episode_index", "embodiment"])
    valid = valid_dims(F.col("embodiment"), F.col("dim"))
    f = steps(spark, d).select("episode_index", "embodiment", "state")
    parts = ordering.per_group(f, ["episode_index"], lambda f: S.partial_moments(long(f), ["episode_index", "embodiment", "dim"], valid=valid))
    return big(rounded(S.merge_partials(parts, ["dim"]), ["mean", "std"], 4), "dim", "count")


@query("pooled_stats", f"""WITH {STATE_LONG}, e AS (SELECT dataset_id, dim, {SIX_RAW} FROM state_long GROUP BY dataset_id, dim),
 m AS (SELECT dim, sum(count*mean)/sum(count) AS mean FROM e GROUP BY dim)
SELECT e.dim::bigint AS dim, sum(count)::bigint AS count, round(max(m.mean),4) AS mean,
 round(sqrt(sum(count*(std*std+(e.mean-m.mean)*(e.mean-m.mean)))/sum(count)),4) AS std,
 min(min) AS min, max(max) AS max, round(min(q01),6) AS q01, round(max(q99),6) AS q99
FROM e JOIN m ON e.dim=m.dim GROUP BY e.dim""")
def pooled_stats(spark, d):
    per = S.grouped_stats(steps(spark, d), "state", ["dataset_id"])
    t = S.pool_episode_stats(per, ["dim"])
    return big(rounded(rounded(t, ["mean", "std"], 4), ["q01", "q99"]), "dim", "count")


def _mixture(spark, d):
    per = S.full_stats(emb_long(spark, d), ["label", "dim"], few_groups=True)
    return per.withColumn("weight", F.col("label") + 1.0)


MIX = f"""WITH {EMB_LONG}, e AS (SELECT label, dim, {SIX_RAW} FROM emb_long GROUP BY label, dim),
 t AS (SELECT dim, sum((label+1)*mean)/sum(label+1) AS m, sum((label+1)*(std*std+mean*mean))/sum(label+1) AS sq,
 min(min) AS mn, max(max) AS mx, sum((label+1)*q01)/sum(label+1) AS wq01, sum((label+1)*q99)/sum(label+1) AS wq99,
 min(q01) AS lq01, max(q99) AS hq99 FROM e GROUP BY dim)"""


@query("mixture_stats", MIX + """ SELECT dim, round(m,6) AS mean, round(sqrt(greatest(sq-m*m,0)),6) AS std,
 round(mn,6) AS min, round(mx,6) AS max, round(wq01,6) AS q01, round(wq99,6) AS q99 FROM t""")
def mixture_stats(spark, d):
    return big(rounded(S.mix_stats(_mixture(spark, d), "weight", ["dim"]), STAT), "dim")


@query("mixture_stats_min_max", MIX + """ SELECT dim, round(m,6) AS mean, round(sqrt(greatest(sq-m*m,0)),6) AS std,
 round(mn,6) AS min, round(mx,6) AS max, round(lq01,6) AS q01, round(hq99,6) AS q99 FROM t""")
def mixture_stats_min_max(spark, d):
    return big(rounded(S.mix_stats(_mixture(spark, d), "weight", ["dim"], "min_max"), STAT), "dim")


@query("merge_metadata_common", """WITH k AS (SELECT source AS pack, lang AS key, max(length(lang)) AS width FROM documents GROUP BY 1,2)
SELECT key, count(*) AS n_packs, max(width)::bigint AS width FROM k GROUP BY key
HAVING count(*) = (SELECT count(DISTINCT pack) FROM k)""")
def merge_metadata_common(spark, d):
    from gaitworks.operators import packs

    keys = (
        table(spark, d, "documents").groupBy(F.col("source").alias("pack"), F.col("lang").alias("key"))
        .agg(F.max(F.length("lang")).cast("long").alias("width"))
    )
    return packs.merge_common_keys(keys, pack="pack", key="key", config="width")


@query("masked_stats", f"""WITH {STATE_LONG} SELECT embodiment, dim::bigint AS dim, count(*) AS count, round(avg(value),6) AS mean,
 round(stddev_pop(value),6) AS std, min(value) AS min, max(value) AS max FROM state_long WHERE {VALID} GROUP BY embodiment, dim""")
def masked_stats(spark, d):
    long = state_long(spark, d).where(valid_dims(F.col("embodiment"), F.col("dim")))
    return big(rounded(S.moment_stats(long, ["embodiment", "dim"]), ["mean", "std"]), "dim")


@query("masked_quantiles", f"""WITH {FRAMES}, l AS (SELECT embodiment, u.dim,
  CASE u.dim WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END AS value
  FROM frames, (VALUES (0),(1),(2),(3)) u(dim) WHERE frame_index % 2 = 0)
SELECT dim::bigint AS dim, count(*) AS count, round(quantile_cont(value,0.01),6) AS q01, round(quantile_cont(value,0.99),6) AS q99
FROM l WHERE {VALID} GROUP BY dim""")
def masked_quantiles(spark, d):
    """Valid dimensions only, every second frame of each episode (the operator's own thinning)."""
    thin = frames(spark, d).where("frame_index % 2 = 0")
    long = V.explode_vector(thin, "state", ["embodiment"]).where(valid_dims(F.col("embodiment"), F.col("dim")))
    t = S.full_stats(long, ["dim"], few_groups=True)
    return big(rounded(t, ["q01", "q99"]).select("dim", "count", "q01", "q99"), "dim")


@query("histogram_quantiles", f"""WITH {EMB_LONG}, r AS (SELECT dim, min(value)-1e-10 AS lo, max(value)+1e-10 AS hi, count(*) AS n FROM emb_long GROUP BY dim),
 h AS (SELECT e.dim, least(floor((value-lo)/((hi-lo)/5000.0)),4999) AS bin, count(*) AS c, max(lo) AS lo, max(hi) AS hi, max(n) AS n
  FROM emb_long e JOIN r ON e.dim=r.dim GROUP BY 1,2),
 u AS (SELECT *, sum(c) OVER (PARTITION BY dim ORDER BY bin) AS upto, lo+bin*((hi-lo)/5000.0) AS edge FROM h)
SELECT dim, max(n) AS count, round(min(CASE WHEN upto>=0.01*n THEN edge END),6) AS q01,
 round(min(CASE WHEN upto>=0.99*n THEN edge END),6) AS q99 FROM u GROUP BY dim""")
def histogram_quantiles(spark, d):
    return big(rounded(S.histogram_quantiles(emb_long(spark, d), ["dim"]), ["q01", "q99"]), "dim")


H = 3


@query("relative_action_stats", f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM frames),
 p AS (SELECT b.episode_index, u.dim, CASE u.dim WHEN 0 THEN t.a0-b.s0 WHEN 1 THEN t.a1-b.s1 WHEN 2 THEN t.a2-b.s2 ELSE t.a3-b.s3 END AS value
  FROM n b JOIN n t ON t.episode_index=b.episode_index AND t.frame_index BETWEEN b.frame_index AND b.frame_index+{H}-1, (VALUES (0),(1),(2),(3)) u(dim)
  WHERE b.frame_index < b.n-({H}-1))
SELECT dim::bigint AS dim, count(*) AS count, {SIX} FROM p GROUP BY dim""")
def relative_action_stats(spark, d):
    t = S.full_stats(_relative(spark, d), ["dim"], few_groups=True)
    return big(rounded(t, STAT), "dim")


def _relative(spark, d):
    from gaitworks.operators import windows

    return windows.relative_long(frames(spark, d, "action", "state"), "action", "state", H)


@query("relative_action_stats_per_horizon", f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM frames),
 p AS (SELECT t.frame_index-b.frame_index AS horizon, u.dim, CASE u.dim WHEN 0 THEN t.a0-b.s0 WHEN 1 THEN t.a1-b.s1 WHEN 2 THEN t.a2-b.s2 ELSE t.a3-b.s3 END AS value
  FROM n b JOIN n t ON t.episode_index=b.episode_index AND t.frame_index BETWEEN b.frame_index AND b.frame_index+{H}-1, (VALUES (0),(1),(2),(3)) u(dim)
  WHERE b.frame_index < b.n-({H}-1))
SELECT horizon, dim::bigint AS dim, count(*) AS count, {SIX} FROM p GROUP BY horizon, dim""")
def relative_action_stats_per_horizon(spark, d):
    t = S.full_stats(_relative(spark, d), ["horizon", "dim"], few_groups=True)
    return big(rounded(t, STAT), "dim", "horizon")


@query("sampled_chunk_stats", f"""WITH {FRAMES}, k AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n,
  ('0x'||substr(sha256('chunk-'||episode_index::varchar||'-'||frame_index::varchar),1,8))::bigint AS h FROM frames),
 c AS (SELECT u.dim, CASE u.dim WHEN 0 THEN t.a0 WHEN 1 THEN t.a1 WHEN 2 THEN t.a2 ELSE t.a3 END AS value
  FROM k b JOIN frames t ON t.episode_index=b.episode_index AND t.frame_index BETWEEN b.frame_index AND b.frame_index+{H}-1, (VALUES (0),(1),(2),(3)) u(dim)
  WHERE b.frame_index < b.n-({H}-1) AND b.h < 858993459)
SELECT dim::bigint AS dim, count(*) AS count, {SIX} FROM c GROUP BY dim""")
def sampled_chunk_stats(spark, d):
    """Statistics over one chunk in five, chosen by hash: sampling is the operator."""
    from gaitworks.functions import hashing
    from gaitworks.operators import windows

    chunks = windows.action_chunk(frames(spark, d), "action", H, pad=False)
    kept = chunks.where(hashing.draw32("chunk", F.col("episode_index"), F.col("frame_index")) < int(0.2 * 2**32))
    long = kept.select(F.explode("chunk").alias("a")).select(F.posexplode("a").alias("dim", "value"))
    return big(rounded(S.full_stats(long, ["dim"], few_groups=True), STAT), "dim")


@query("stats_from_episode_stats", f"""WITH {STATE_LONG}, e AS (SELECT episode_index, dim, min(value) AS mn, max(value) AS mx FROM state_long GROUP BY 1,2)
SELECT dim::bigint AS dim, min(mn) AS min, max(mx) AS max FROM e GROUP BY dim""")
def stats_from_episode_stats(spark, d):
    per = steps(spark, d).groupBy("episode_index").agg(
        *[F.min(F.get("state", i)).alias(f"mn{i}") for i in range(4)], *[F.max(F.get("state", i)).alias(f"mx{i}") for i in range(4)]
    ).select(F.array(*[f"mn{i}" for i in range(4)]).alias("mn"), F.array(*[f"mx{i}" for i in range(4)]).alias("mx"))
    long = per.select(F.posexplode(F.arrays_zip("mn", "mx")).alias("dim", "v"))
    return big(long.groupBy("dim").agg(F.min("v.mn").alias("min"), F.max("v.mx").alias("max")), "dim")


@query("combine_modality_stats", f"""WITH {STATE_LONG}, e AS (SELECT dim, avg(value) AS mean FROM state_long GROUP BY dim)
SELECT (CASE WHEN dim >= 2 THEN dim-2 ELSE dim+2 END)::bigint AS position, CASE WHEN dim >= 2 THEN 'rates' ELSE 'amounts' END AS sub_key,
 round(mean,6) AS mean, dim >= 2 AS mask FROM e""")
def combine_modality_stats(spark, d):
    """Sub-keys 'rates' (dims 2, 3) and 'amounts' (0, 1) concatenated in that order; the gripper-like key is unmasked."""
    per = S.moment_stats(state_long(spark, d), ["dim"])
    sub = per.withColumn("sub_key", F.when(F.col("dim") >= 2, "rates").otherwise("amounts")).withColumn(
        "rank", F.when(F.col("dim") >= 2, 0).otherwise(1)
    )
    # rows here are dimensions of one declared vector
    cells = sub.agg(F.sort_array(F.collect_list(F.struct("rank", "dim", "sub_key", "mean"))).alias("c"))
    out = cells.select(F.posexplode("c").alias("position", "c"))
    return big(
        out.select("position", "c.sub_key", F.round("c.mean", 6).alias("mean"), (F.col("c.sub_key") != "amounts").alias("mask")),
        "position",
    )


@query("stats_validity_check", """WITH s AS (SELECT p_type AS feature, p_brand AS stat, count(*) c FROM part GROUP BY 1,2),
 f AS (SELECT DISTINCT feature FROM s), g AS (SELECT DISTINCT stat FROM s)
SELECT feature, stat, true AS missing FROM f, g WHERE (feature,stat) NOT IN (SELECT (feature,stat) FROM s WHERE c >= 12)""")
def stats_validity_check(spark, d):
    """Part types play features and brands the required statistics; fewer than 12 parts count as absent."""
    from gaitworks.operators import filters

    have = table(spark, d, "part").groupBy(F.col("p_type").alias("feature"), F.col("p_brand").alias("stat")).count().where("count >= 12")
    features = table(spark, d, "part").select(F.col("p_type").alias("feature")).distinct()
    required = [f"Brand#{i}" for i in range(1, 26)]
    return filters.missing_stats(features, have, required)


@query("pack_counts", """SELECT l_suppkey AS pack, count(DISTINCT l_orderkey) AS episodes, count(*) AS frames, count(DISTINCT l_partkey) AS tasks,
 (count(DISTINCT l_orderkey)*2) AS videos, ceil(count(DISTINCT l_orderkey)/1000.0)::bigint AS chunks FROM lineitem GROUP BY l_suppkey""")
def pack_counts(spark, d):
    from gaitworks.operators import packs

    return packs.pack_counts(steps(spark, d), pack="dataset_id", cameras=2).withColumnRenamed("dataset_id", "pack")


@query("task_group_report", """SELECT l_partkey AS task, count(DISTINCT l_orderkey) AS episodes, count(*) AS frames FROM lineitem GROUP BY 1""")
def task_group_report(spark, d):
    from gaitworks.operators import packs

    return packs.task_report(steps(spark, d), task="task_index").withColumnRenamed("task_index", "task")


@query("resolution_audit", """WITH s AS (SELECT p_size AS shape, count(*) AS sources FROM part GROUP BY 1)
SELECT shape, sources, shape = (SELECT shape FROM s ORDER BY sources DESC, shape LIMIT 1) AS is_majority FROM s""")
def resolution_audit(spark, d):
    from gaitworks.operators import packs

    return packs.shape_audit(table(spark, d, "part").select("p_partkey", F.col("p_size").alias("shape")), "shape")


@query("boost_share", """WITH w AS (SELECT CASE WHEN p_name LIKE '%ring%' THEN 3.0 WHEN p_name LIKE '%bolt%' THEN 2.0 ELSE 1.0 END AS w
 FROM lineitem JOIN part ON l_partkey=p_partkey)
SELECT round(avg(CASE WHEN w<>1 THEN 1.0 ELSE 0.0 END),6) AS frame_share, round(sum(CASE WHEN w<>1 THEN w ELSE 0 END)/sum(w),6) AS draw_share FROM w""")
def boost_share(spark, d):
    from gaitworks.operators import sampling

    weighted = sampling.task_weights(
        steps(spark, d).select("task_index"), table(spark, d, "part").select(F.col("p_partkey").alias("task_index"), F.col("p_name").alias("task")),
        {"ring": 3.0, "bolt": 2.0},
    )
    return sampling.boost_share(weighted)


@query("normalised_label_means", f"""WITH {EMB_LONG}, q AS (SELECT dim, quantile_cont(value,0.01) AS lo, quantile_cont(value,0.99) AS hi FROM emb_long GROUP BY dim)
SELECT label, e.dim, round(avg(least(greatest(CASE WHEN hi<>lo THEN 2*(value-lo)/(hi-lo)-1 ELSE value END,-1),1)),6) AS mean
FROM emb_long e JOIN q ON e.dim=q.dim GROUP BY label, e.dim""")
def normalised_label_means(spark, d):
    from gaitworks.operators import normalise as N

    stats = S.stats_vectors(S.full_stats(emb_long(spark, d), ["dim"], few_groups=True), [])
    t = N.with_stats(emb(spark, d), stats).select("label", N.q99("embedding").alias("v"))
    long = V.explode_vector(t, "v", ["label"])
    return big(long.groupBy("label", "dim").agg(F.round(F.avg("value"), 6).alias("mean")), "dim")
