"""Catalogue, frame and episode predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.functions import text as X
from gaitworks.functions import vectors as V
from gaitworks.operators import filters as C
from gaitworks.operators import ordering
from gaitworks.plans.registry import query
from gaitworks.plans.tables import EMB_LONG, FRAMES, SIGNAL, STATE_LONG, emb, frames, signal, steps, table


@query("catalogue_filter", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH') AND o_totalprice > 100000 AND o_orderstatus <> 'P'""")
def catalogue_filter(spark, d):
    o = table(spark, d, "orders").withColumn("is_deleted", F.when(F.col("o_orderstatus") == "P", True))
    return C.catalogue_filter(o, ["o_orderpriority in ('1-URGENT', '2-HIGH')", "o_totalprice > 100000"]).select("o_orderkey", "o_totalprice")


@query("catalogue_filter_equality", """SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7""")
def catalogue_filter_equality(spark, d):
    return C.catalogue_filter(table(spark, d, "supplier"), {"s_nationkey": 7}, deleted=None).select("s_suppkey", "s_name")


@query("normalise_filter_row", """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus='P' THEN true END, false) AS is_deleted,
 coalesce(CASE WHEN o_orderkey%3=0 THEN o_orderstatus END, CASE WHEN o_orderkey%3=1 THEN o_orderpriority END, 'any') AS robot_name FROM orders""")
def normalise_filter_row(spark, d):
    k = F.col("o_orderkey") % 3
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", True).alias("is_deleted"),
        F.when(k == 0, F.col("o_orderstatus")).otherwise("  ").alias("name"), F.when(k == 1, F.col("o_orderpriority")).alias("type"), F.lit("any").alias("embodiment"))
    return C.normalise_row(o, "is_deleted", ["name", "type", "embodiment"], "robot_name").select("o_orderkey", "is_deleted", "robot_name")


@query("require_path", """SELECT page_id FROM pages WHERE page_id % 4 <> 0""")
def require_path(spark, d):
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 8 == 0, "   ").when(F.col("page_id") % 4 != 0, F.col("url")).alias("path"))
    return C.require_path(p, "path").select("page_id")


@query("valid_data_keys", f"""WITH {FRAMES} SELECT episode_index, s0<>0 OR s1<>0 AS has_pose, s2<>0 AS has_discount, s3<>0 AS has_tax FROM frames WHERE frame_index=0""")
def valid_data_keys(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("episode_index"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"),
        F.struct(F.array("l_quantity", "l_extendedprice").alias("pose"), F.array("l_discount").alias("discount"), F.array("l_tax").alias("tax")).alias("f"))
    first = li.groupBy("episode_index").agg(F.min_by("f", "at").alias("f"))
    return first.select("episode_index", *[F.exists(F.col(f"f.{n}"), lambda x: x != 0).alias(f"has_{n}") for n in ("pose", "discount", "tax")])


@query("robot_type_filter", f"""WITH {FRAMES}, m AS (SELECT episode_index, max(frame_index) AS mx FROM frames GROUP BY 1)
SELECT f.episode_index, f.embodiment AS robot_type FROM frames f JOIN m ON f.episode_index=m.episode_index AND f.frame_index=m.mx WHERE f.embodiment IN ('A','R')""")
def robot_type_filter(spark, d):
    li = table(spark, d, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    t = li.groupBy(F.col("l_orderkey").alias("episode_index")).agg(F.max_by("l_returnflag", "at").alias("robot_type"))
    return t.where(F.col("robot_type").isin("A", "R"))


@query("robot_type_first_declared", """WITH f AS (SELECT l_orderkey AS episode_index, arg_min(l_linestatus, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS t FROM lineitem WHERE l_returnflag='R' GROUP BY 1)
SELECT o_orderkey AS episode_index, coalesce(t,'g1') AS robot_type FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) LEFT JOIN f ON o_orderkey=episode_index""")
def robot_type_first_declared(spark, d):
    """The type of the first frame that declares one, else the default."""
    li = table(spark, d, "lineitem").withColumn("at", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    declared = F.when(F.col("l_returnflag") == "R", F.col("at"))
    t = li.groupBy(F.col("l_orderkey").alias("episode_index")).agg(F.min_by("l_linestatus", declared).alias("t"))
    return t.select("episode_index", F.coalesce("t", F.lit("g1")).alias("robot_type"))


@query("episode_length_filter", """SELECT l_orderkey AS episode_index, least(count(*),6) AS length FROM lineitem GROUP BY 1 HAVING count(*) >= 3""")
def episode_length_filter(spark, d):
    eps = steps(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    return C.cap_lengths(eps, 3, 6)


@query("discard_bad_episodes", """SELECT l_orderkey AS episode_index, count(*) AS frames FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='P') GROUP BY 1""")
def discard_bad_episodes(spark, d):
    bad = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("episode_index"))
    return steps(spark, d).join(bad, "episode_index", "left_anti").groupBy("episode_index").agg(F.count(F.lit(1)).alias("frames"))


@query("pause_frame_filter", f"""WITH {FRAMES}, g AS (SELECT *, lag(s0) OVER (PARTITION BY episode_index ORDER BY frame_index) AS p FROM frames)
SELECT episode_index, frame_index FROM g WHERE abs(s2) > 0.05 OR abs(s3) > 0.05 OR coalesce(s0 <> p, false)""")
def pause_frame_filter(spark, d):
    f = frames(spark, d).withColumns({"delta": F.slice("state", 3, 2), "grip": F.get("state", 0)})
    return C.moving_frames(f, "delta", "grip", 0.05).select("episode_index", "frame_index")


@query("empty_instruction_filter", f"""WITH {SIGNAL} SELECT user_id, event_id FROM signal WHERE user_id IN (SELECT user_id FROM signal WHERE frame_index=0 AND event_type <> 'error')""")
def empty_instruction_filter(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("instruction"))
    return C.first_non_empty(e, "instruction", ["user_id"], "at").select("user_id", "event_id")


@query("success_path_filter", """SELECT page_id, url FROM pages WHERE regexp_matches(url, '.*/en/.*')""")
def success_path_filter(spark, d):
    return table(spark, d, "pages").where(F.col("url").rlike(".*/en/.*")).select("page_id", "url")


@query("conversation_length_filter", r"""WITH w AS (SELECT conv_id, sum(CASE WHEN trim(regexp_replace(text,'\s+',' ','g'))='' THEN 0 ELSE len(string_split(trim(regexp_replace(text,'\s+',' ','g')),' ')) END)::bigint AS words FROM conversations GROUP BY 1)
SELECT conv_id, words FROM w WHERE words <= 120""")
def conversation_length_filter(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(X.word_count(F.col("text"))).alias("words"))
    return t.where("words <= 120")


@query("outlier_episode_scan", f"""WITH {STATE_LONG} SELECT episode_index, dim::bigint AS dim, count(*) AS hits, max(abs(value)) AS worst FROM state_long WHERE abs(value) > 45 AND dim <> 1 OR abs(value) > 90000 GROUP BY 1,2""")
def outlier_episode_scan(spark, d):
    """Thresholds per dimension are applied before the scan by scaling the large one."""
    f = steps(spark, d).withColumn("scaled", F.transform("state", lambda x, i: F.when(i == 1, x / 2000).otherwise(x)))
    t = C.outlier_episodes(V.explode_vector(f, "scaled", ["episode_index"]), 45.0, ["episode_index"])
    w = F.when(F.col("dim") == 1, F.round(F.col("worst") * 2000, 2)).otherwise(F.col("worst"))
    return t.select("episode_index", F.col("dim").cast("bigint").alias("dim"), "hits", w.alias("worst"))


@query("outlier_frames", f"""WITH {EMB_LONG} SELECT vec_id, dim, round(value,6) AS value FROM emb_long WHERE abs(value) > 0.3""")
def outlier_frames(spark, d):
    t = V.explode_vector(emb(spark, d), "embedding", ["vec_id"]).where(F.abs("value") > 0.3)
    return t.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query("low_range_dims", f"""WITH {EMB_LONG}, s AS (SELECT label, dim, quantile_cont(value,0.01) AS q01, quantile_cont(value,0.99) AS q99 FROM emb_long GROUP BY 1,2)
SELECT label, dim, round(q99-q01,6) AS width FROM s WHERE abs(q99-q01) < 0.45""")
def low_range_dims(spark, d):
    from gaitworks.operators import stats as S

    t = S.full_stats(V.explode_vector(emb(spark, d), "embedding", ["label"]), ["label", "dim"], few_groups=True)
    w = F.col("q99") - F.col("q01")
    return t.where(F.abs(w) < 0.45).select("label", F.col("dim").cast("bigint").alias("dim"), F.round(w, 6).alias("width"))


@query("corrupt_episode_check", """SELECT label, count(*) FILTER (vec_id%11=0) AS state_null, count(*) FILTER (vec_id%7=0 AND vec_id%11<>0) AS state_wrong_width, count(*) AS action_missing FROM embeddings GROUP BY label""")
def corrupt_episode_check(spark, d):
    broken = F.when(F.col("vec_id") % 11 == 0, F.lit(None)).when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    return C.width_report(emb(spark, d).withColumn("state", broken), {"state": 64, "action": 36}, ["label"])


@query("usable_steps", f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM frames) SELECT episode_index, frame_index FROM n WHERE frame_index < n-3""")
def usable_steps(spark, d):
    f = frames(spark, d).select("episode_index", "frame_index")
    got = ordering.over_frames(f, {"_last": lambda w: F.lead("frame_index", 3).over(w)}, after=3)
    return got.where("_last is not null").select("episode_index", "frame_index")
