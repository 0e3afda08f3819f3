"""Dictionary, nearest-time, interval and catalogue joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.functions import hashing
from gaitworks.operators import joins as J
from gaitworks.operators import ordering
from gaitworks.plans.registry import query
from gaitworks.plans.tables import FRAMES, SIGNAL, emb, frames, micros, signal, steps, table

BARE = "f.episode_index, f.frame_index"


def bare(spark, d):
    return frames(spark, d).select("episode_index", "frame_index", "task_index")


@query("task_text_join", f"""WITH {FRAMES} SELECT {BARE}, p_name AS task FROM frames f JOIN part ON f.task_index=p_partkey""")
def task_text_join(spark, d):
    tasks = table(spark, d, "part").select(F.col("p_partkey").alias("task_index"), F.col("p_name").alias("task"))
    return J.must_resolve(bare(spark, d), tasks, ["task_index"], "task").select("episode_index", "frame_index", "task")


@query("episode_meta_broadcast", f"""WITH {FRAMES} SELECT {BARE}, o_orderstatus AS scene, 'lab-1' AS site FROM frames f LEFT JOIN orders ON o_orderkey=f.episode_index""")
def episode_meta_broadcast(spark, d):
    f = bare(spark, d)
    meta = ordering.episode_lengths(f).join(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_index"), F.col("o_orderstatus").alias("scene")), "episode_index", "left")
    return ordering.per_episode(f, meta).select("episode_index", "frame_index", "scene", F.lit("lab-1").alias("site"))


@query("text_to_task_join", """WITH t AS (SELECT p_name AS task, min(p_partkey) AS task_index FROM part GROUP BY 1)
SELECT p_partkey AS episode, t.task_index FROM part JOIN t ON p_name=t.task""")
def text_to_task_join(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("episode"), F.col("p_name").alias("task"))
    tasks = p.groupBy("task").agg(F.min("episode").alias("task_index"))
    return J.must_resolve(p, tasks, ["task"], "task_index").select("episode", "task_index")


TOL = 3600 * 4


def _streams(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", (micros("ts") / 1e6).alias("t"))
    ik = e.where(F.col("event_type").isin("purchase", "signup"))
    robot = e.where(~F.col("event_type").isin("purchase", "signup"))
    robot = ordering.row_index(robot, ["user_id"], ["t", "event_id"])
    return robot, ik.select("user_id", F.col("t").alias("armtime"), F.col("event_id").alias("ik_id"), F.col("value").alias("ik_value"))


@query("nearest_asof_join", f"""WITH e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts)/1e6 AS t FROM events),
 r AS (SELECT * FROM e WHERE event_type NOT IN ('purchase','signup')), k AS (SELECT * FROM e WHERE event_type IN ('purchase','signup')),
 m AS (SELECT r.user_id, r.event_id, r.t, arg_min(k.event_id, row(abs(k.t-r.t), k.event_id)) AS ik FROM r JOIN k ON r.user_id=k.user_id AND abs(k.t-r.t) <= {TOL} GROUP BY 1,2,3),
 f AS (SELECT r.user_id, r.event_id, m.ik IS NOT NULL AS fresh, last_value(m.ik IGNORE NULLS) OVER (PARTITION BY r.user_id ORDER BY r.t, r.event_id) AS ik
  FROM r LEFT JOIN m ON r.event_id=m.event_id),
 s AS (SELECT user_id, min(t) AS t0 FROM r GROUP BY 1), g AS (SELECT user_id, min(t) AS k0, arg_min(event_id, t) AS first_ik FROM k GROUP BY 1)
SELECT f.user_id, f.event_id, f.fresh, coalesce(f.ik, CASE WHEN k0 <= t0 THEN first_ik END) AS ik_id FROM f LEFT JOIN s ON f.user_id=s.user_id LEFT JOIN g ON f.user_id=g.user_id""")
def nearest_asof_join(spark, d):
    robot, ik = _streams(spark, d)
    got = J.nearest_asof(robot, ik, ["user_id"], "t", "armtime", "ik_id", ["ik_id", "ik_value"], float(TOL))
    return got.select("user_id", "event_id", "fresh", "ik_id")


@query("forward_asof_join", f"""WITH {SIGNAL}, g AS (SELECT user_id, frame_index+1 AS mark, event_id AS path FROM signal WHERE event_type='purchase'),
 l AS (SELECT user_id, max(frame_index) AS n FROM signal GROUP BY 1)
SELECT s.user_id, s.frame_index, coalesce((SELECT min(path) FROM g WHERE g.user_id=s.user_id AND g.mark >= s.frame_index AND g.mark = (SELECT min(mark) FROM g h WHERE h.user_id=s.user_id AND h.mark >= s.frame_index)), -1) AS goal FROM signal s""")
def forward_asof_join(spark, d):
    s = signal(spark, d).select("user_id", "frame_index", "event_type", "event_id")
    marks = s.where("event_type = 'purchase'").select("user_id", (F.col("frame_index") + 1).alias("mark"), F.col("event_id").alias("goal"))
    return J.forward_asof(s.select("user_id", "frame_index"), marks, ["user_id"], "frame_index", "mark", "goal", F.lit(-1).cast("bigint"))


SPANS = "sp AS (SELECT user_id, frame_index AS a, frame_index+3 AS z, event_type AS text, event_id AS ord FROM signal WHERE event_type IN ('error','purchase'))"


@query("span_interval_join", f"""WITH {SIGNAL}, {SPANS}, h AS (SELECT s.user_id, s.frame_index, arg_min(sp.text, sp.ord) AS text FROM signal s JOIN sp ON s.user_id=sp.user_id AND s.frame_index BETWEEN a AND z GROUP BY 1,2)
SELECT s.user_id, s.frame_index, coalesce(h.text,'') AS text FROM signal s LEFT JOIN h ON s.user_id=h.user_id AND s.frame_index=h.frame_index""")
def span_interval_join(spark, d):
    s = signal(spark, d).select("user_id", "frame_index", "event_type", "event_id")
    sp = s.where("event_type in ('error', 'purchase')").select(
        "user_id", F.col("frame_index").alias("a"), (F.col("frame_index") + 3).alias("z"), F.col("event_type").alias("text"), F.col("event_id").alias("ord"))
    return J.first_span(s.select("user_id", "frame_index"), sp, ["user_id"], "frame_index", "a", "z", "ord", "text")


@query("keep_range_join", f"""WITH {SIGNAL}, kr AS (SELECT user_id, frame_index AS a, frame_index+2 AS z FROM signal WHERE event_type='purchase' AND user_id % 5 <> 0)
SELECT user_id, frame_index FROM signal s WHERE user_id NOT IN (SELECT user_id FROM kr) OR EXISTS (SELECT 1 FROM kr WHERE kr.user_id=s.user_id AND s.frame_index >= a AND s.frame_index < z)""")
def keep_range_join(spark, d):
    s = signal(spark, d).select("user_id", "frame_index", "event_type")
    kr = s.where("event_type = 'purchase' and user_id % 5 <> 0").select("user_id", F.col("frame_index").alias("a"), (F.col("frame_index") + 2).alias("z"))
    return J.keep_ranges(s.select("user_id", "frame_index"), kr, ["user_id"], "frame_index", "a", "z")


@query("local_catalogue_semi_join", """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def local_catalogue_semi_join(spark, d):
    local = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(local, "o_orderkey", "left_semi")


@query("catalogue_gap_report", """SELECT o_orderkey AS episode, 'catalogue_only' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT l_orderkey, 'local_only' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='P')
UNION ALL SELECT o_orderkey, 'catalogue_only' FROM orders WHERE 1=0""")
def catalogue_gap_report(spark, d):
    """Open orders are left out of the catalogue so that both directions have rows."""
    o = table(spark, d, "orders")
    local = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode"))
    empty = o.join(local.withColumnRenamed("episode", "o_orderkey"), "o_orderkey", "left_anti")
    cat = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("episode")).unionByName(
        empty.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("episode")))
    return J.gap_report(cat, local, "episode")


STATE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("stats_join_normalise", "WITH s AS (SELECT l_returnflag AS embodiment, " + ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(STATE_COLUMNS))
       + " FROM lineitem GROUP BY 1) SELECT l_orderkey AS episode_index, l_linenumber, l_partkey AS task_index, embodiment, "
       + ", ".join(f"round(2*({c}-lo{i})/(hi{i}-lo{i})-1,6) AS v{i}" for i, c in enumerate(STATE_COLUMNS)) + " FROM lineitem JOIN s ON l_returnflag=embodiment")
def stats_join_normalise(spark, d):
    from gaitworks.functions import vectors as V
    from gaitworks.operators import normalise as N
    from gaitworks.operators import stats as S

    f = steps(spark, d)
    long = V.explode_vector(f, "state", ["embodiment"])
    st = S.stats_vectors(S.moment_stats(long, ["embodiment", "dim"]), ["embodiment"], columns=("min", "max"))
    t = N.with_stats(f, st, ["embodiment"]).withColumn("y", N.min_max("state"))
    return t.select("episode_index", "l_linenumber", "task_index", "embodiment", *[F.round(F.get("y", i), 6).alias(f"v{i}") for i in range(4)])


@query("compare_runs_join", """WITH a AS (SELECT event_id AS tick, value FROM events WHERE event_id % 10 <> 3), b AS (SELECT event_id AS tick, value*1.01 AS value FROM events WHERE event_id % 10 <> 7),
 n AS (SELECT least((SELECT count(*) FROM a),(SELECT count(*) FROM b)) AS n)
SELECT a.tick, round(abs(a.value-b.value),6) AS err FROM a JOIN b ON a.tick=b.tick WHERE a.tick < (SELECT n FROM n)""")
def compare_runs_join(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("tick"), "value")
    a, b = e.where("tick % 10 <> 3"), e.where("tick % 10 <> 7").select("tick", (F.col("value") * 1.01).alias("other"))
    n = a.agg(F.count(F.lit(1)).alias("n")).unionAll(b.agg(F.count(F.lit(1)).alias("n"))).agg(F.min("n"))
    t = a.join(b, "tick").where(F.col("tick") < n.scalar())
    return t.select("tick", F.round(F.abs(F.col("value") - F.col("other")), 6).alias("err"))


@query("pred_truth_join", f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM frames), d(h) AS (VALUES (0),(1),(2)),
 p AS (SELECT b.episode_index, b.frame_index, d.h, t.a0*1.01+d.h AS p0, t.a1*1.01+d.h AS p1, t.a2*1.01+d.h AS p2, t.a3*1.01+d.h AS p3 FROM n b, d, frames t WHERE t.episode_index=b.episode_index AND t.frame_index=least(b.frame_index+d.h,b.n-1))
SELECT p.episode_index, p.frame_index, p.h::bigint AS horizon, round(abs(p.p0-f.a0),6) AS err0, round(abs(p.p1-f.a1),6) AS err1, round(abs(p.p2-f.a2),6) AS err2, round(abs(p.p3-f.a3),6) AS err3 FROM p JOIN frames f ON f.episode_index=p.episode_index AND f.frame_index=p.frame_index+p.h""")
def pred_truth_join(spark, d):
    from gaitworks.operators import windows

    f = frames(spark, d, "action")
    pred = windows.action_chunk(f, "action", 3).select("episode_index", F.col("frame_index").alias("base"), F.posexplode("chunk").alias("horizon", "a"))
    pred = pred.select("episode_index", "base", "horizon", (F.col("base") + F.col("horizon")).alias("frame_index"), F.transform("a", lambda x: x * 1.01 + F.col("horizon")).alias("pred"))
    truth = f.select("episode_index", "frame_index", F.col("action").alias("truth"))
    t = pred.join(truth, ["episode_index", "frame_index"])
    return t.select("episode_index", F.col("base").alias("frame_index"), F.col("horizon").cast("bigint").alias("horizon"), *[F.round(F.abs(F.get("pred", i) - F.get("truth", i)), 6).alias(f"err{i}") for i in range(4)])


@query("paraphrase_join", """WITH t AS (SELECT lower(trim(p_type)) AS k, list_sort(list(DISTINCT p_type || ' ' || p_size::varchar)) AS c FROM part GROUP BY 1),
 x AS (SELECT p_partkey, p_type, c, ('0x'||substr(sha256('para-'||p_partkey::varchar),1,8))::bigint AS h FROM part JOIN t ON lower(trim(p_type))=t.k)
SELECT p_partkey, coalesce(c[h % len(c) + 1], p_type) AS prompt FROM x""")
def paraphrase_join(spark, d):
    p = table(spark, d, "part")
    # a canonical text has a fixed list of paraphrases; here type x size, bounded by the catalogue of sizes
    para = p.groupBy(F.lower(F.trim("p_type")).alias("k")).agg(F.sort_array(F.collect_set(F.concat_ws(" ", "p_type", "p_size"))).alias("c"))
    t = p.withColumn("k", F.lower(F.trim("p_type"))).join(para, "k", "left")
    h = hashing.draw32("para", F.col("p_partkey"))
    return t.select("p_partkey", F.coalesce(F.get("c", (h % F.size("c")).cast("int")), F.col("p_type")).alias("prompt"))


@query("grouping_cross_check", """SELECT p_partkey, p_type AS manifest, CASE WHEN p_name LIKE '%ring%' THEN 'SMALL' WHEN p_name LIKE '%gear%' THEN 'LARGE' ELSE 'UNGROUPED' END AS by_text FROM part
WHERE p_type <> CASE WHEN p_name LIKE '%ring%' THEN 'SMALL' WHEN p_name LIKE '%gear%' THEN 'LARGE' ELSE 'UNGROUPED' END""")
def grouping_cross_check(spark, d):
    from gaitworks.operators import packs

    p = table(spark, d, "part")
    a = p.select("p_partkey", F.col("p_type").alias("manifest"))
    b = p.select("p_partkey", packs.classify(F.col("p_name"), {"ring": "SMALL", "gear": "LARGE"}).alias("by_text"))
    return a.join(b, "p_partkey").where("manifest <> by_text")


INSTR = "i AS (SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey%10=0 THEN '' ELSE p_name END),''),'do the task') AS instruction FROM part)"


def _instructions(spark, d):
    from gaitworks.functions import projections as P

    p = table(spark, d, "part")
    raw = F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.col("p_name"))
    return p.select("p_partkey", P.default_text(raw, "do the task").alias("instruction"))


@query("embedding_lookup", f"""WITH {INSTR}, v AS (SELECT instruction, min(p_partkey) % (SELECT count(*) FROM embeddings) AS vec_id FROM i GROUP BY 1)
SELECT p_partkey, sha1(i.instruction) AS key, v.vec_id::bigint AS vec_id, round(e.embedding[1]::double,6) AS v0 FROM i JOIN v ON i.instruction=v.instruction JOIN embeddings e ON e.vec_id=v.vec_id""")
def embedding_lookup(spark, d):
    i = _instructions(spark, d)
    n = emb(spark, d).agg(F.count(F.lit(1)))
    store = i.groupBy("instruction").agg(F.min("p_partkey").alias("m")).select(F.sha1("instruction").alias("key"), (F.col("m") % n.scalar()).alias("vec_id"))
    store = store.join(emb(spark, d), "vec_id")
    t = i.select("p_partkey", F.sha1("instruction").alias("key")).join(store, "key")
    return t.select("p_partkey", "key", "vec_id", F.round(F.get("embedding", 0), 6).alias("v0"))


@query("distinct_instruction_map", f"""WITH {INSTR} SELECT DISTINCT instruction, sha1(instruction) AS name FROM i""")
def distinct_instruction_map(spark, d):
    return _instructions(spark, d).select("instruction").distinct().withColumn("name", F.sha1("instruction"))
