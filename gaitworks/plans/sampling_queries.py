"""Mixing, hash draws and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.operators import sampling as K
from gaitworks.plans.registry import query
from gaitworks.plans.tables import FRAMES, frames, steps, table


def H(seed: str, *cols: str) -> str:
    key = "||'-'||".join([f"'{seed}'", *[f"{c}::varchar" for c in cols]])
    return f"('0x'||substr(sha256({key}),1,8))::bigint"


# five datasets by supplier, weights fixed by the registry below
WEIGHTS = {0: 1, 1: 2, 2: 3, 3: 1, 4: 5}
W_SQL = "w(dataset, weight) AS (VALUES (0::bigint,1),(1,2),(2,3),(3,1),(4,5))"
EPS = f"""ep AS (SELECT l_suppkey%5 AS dataset, l_orderkey AS episode_index, count(*) AS length, greatest(count(*)-1,0) AS usable, l_orderkey%11=0 AS bad FROM lineitem GROUP BY 1,2,5)"""


# the registry: regions as datasets, weighing what their nations weigh
R_SQL = "w AS (SELECT n_regionkey::bigint AS dataset, sum(1 + n_nationkey % 4)::bigint AS weight FROM nation GROUP BY 1)"


def _registry(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("dataset")).agg(F.sum(1 + F.col("n_nationkey") % 4).cast("bigint").alias("weight"))


def _weights(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 5).alias("dataset")).distinct()
    w = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("dataset").cast("int"))
    return s.withColumn("weight", w)


def _episodes(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("dataset"), F.col("l_orderkey").alias("episode_index"))
    e = li.groupBy("dataset", "episode_index").agg(F.count(F.lit(1)).alias("length"))
    return e.withColumns({"usable": F.greatest(F.col("length") - 1, F.lit(0)), "bad": F.col("episode_index") % 11 == 0})


@query("mixture_weights", f"""WITH {EPS}, {W_SQL}, x AS (SELECT *, CASE WHEN bad THEN 0 ELSE usable END AS ew FROM ep), p AS (SELECT x.dataset, sum(ew) AS t, weight*sum(length) AS dw FROM x JOIN w ON x.dataset=w.dataset GROUP BY x.dataset, weight)
SELECT x.dataset, episode_index, round(dw/(SELECT sum(dw) FROM p),9) AS dataset_weight, round(ew/t,9) AS episode_weight FROM x JOIN p ON x.dataset=p.dataset""")
def mixture_weights(spark, d):
    t = K.mixture_weights(_episodes(spark, d), _weights(spark, d), "dataset")
    return t.select("dataset", "episode_index", F.round("dataset_weight", 9).alias("dataset_weight"), F.round("episode_weight", 9).alias("episode_weight"))


def ALIAS(source: str) -> str:
    """Alias table ``al`` of (dataset, weight): lights take from the heavy one at their gap's start, a heavy one that gives too much from the next."""
    return f"""g AS (SELECT dataset, (weight*count(*) OVER ())::bigint AS m, (sum(weight) OVER ())::bigint AS t FROM {source} WHERE weight > 0),
 g1 AS (SELECT *, sign(m-t) AS side FROM g),
 g2 AS (SELECT *, row_number() OVER (ORDER BY side, dataset)-1 AS cell, (sum(abs(m-t)) OVER (PARTITION BY side ORDER BY dataset))::bigint AS hi, lead(dataset) OVER (PARTITION BY side ORDER BY dataset) AS nxt FROM g1),
 al AS (SELECT x.cell, x.dataset AS own, (SELECT count(*) FROM g) AS cells,
  CASE side WHEN 0 THEN t WHEN -1 THEN m ELSE t - ((SELECT min(l.hi) FROM g2 l WHERE l.side=-1 AND l.hi >= x.hi) - x.hi) END / t AS keep,
  CASE side WHEN -1 THEN (SELECT arg_min(h.dataset, h.hi) FROM g2 h WHERE h.side=1 AND h.hi > x.hi-abs(x.m-x.t)) ELSE coalesce(nxt, dataset) END AS other FROM g2 x)"""


def DRAW(seed: str, key: str, rows: str, name: str) -> str:
    return f"""SELECT {key} AS {name}, CASE WHEN {H(seed + '-coin', key)}/4294967296.0 < keep THEN own ELSE other END AS dataset FROM {rows} JOIN al ON floor({H(seed, key)}/4294967296.0*cells)::bigint = cell"""


@query("mixture_sample", f"""WITH {EPS}, {R_SQL}, k AS (SELECT ep.dataset, weight*sum(length) AS weight FROM ep JOIN w ON ep.dataset=w.dataset GROUP BY ep.dataset, w.weight HAVING sum(CASE WHEN bad THEN 0 ELSE usable END)>0),
 {ALIAS('k')},
 ce AS (SELECT dataset, episode_index, usable, sum(usable) OVER (PARTITION BY dataset ORDER BY episode_index)-usable AS lo, sum(usable) OVER (PARTITION BY dataset ORDER BY episode_index) AS hi, sum(usable) OVER (PARTITION BY dataset) AS t FROM ep WHERE usable>0 AND NOT bad),
 tt AS (SELECT dataset, max(hi) AS t FROM ce GROUP BY 1),
 a AS ({DRAW('mix-d', 'event_id', 'events', 'event_id')}),
 b AS (SELECT a.*, floor({H('mix-e','event_id')}/4294967296.0*t)::bigint AS p FROM a JOIN tt ON a.dataset=tt.dataset)
SELECT event_id, b.dataset, episode_index, floor({H('mix-s','event_id')}/4294967296.0*usable)::bigint AS step FROM b ASOF JOIN ce ON b.dataset=ce.dataset AND b.p >= ce.lo""")
def mixture_sample(spark, d):
    """One draw per event row; steps are drawn below n - max_delta."""
    return K.mixture_sample(table(spark, d, "events").select("event_id"), "event_id", _registry(spark, d), _episodes(spark, d), "mix")


LEN = "ln AS (SELECT l_suppkey%5 AS dataset, count(*) AS length FROM lineitem GROUP BY 1)"


def _lengths(spark, d):
    return _episodes(spark, d).groupBy("dataset").agg(F.sum("length").alias("length"))


@query("batch_mixture", f"""WITH {R_SQL}, {ALIAS('w')}, {LEN}, a AS ({DRAW('bat-d', 'event_id', 'events', 'event_id')})
SELECT event_id, a.dataset, floor({H('bat-i','event_id')}/4294967296.0*length)::bigint AS local_index, event_id%4 AS rank, event_id//4//16 AS batch FROM a JOIN ln ON a.dataset=ln.dataset""")
def batch_mixture(spark, d):
    ds = _registry(spark, d).join(_lengths(spark, d), "dataset")
    return K.batch_mixture(table(spark, d, "events").select("event_id"), "event_id", ds, "bat", 16, 4)


@query("token_budget_batches", f"""WITH {R_SQL}, {ALIAS('w')}, {LEN}, a AS ({DRAW('tok-d-0', 'c_custkey', 'customer', 'batch')}),
 b AS (SELECT *, greatest(1, 2000//(300+100*dataset))::int AS batch_size FROM a), r AS (SELECT *, unnest(range(4))::int AS rank FROM b), s AS (SELECT *, unnest(range(batch_size))::int AS slot FROM r)
SELECT batch, s.dataset, batch_size, rank, slot, floor({H('tok-s-0','batch','rank','slot')}/4294967296.0*length)::bigint AS local_index FROM s JOIN ln ON s.dataset=ln.dataset""")
def token_budget_batches(spark, d):
    ds = _registry(spark, d).join(_lengths(spark, d), "dataset").withColumn("tokens", 300 + 100 * F.col("dataset"))
    return K.token_batches(table(spark, d, "customer").select(F.col("c_custkey").alias("batch")), "batch", ds, 2000, 4, "tok")


@query("task_weighted_sampling", """SELECT l_orderkey, l_linenumber, l_partkey, greatest(CASE WHEN contains(p_name,'ring') THEN 3.0 ELSE 1 END, CASE WHEN contains(p_name,'red') THEN 2.0 ELSE 1 END)::double AS weight FROM lineitem JOIN part ON l_partkey=p_partkey""")
def task_weighted_sampling(spark, d):
    tasks = table(spark, d, "part").select(F.col("p_partkey").alias("task_index"), F.col("p_name").alias("task"))
    t = K.task_weights(steps(spark, d), tasks, {"ring": 3.0, "red": 2.0})
    return t.select(F.col("episode_index").alias("l_orderkey"), "l_linenumber", F.col("task_index").alias("l_partkey"), "weight")


@query("mixture_length", f"""WITH {W_SQL}, {LEN} SELECT max(length/(weight/12.0)) AS epoch_length FROM ln JOIN w ON ln.dataset=w.dataset WHERE weight=1""")
def mixture_length(spark, d):
    """Primary datasets are those with the base weight."""
    t = _weights(spark, d).join(_lengths(spark, d), "dataset").withColumn("primary", F.col("weight") == 1)
    return K.epoch_length(t, 12.0)


@query("mixture_length_no_primary", f"""WITH {LEN} SELECT max(length)::double AS epoch_length FROM ln WHERE dataset <> 4""")
def mixture_length_no_primary(spark, d):
    """The only primary dataset has no weight: the longest of the others counts."""
    t = _weights(spark, d).join(_lengths(spark, d), "dataset").withColumn("primary", F.col("dataset") == 4)
    return K.epoch_length(t.withColumn("weight", F.when(F.col("primary"), 0).otherwise(F.col("weight"))), 12.0)


S = 20


@query("pack_shards_sequential", f"""WITH RECURSIVE e AS (SELECT o_orderkey%3 AS pack, l_orderkey AS episode_index, count(*) AS length FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2),
 n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY episode_index) AS i FROM e),
 f AS (SELECT pack, i, episode_index, length, length AS fill, 0::bigint AS shard FROM n WHERE i=1
  UNION ALL SELECT n.pack, n.i, n.episode_index, n.length, CASE WHEN f.fill >= {S} OR f.fill+n.length > {2 * S} THEN n.length ELSE f.fill+n.length END,
   f.shard + CASE WHEN f.fill >= {S} OR f.fill+n.length > {2 * S} THEN 1 ELSE 0 END FROM f JOIN n ON n.pack=f.pack AND n.i=f.i+1)
SELECT pack, episode_index, length, shard FROM f""")
def pack_shards_sequential(spark, d):
    e = steps(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length")).withColumn("pack", F.col("episode_index") % 3)
    return K.pack_sequential(e, "pack", S)


@query("pack_shards_balanced", f"""WITH {FRAMES} SELECT episode_index, frame_index, (row_number() OVER (ORDER BY {H('bal','episode_index','frame_index')}, episode_index, frame_index)-1)%16 AS shard FROM frames""")
def pack_shards_balanced(spark, d):
    f = frames(spark, d).select("episode_index", "frame_index")
    return K.balanced_shards(f, ["episode_index", "frame_index"], 16, "bal")


SH = "sh AS (SELECT l_suppkey%5 AS dataset, l_orderkey//500 AS shard, count(*) AS length FROM lineitem GROUP BY 1,2)"


def _shards(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("dataset"), F.expr("l_orderkey div 500").alias("shard"))
    return li.groupBy("dataset", "shard").agg(F.count(F.lit(1)).alias("length"))


@query("shard_schedule", f"""WITH {R_SQL}, {SH}, p AS (SELECT sh.dataset, round(max(weight)/avg(length)*1e9)::bigint AS weight, count(*) AS n FROM sh JOIN w ON sh.dataset=w.dataset GROUP BY 1),
 {ALIAS('p')},
 a AS (SELECT x.*, n FROM ({DRAW('sch-d', 'c_custkey', 'customer', 'draw')}) x JOIN p ON x.dataset=p.dataset),
 k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY draw)-1 AS k FROM a), rr AS (SELECT DISTINCT dataset, k//n AS round FROM k),
 o AS (SELECT sh.dataset, shard, round, row_number() OVER (PARTITION BY sh.dataset, round ORDER BY {H('sch-o','sh.dataset','round','shard')}, shard)-1 AS place FROM sh JOIN rr ON sh.dataset=rr.dataset)
SELECT draw, k.dataset, (k//n) AS round, shard FROM k JOIN o ON o.dataset=k.dataset AND o.round=k//n AND o.place=k%n""")
def shard_schedule(spark, d):
    draws = table(spark, d, "customer").select(F.col("c_custkey").alias("draw"))
    return K.shard_schedule_train(draws, "draw", _shards(spark, d), _registry(spark, d), "sch")


EV = f"{SH}, t AS (SELECT dataset, shard, row_number() OVER (PARTITION BY dataset ORDER BY shard)-1 AS turn FROM sh), ev AS (SELECT dataset, shard, row_number() OVER (ORDER BY turn, dataset)-1 AS position FROM t)"


@query("shard_schedule_eval", f"WITH {EV} SELECT dataset, shard, position FROM ev")
def shard_schedule_eval(spark, d):
    return K.shard_schedule_eval(_shards(spark, d))


@query("assign_shards_to_workers", f"""WITH {EV}, n AS (SELECT count(*) AS n FROM ev), c AS (SELECT ev.*, n, unnest(range(greatest(ceil(400.0/n),1)::bigint)) AS cp FROM ev, n), x AS (SELECT *, position+cp*n AS turn FROM c WHERE cp=0 OR position+cp*n < 400)
SELECT dataset, shard, position, turn, (turn%400)%8 AS rank, (turn%400)//8 AS worker FROM x""")
def assign_shards_to_workers(spark, d):
    return K.assign_slots(K.shard_schedule_eval(_shards(spark, d)), "position", 8, 50)


@query("chunk_shuffle", f"""SELECT o_orderkey, o_orderkey//256 AS chunk, row_number() OVER (ORDER BY {H('shuf-c','(o_orderkey//256)')}, o_orderkey//256, {H('shuf-i','o_orderkey')}, o_orderkey)-1 AS position FROM orders""")
def chunk_shuffle(spark, d):
    return K.chunk_shuffle(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 256, "shuf")


@query("chunk_shuffle_replicas", f"""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), n AS (SELECT count(*) AS n FROM orders), r AS (SELECT *, unnest(range(3)) AS replica FROM n),
 c AS (SELECT o_orderkey, i, replica, (i - n*replica//3)//256 AS chunk FROM o JOIN r ON i >= n*replica//3 AND i < n*(replica+1)//3)
SELECT o_orderkey, i, replica, chunk, row_number() OVER (PARTITION BY replica ORDER BY {H('rep-c','replica','chunk')}, chunk, {H('rep-i','i')}, i) - 1 AS position FROM c""")
def chunk_shuffle_replicas(spark, d):
    from gaitworks.operators import ordering

    o = ordering.global_index(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "i")
    return K.chunk_shuffle_replicas(o, "i", 256, 3, "rep")


@query("sample_fraction", f"""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {H('frac','doc_id')}, doc_id)-1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, doc_id FROM r WHERE i < floor(n*CASE WHEN lang='en' THEN 0.5 ELSE 0.2 END)""")
def sample_fraction(spark, d):
    doc = table(spark, d, "documents").select("lang", "doc_id")
    return K.sample_fraction(doc, ["lang"], "doc_id", F.when(F.col("lang") == "en", 0.5).otherwise(0.2), "frac")


@query("stride_episode", f"""WITH {FRAMES} SELECT episode_index, frame_index FROM frames WHERE frame_index % 3 = 0""")
def stride_episode(spark, d):
    return frames(spark, d).where("frame_index % 3 = 0").select("episode_index", "frame_index")


@query("valid_step_sample_space", f"""WITH {FRAMES} SELECT episode_index, frame_index FROM frames WHERE NOT (s2=0 AND l_linestatus='F') AND episode_index NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='P')""")
def valid_step_sample_space(spark, d):
    f = frames(spark, d)
    listed = f.where((F.get("state", 2) == 0) & (F.col("l_linestatus") == "F")).select("episode_index", "frame_index")
    bad = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("episode_index"))
    good = f.select("episode_index", "frame_index").join(bad, "episode_index", "left_anti")
    return good.join(listed, ["episode_index", "frame_index"], "left_anti")


@query("mix_ratio_weights", f"""WITH {SH}, g AS (SELECT CASE WHEN dataset<2 THEN 'real' ELSE 'sim' END AS grp, dataset, count(*) AS n FROM sh GROUP BY 1,2)
SELECT grp, dataset, round(CASE grp WHEN 'real' THEN 0.7 ELSE 0.3 END*n/sum(n) OVER (PARTITION BY grp),9) AS weight FROM g""")
def mix_ratio_weights(spark, d):
    sh = _shards(spark, d).withColumn("grp", F.when(F.col("dataset") < 2, "real").otherwise("sim"))
    ratios = sh.select("grp").distinct().withColumn("ratio", F.when(F.col("grp") == "real", 0.7).otherwise(0.3))
    t = K.mix_ratio_weights(sh, ratios, "grp", "dataset")
    return t.select("grp", "dataset", F.round("weight", 9).alias("weight"))


@query("parse_sampling_suffix", """SELECT p_partkey, p_name AS name, CASE WHEN p_size%2=0 THEN p_size/100.0 ELSE 1.0 END::double AS rate FROM part""")
def parse_sampling_suffix(spark, d):
    spec = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("%"), F.col("p_size").cast("string"))).otherwise(F.col("p_name"))
    name, rate = K.parse_suffix(F.col("spec"))
    return table(spark, d, "part").withColumn("spec", spec).select("p_partkey", name.alias("name"), rate.alias("rate"))
