"""Pack surgery, set operations and ordered lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.session import stored
from gaitworks.operators import ordering, packs
from gaitworks.plans.registry import query
from gaitworks.plans.tables import FRAMES, SIGNAL, STATE_LONG, frames, signal, steps, table


def _episodes(spark, d):
    return steps(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))


EPS = "eps AS (SELECT l_orderkey AS episode_index, count(*) AS length FROM lineitem GROUP BY 1)"


@query("merge_packs", f"""WITH {SIGNAL}, u AS (SELECT CASE WHEN user_id%2=0 THEN 'even' ELSE 'odd' END AS source_dataset, user_id%2 AS r, user_id AS source_episode_index, frame_index, event_type AS task FROM signal),
 e AS (SELECT r, source_episode_index, count(*) AS length FROM u GROUP BY 1,2), n AS (SELECT *, row_number() OVER (ORDER BY r, source_episode_index)-1 AS episode_index, sum(length) OVER (ORDER BY r, source_episode_index)-length AS off FROM e),
 g AS (SELECT u.source_dataset, u.source_episode_index, n.episode_index, frame_index, (off+frame_index)::bigint AS index, task FROM u JOIN n ON u.r=n.r AND u.source_episode_index=n.source_episode_index),
 t AS (SELECT task, row_number() OVER (ORDER BY min(index))-1 AS task_index FROM g GROUP BY task)
SELECT g.*, t.task_index FROM g JOIN t ON g.task=t.task""")
def merge_packs(spark, d):
    s = signal(spark, d).select(F.col("user_id").alias("episode_index"), "frame_index", F.col("event_type").alias("task"))
    return packs.merge_packs({"even": s.where("episode_index % 2 = 0"), "odd": s.where("episode_index % 2 = 1")})


@query("union_common_columns", """SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, 'customer' AS source FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier""")
def union_common_columns(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "c_name name", "c_nationkey nation", "c_acctbal balance", "c_mktsegment segment")
    s = table(spark, d, "supplier").selectExpr("s_name name", "s_nationkey nation", "s_acctbal balance", "s_suppkey")
    return packs.union_common({"customer": c, "supplier": s})[0]


@query("split_train_val", f"""WITH {EPS}, s AS (SELECT episode_index, length, CASE WHEN episode_index IN (SELECT o_orderkey FROM orders WHERE o_orderpriority='1-URGENT') THEN 'val' ELSE 'train' END AS split FROM eps)
SELECT *, row_number() OVER (PARTITION BY split ORDER BY episode_index)-1 AS new_index FROM s""")
def split_train_val(spark, d):
    episodes = _episodes(spark, d)
    val = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("episode_index"))
    return packs.split_train_val(episodes, val.join(episodes, "episode_index", "left_semi"))  # orders without lines are no episodes


@query("split_train_val_stats", f"""WITH {STATE_LONG}, d AS (SELECT dim::bigint AS dim, count(*) AS count, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std,
 round(quantile_cont(value,0.01),6) AS q01, round(quantile_cont(value,0.99),6) AS q99 FROM state_long GROUP BY 1),
 s AS (SELECT CASE WHEN o_orderpriority='1-URGENT' THEN 'val' ELSE 'train' END AS split, count(DISTINCT l_orderkey) AS episodes, count(*) AS frames FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1)
SELECT split, episodes, frames, dim, count, mean, std, q01, q99 FROM s, d""")
def split_train_val_stats(spark, d):
    """The meta data of both splits: own counts, statistics of the whole source."""
    from gaitworks.functions import vectors as V
    from gaitworks.operators import stats as S

    own = split_train_val(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("episodes"), F.sum("length").alias("frames"))
    whole = S.full_stats(V.explode_vector(steps(spark, d), "state"), ["dim"], few_groups=True)
    t = packs.split_statistics(whole).join(own, "split")
    return t.select("split", "episodes", "frames", F.col("dim").cast("bigint").alias("dim"), "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q01", "q99")])


@query("split_by_task", """WITH k AS (SELECT p_partkey AS task_index, row_number() OVER (ORDER BY p_partkey)-1 AS new_task_index FROM part WHERE p_type='PROMO')
SELECT l_orderkey AS episode_index, l_linenumber, task_index, new_task_index FROM lineitem JOIN k ON l_partkey=task_index""")
def split_by_task(spark, d):
    tasks = table(spark, d, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("task_index"))
    return packs.split_by_task(steps(spark, d), tasks)[0].select("episode_index", "l_linenumber", "task_index", "new_task_index")


@query("split_by_task_stats", """SELECT u.dim::bigint AS dim, count(*) AS count, round(avg(CASE u.dim WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice WHEN 2 THEN l_discount ELSE l_tax END),4) AS mean
FROM lineitem JOIN part ON l_partkey=p_partkey, (VALUES (0),(1),(2),(3)) u(dim) WHERE p_type='PROMO' GROUP BY 1""")
def split_by_task_stats(spark, d):
    """Statistics recomputed over the kept tasks."""
    from gaitworks.functions import vectors as V
    from gaitworks.operators import stats as S

    tasks = table(spark, d, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("task_index"))
    kept, _ = packs.split_by_task(steps(spark, d), tasks)
    st = S.moment_stats(V.explode_vector(kept, "state"), ["dim"])
    return st.select(F.col("dim").cast("bigint").alias("dim"), "count", F.round("mean", 4).alias("mean"))


NAME = "lower(p_type) || CASE p_size%3 WHEN 0 THEN '_new' WHEN 1 THEN '_clean' ELSE '' END || '_' || p_size::varchar"


@query("split_by_group", """WITH g AS (SELECT p_partkey, CASE lower(p_type) WHEN 'promo' THEN 'special' ELSE lower(p_type) END AS grp, p_size FROM part),
 r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p_size, p_partkey)-1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM g),
 k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(pos - n//2), p_size, p_partkey) AS rk FROM r)
SELECT grp, p_partkey AS episode_index, p_size AS length FROM k WHERE rk <= 4""")
def split_by_group(spark, d):
    suffix = F.when(F.col("p_size") % 3 == 0, "_new").when(F.col("p_size") % 3 == 1, "_clean").otherwise("")
    name = F.concat(F.lower("p_type"), suffix, F.lit("_"), F.col("p_size").cast("string"))
    p = table(spark, d, "part").select(packs.group_name(name, {"promo": "special"}).alias("grp"), F.col("p_partkey").alias("episode_index"), F.col("p_size").alias("length"))
    return packs.holdout_near_median(p, "grp", 4)


@query("classify_task_text", """SELECT p_partkey, CASE WHEN contains(p_name,'ring') THEN 'small' WHEN contains(p_name,'red') THEN 'colour' ELSE 'UNGROUPED' END AS grp FROM part""")
def classify_task_text(spark, d):
    return table(spark, d, "part").select("p_partkey", packs.classify(F.col("p_name"), {"ring": "small", "red": "colour"}).alias("grp"))


@query("split_modulo", f"""WITH {EPS} SELECT episode_index, length, CASE WHEN episode_index%7=0 THEN 'val' ELSE 'train' END AS split FROM eps""")
def split_modulo(spark, d):
    return packs.split_modulo(_episodes(spark, d), 0.15)


@query("split_names_seeded", """WITH h AS (SELECT c_name AS name, row_number() OVER (ORDER BY ('0x'||substr(sha256('val-'||c_name),1,8))::bigint, c_name)-1 AS i FROM customer)
SELECT name, CASE WHEN i < greatest(1, floor((SELECT count(*) FROM customer)*0.1)) THEN 'val' ELSE 'train' END AS split FROM h""")
def split_names_seeded(spark, d):
    return packs.split_seeded(table(spark, d, "customer").select(F.col("c_name").alias("name")), "name", 0.1, "val")


@query("step_filter_except", f"""WITH {FRAMES} SELECT episode_index, frame_index FROM frames WHERE NOT (s2 = 0 AND l_linestatus='F')""")
def step_filter_except(spark, d):
    f = frames(spark, d)
    listed = f.where((F.get("state", 2) == 0) & (F.col("l_linestatus") == "F")).select("episode_index", "frame_index")
    return f.select("episode_index", "frame_index").join(listed, ["episode_index", "frame_index"], "left_anti")


@query("name_set_diff", """SELECT p_name AS name, 'source_only' AS side FROM (SELECT p_name FROM part WHERE p_size < 26 EXCEPT ALL SELECT p_name FROM part WHERE p_size >= 26)
UNION ALL SELECT p_name, 'reference_only' FROM (SELECT p_name FROM part WHERE p_size >= 26 EXCEPT ALL SELECT p_name FROM part WHERE p_size < 26)""")
def name_set_diff(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), "p_size")
    return packs.name_diff(p.where("p_size < 26"), p.where("p_size >= 26"), "name")


@query("intersect_index_ranges", f"""WITH {EPS}, o AS (SELECT episode_index, (sum(length) OVER (ORDER BY episode_index)-length)::bigint AS a, (sum(length) OVER (ORDER BY episode_index))::bigint AS z FROM eps),
 w AS (SELECT count(*) AS n FROM lineitem) SELECT episode_index, greatest(a, n//4)::bigint AS from_index, least(z, n//2)::bigint AS to_index FROM o, w WHERE greatest(a, n//4) < least(z, n//2)""")
def intersect_index_ranges(spark, d):
    o = packs.episode_offsets(_episodes(spark, d), ["episode_index"])
    n = table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))
    lo, hi = n.select(F.expr("n div 4")).scalar(), n.select(F.expr("n div 2")).scalar()
    r = o.select("episode_index", F.col("offset").alias("a"), (F.col("offset") + F.col("length")).alias("z"))
    return packs.intersect_ranges(r, "a", "z", lo, hi).select("episode_index", "from_index", "to_index")


UNREAD = ["o_orderstatus", "o_totalprice", "o_orderpriority"]


def _pruned(spark, d):
    """orders as frames, and a features table of its columns with the values that each holds."""
    o = table(spark, d, "orders")
    features = o.agg(*[F.count(c).alias(c) for c in o.columns]).unpivot([], o.columns, "name", "values")
    return packs.prune_features(o, features, UNREAD)


@query("prune_features", """SELECT o_orderkey, o_custkey, o_orderdate FROM orders""")
def prune_features(spark, d):
    return _pruned(spark, d)[0]


@query("prune_features_declared", """SELECT 'o_orderkey' AS name, count(o_orderkey) AS "values" FROM orders UNION ALL SELECT 'o_custkey', count(o_custkey) FROM orders
UNION ALL SELECT 'o_orderdate', count(o_orderdate) FROM orders""")
def prune_features_declared(spark, d):
    return _pruned(spark, d)[1]


@query("backfill_names", """WITH f AS (SELECT DISTINCT p_type AS name FROM part) SELECT name, CASE WHEN name='PROMO' THEN 'a0,a1,h0' ELSE '' END AS names FROM f""")
def backfill_names(spark, d):
    f = table(spark, d, "part").select(F.col("p_type").alias("name")).distinct().withColumn("names", F.array().cast("array<string>"))
    t = packs.backfill_names(f, "PROMO", {"hand": ["h0"], "arm": ["a0", "a1"]}, ["arm", "hand"], 3)
    return t.select("name", F.array_join("names", ",").alias("names"))


@query("group_spans", f"""WITH {SIGNAL}, g AS (SELECT user_id, frame_index, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY frame_index) THEN 0 ELSE 1 END AS f FROM signal),
 r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY frame_index) AS run FROM g)
SELECT user_id, event_type, min(frame_index) AS start, max(frame_index)+1 AS "end" FROM r GROUP BY user_id, event_type, run""")
def group_spans(spark, d):
    return packs.group_spans(signal(spark, d).select("user_id", "frame_index", "event_type"), ["user_id"], "frame_index", "event_type")


@query("stats_rename", """SELECT 'state/actions' AS feature, l_returnflag AS embodiment, round(avg(l_tax),6) AS mean FROM lineitem GROUP BY 2
UNION ALL SELECT 'states', l_returnflag, round(avg(l_discount),6) FROM lineitem GROUP BY 2""")
def stats_rename(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("embodiment")).agg(F.avg("l_tax").alias("states/action"), F.avg("l_discount").alias("states"))
    written = stored(li.unpivot("embodiment", ["states/action", "states"], "feature", "mean"), "stats")
    return packs.rename_feature(written, "states/action", "state/actions").withColumn("mean", F.round("mean", 6))


@query("nested_subsets", """WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY ('0x'||substr(sha256('sub-'||o_orderkey::varchar),1,8))::bigint, o_orderkey)-1 AS rank FROM orders), s(share) AS (VALUES (0.1::double),(0.25::double),(0.5::double))
SELECT o_orderkey, share, rank FROM h, s WHERE rank < floor((SELECT count(*) FROM orders)*share)""")
def nested_subsets(spark, d):
    return packs.nested_subsets(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", [0.1, 0.25, 0.5], "sub")


@query("even_chunks", """WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)-1 AS position FROM orders)
SELECT o_orderkey, position, floor(position/ceil((SELECT count(*) FROM orders)/7.0))::bigint AS chunk FROM h""")
def even_chunks(spark, d):
    return packs.even_chunks(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("split_skip", """WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)-1 AS i FROM orders) SELECT o_orderkey, i%5=0 AS evaluation FROM h""")
def split_skip(spark, d):
    t = ordering.global_index(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "i")
    return t.select("o_orderkey", (F.col("i") % 5 == 0).alias("evaluation"))


# --- sorts, limits, top-k ---------------------------------------------------------------------

@query("sort_episodes", r"""SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey)-1 AS position FROM part""")
def sort_episodes(spark, d):
    """Numeric episode order inside case-folded task order: tasks are numbered first, then both become one rank."""
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("task"), F.format_string("episode_%d", "p_partkey").alias("folder"))
    tasks = ordering.global_index(p.select("task").distinct(), ["task"], "t")
    n = F.regexp_extract("folder", r"(\d+)$", 1).cast("bigint")
    t = p.withColumn("n", n).join(tasks, "task")
    return ordering.global_index(t, ["t", "n"], "position").select("p_partkey", "position")


@query("limit_episodes", """SELECT l_suppkey, l_orderkey FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) <= 10""")
def limit_episodes(spark, d):
    e = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    return ordering.first_rows(e, ["l_suppkey"], [F.col("l_orderkey")], 10).drop("_rn")


@query("worst_dims_topk", """WITH l AS (SELECT unnest(range(64)) AS dim, unnest(embedding::double[]) AS x FROM embeddings) SELECT dim, round(avg(abs(x*0.1-0.01)),6) AS err FROM l GROUP BY 1 ORDER BY avg(abs(x*0.1-0.01)) DESC, dim LIMIT 5""")
def worst_dims_topk(spark, d):
    from gaitworks.functions import vectors as V
    from gaitworks.plans.tables import emb

    t = V.explode_vector(emb(spark, d), "embedding").groupBy("dim").agg(F.avg(F.abs(F.col("value") * 0.1 - 0.01)).alias("e"))
    return t.orderBy(F.col("e").desc(), "dim").limit(5).select(F.col("dim").cast("bigint").alias("dim"), F.round("e", 6).alias("err"))


@query("stable_task_order", """SELECT p_name AS task, row_number() OVER (ORDER BY min(p_partkey))-1 AS task_index FROM part GROUP BY p_name""")
def stable_task_order(spark, d):
    return packs.stable_order(table(spark, d, "part").select(F.col("p_name").alias("task"), "p_partkey"), "task", "p_partkey", "task_index")


@query("custom_order", """SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY coalesce(list_position(['view','signup','click'], event_type), 99), event_type)-1 AS place FROM events GROUP BY 1""")
def custom_order(spark, d):
    t = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    at = F.coalesce(F.nullif(F.array_position(F.array(F.lit("view"), F.lit("signup"), F.lit("click")), F.col("event_type")), F.lit(0)), F.lit(99))
    # one row per registered task
    return ordering.global_index(t.withColumn("at", at), ["at", "event_type"], "place").drop("at")


@query("modal_value", """WITH c AS (SELECT l_orderkey AS episode_index, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1,2)
SELECT episode_index, arg_max(v, row(n, -ascii(v))) AS mode, CASE WHEN count(*)=1 THEN min(v) ELSE 'mixed' END AS robot_type FROM c GROUP BY 1""")
def modal_value(spark, d):
    c = steps(spark, d).groupBy("episode_index", "embodiment").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("episode_index").agg(
        F.max_by("embodiment", F.struct("n", -F.ascii("embodiment"))).alias("mode"),
        F.when(F.count(F.lit(1)) == 1, F.min("embodiment")).otherwise("mixed").alias("robot_type"))
