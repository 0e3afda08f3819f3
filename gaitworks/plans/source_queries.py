"""Sources and sinks: each query writes what Spark derives from a table and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.functions import vectors as V
from gaitworks.operators import sampling
from gaitworks.plans.registry import query
from gaitworks.plans.tables import FRAMES, emb, frames, steps, table
from gaitworks.session import scratch_dir
from gaitworks.sources import captures
from gaitworks.sources import packs_io as IO


@query("scan_frames", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem WHERE l_quantity > 45")
def scan_frames(spark, d):
    return IO.scan_frames(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_tax"]).where("l_quantity > 45")


@query("scan_meta_jsonl", "SELECT o_orderkey AS episode_index, o_orderpriority AS task, count(*) AS length FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1,2")
def scan_meta_jsonl(spark, d):
    eps = steps(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_index"), F.col("o_orderpriority").alias("task"))
    root = scratch_dir(spark, "meta")
    IO.write_meta(eps.join(o, "episode_index"), o.select("task").distinct(), root)
    return IO.scan_meta(spark, f"{root}/episodes", "episode_index bigint, task string, length bigint")


@query("ingest_raw_episodes", """WITH e AS (SELECT vec_id, embedding::double[] AS v, unnest(range(8)) AS i FROM embeddings)
SELECT vec_id AS episode_index, i AS frame_index, round(i/30.0,6) AS timestamp, i=7 AS done, round(v[i*8+1],6) AS arm0, round(v[i*8+8],6) AS height FROM e""")
def ingest_raw_episodes(spark, d):
    """Each vector becomes a capture document of eight nested frames."""
    i8 = F.sequence(F.lit(0), F.lit(7))
    frame = F.transform(i8, lambda i: F.struct(
        F.struct(F.slice("embedding", i * 8 + 1, F.lit(4)).alias("arm_state")).alias("states"), F.get("embedding", i * 8 + 7).alias("torso_height")))
    root = scratch_dir(spark, "raw")
    emb(spark, d).select(F.col("vec_id").alias("episode_index"), frame.alias("data")).write.json(root)
    t = IO.ingest_raw(spark, root, "struct<states: struct<arm_state: array<double>>, torso_height: double>", 30.0, multiline=False)
    return t.select("episode_index", "frame_index", F.round("timestamp", 6).alias("timestamp"), "done",
                    F.round(F.get("states.arm_state", 0), 6).alias("arm0"), F.round("torso_height", 6).alias("height"))


@query("ingest_indented_captures", """WITH f AS (SELECT vec_id // 16 AS episode_index, row_number() OVER (PARTITION BY vec_id // 16 ORDER BY vec_id) - 1 AS frame_index,
 count(*) OVER (PARTITION BY vec_id // 16) AS n, embedding::double[] AS v FROM embeddings)
SELECT episode_index, frame_index, round(frame_index/30.0,6) AS timestamp, frame_index = n-1 AS done, round(list_sum(v[1:56]),5) AS arm_sum, round(v[64],6) AS height FROM f""")
def ingest_indented_captures(spark, d):
    """Sixteen vectors become the indented document of an episode folder, as a recorder writes it."""
    frame = F.struct("vec_id", F.struct(F.slice("embedding", 1, 56).alias("arm_state")).alias("states"), F.get("embedding", 63).alias("torso_height"))
    episodes = emb(spark, d).groupBy(F.expr("vec_id div 16").alias("episode")).agg(F.sort_array(F.collect_list(frame)).alias("data"))
    document = F.struct(F.struct(F.lit("1.0.0").alias("version"), F.lit(30).alias("fps")).alias("info"), "data")
    root = scratch_dir(spark, "captures")
    episodes.select("episode", F.to_json(document, {"pretty": "true"}).alias("value")).write.partitionBy("episode").text(root)
    t = captures.scan_captures(spark, root, "states struct<arm_state: array<double>>, torso_height double", 30.0, suffix=".txt")
    return t.select("episode_index", "frame_index", F.round("timestamp", 6).alias("timestamp"), "done",
                    F.round(V.vector_sum(F.col("states.arm_state")), 5).alias("arm_sum"), F.round("torso_height", 6).alias("height"))


@query("scan_catalogue", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT','5-LOW') AND o_orderstatus <> 'P'")
def scan_catalogue(spark, d):
    t = IO.scan_catalogue(spark, f"{d}/orders.parquet", ["1-URGENT", "5-LOW"], "o_orderpriority", F.col("o_orderstatus") == "P")
    return t.select("o_orderkey", "o_totalprice")


@query("scan_eval_log", """SELECT event_type AS task, (user_id%7)::varchar AS room, event_id::varchar AS episode, '1' AS trial, CASE WHEN value>50 THEN 'True' ELSE 'False' END AS result, round(value,2) AS s0, (user_id%10)/10.0 AS s1 FROM events""")
def scan_eval_log(spark, d):
    head = F.format_string("Task: %s, Room Idx: %d, Episode Label: %d, Trial Label: 1, Result: %s", "event_type", F.col("user_id") % 7, "event_id",
                           F.when(F.col("value") > 50, "True").otherwise("False"))
    text = F.concat(head, F.lit("\n"), F.format_string("%.2f %.1f", "value", (F.col("user_id") % 10) / 10))
    root = scratch_dir(spark, "log")
    table(spark, d, "events").select(text.alias("value")).write.text(root)
    t = IO.scan_eval_log(spark, root)
    return t.select("task", "room", "episode", "trial", "result", F.get("scores", 0).alias("s0"), F.get("scores", 1).alias("s1"))


@query("write_pack", f"""WITH {FRAMES} SELECT episode_index//1000 AS episode_chunk, count(*) AS frames, max(episode_index) AS last_episode FROM frames GROUP BY 1""")
def write_pack(spark, d):
    root = scratch_dir(spark, "pack")
    IO.write_pack(frames(spark, d).select("episode_index", "frame_index", "state", "action"), root)
    t = spark.read.parquet(root).groupBy(F.col("episode_chunk").cast("bigint").alias("episode_chunk"))
    return t.agg(F.count(F.lit(1)).alias("frames"), F.max("episode_index").alias("last_episode"))


@query("write_pack_meta", """SELECT count(DISTINCT l_orderkey) AS total_episodes, count(*) AS total_frames, count(DISTINCT l_partkey) AS total_tasks, ceil(count(DISTINCT l_orderkey)/1000.0)::bigint AS total_chunks, 30.0::double AS fps FROM lineitem""")
def write_pack_meta(spark, d):
    root = scratch_dir(spark, "info")
    info = IO.pack_info(steps(spark, d), 30.0)
    info.coalesce(1).write.json(root)
    return spark.read.schema(info.schema).json(root)


@query("resume_ingest", """SELECT DISTINCT l_orderkey AS episode_index FROM lineitem WHERE NOT (l_orderkey%2=0 AND l_orderkey%3=0 AND l_orderkey%5<>4)""")
def resume_ingest(spark, d):
    e = steps(spark, d).select("episode_index").distinct()
    k = F.col("episode_index")
    return IO.not_yet_ingested(e, e.where(k % 2 == 0), e.where(k % 3 == 0), e.where(k % 5 != 4))


@query("episode_file_list", """WITH k AS (SELECT DISTINCT l_suppkey%40 AS episode FROM lineitem WHERE l_suppkey%40 <> 7), p AS (SELECT episode, row_number() OVER (ORDER BY episode)-1 AS position FROM k WHERE episode%5<>2)
SELECT episode, position FROM p WHERE position%3=0""")
def episode_file_list(spark, d):
    root = scratch_dir(spark, "files")
    t = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("episode"), "l_tax").groupBy("episode").agg(F.sum("l_tax").alias("x"))
    t.where("episode <> 7").write.partitionBy("episode").parquet(f"{root}/data")
    t.where("episode % 5 <> 2").write.partitionBy("episode").parquet(f"{root}/video")
    return IO.paired_files(spark, f"{root}/data", f"{root}/video", r"episode=(\d+)/", every=3).select("episode", "position")


@query("upsert_catalogue", """WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey%10<>9), i AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey%10=9)
SELECT o_orderkey, CASE WHEN o_orderkey%10=1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM b WHERE o_orderkey%10<>2 UNION ALL SELECT * FROM i""")
def upsert_catalogue(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey") % 10
    return IO.upsert(o.where(k != 9), o.where(k == 9), o.where(k == 1).select("o_orderkey", F.lit("X").alias("o_orderstatus")), o.where(k == 2), "o_orderkey")


@query("chunk_log_sink", """SELECT 'run-a' AS run, count(*) FILTER (len(embedding)=64 AND vec_id%9<>0) AS rows_read, count(*) FILTER (vec_id%9<>0) AS written, count(*) FILTER (vec_id%9=0) AS dropped FROM embeddings""")
def chunk_log_sink(spark, d):
    root = scratch_dir(spark, "chunks")
    e = emb(spark, d).select(F.array("embedding").alias("chunk"), F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 5).alias("replan_id"), F.lit(12.5).alias("infer_ms"))
    seen = IO.append_chunk_log(e, root, "run-a", F.col("chunk_id") % 9 != 0).get
    t = spark.read.parquet(root).groupBy("run").agg(F.count(F.lit(1)).alias("rows_read"))
    return t.select("run", "rows_read", F.lit(seen["written"]).cast("bigint").alias("written"), F.lit(seen["dropped"]).cast("bigint").alias("dropped"))


@query("records_to_parquet", """SELECT vec_id, 64::int AS width, round(embedding[64]::double,6) AS last FROM embeddings""")
def records_to_parquet(spark, d):
    root = scratch_dir(spark, "records")
    r = emb(spark, d).select("vec_id", F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)]).alias("hands"))
    IO.records_to_parquet(r, {"flat": "hands"}, root, 200)
    return spark.read.parquet(root).select("vec_id", F.size("flat").alias("width"), F.round(F.element_at("flat", -1), 6).alias("last"))
