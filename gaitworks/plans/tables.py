"""Bindings of the driver tables to trajectory roles, Spark side and SQL side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.operators import ordering


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Epoch microseconds of a zone-less timestamp, whatever the session zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)


def seconds(ts: Column | str) -> Column:
    return micros(ts) / F.lit(1e6)


def state() -> Column:
    return F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def action() -> Column:
    return F.array("l_discount", "l_tax", "l_quantity", "l_extendedprice")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as frames without a position: enough for order-free work."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("episode_index"), state().alias("state"), action().alias("action"),
        F.col("l_returnflag").alias("embodiment"), F.col("l_partkey").alias("task_index"),
        F.col("l_suppkey").alias("dataset_id"), "l_linenumber", "l_linestatus",
    )


def frames(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """lineitem as frames: an order is an episode, lines are its frames. With ``columns`` only these beside the position,
    so that the others are neither shuffled nor written."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    vectors = {"state": state(), "action": action()}
    scalars = {"embodiment": "l_returnflag", "task_index": "l_partkey", "dataset_id": "l_suppkey", "l_linenumber": "l_linenumber", "l_linestatus": "l_linestatus"}
    columns = columns or (*vectors, *scalars)
    needed = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"] if any(c in vectors for c in columns) else []
    needed += [scalars[c] for c in columns if c in scalars]
    li = table(spark, d, "lineitem").select(*dict.fromkeys(["l_orderkey", *order, *needed]))
    indexed = ordering.row_index(li, ["l_orderkey"], order)
    return indexed.select(
        F.col("l_orderkey").alias("episode_index"), "frame_index", *[vectors[c].alias(c) if c in vectors else F.col(scalars[c]).alias(c) for c in columns]
    )


# SQL twin of ``frames``; s0..s3 is the state, a0..a3 the action
FRAMES = """frames AS (SELECT l_orderkey AS episode_index,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS frame_index,
  l_quantity AS s0, l_extendedprice AS s1, l_discount AS s2, l_tax AS s3,
  l_discount AS a0, l_tax AS a1, l_quantity AS a2, l_extendedprice AS a3,
  l_returnflag AS embodiment, l_partkey AS task_index, l_suppkey AS dataset_id, l_linenumber, l_linestatus FROM lineitem)"""

# one row per (frame, dim); dims count from 0 and are bigint
STATE_LONG = """state_long AS (SELECT l_orderkey AS episode_index, l_returnflag AS embodiment, l_suppkey AS dataset_id,
  u.dim AS dim, CASE u.dim WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice WHEN 2 THEN l_discount ELSE l_tax END AS value
  FROM lineitem, (VALUES (0),(1),(2),(3)) u(dim))"""

EMB_LONG = """emb_long AS (SELECT vec_id, label, dim - 1 AS dim, embedding[dim]::double AS value
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings))"""


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def signal(spark: SparkSession, d: str) -> DataFrame:
    """events as a scalar signal: one user is one episode ordered by time."""
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props", micros("ts").alias("us"))
    return ordering.row_index(ev, ["user_id"], ["ts", "event_id"])


SIGNAL = """signal AS (SELECT event_id, ts, user_id, event_type, value, props, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events)"""
