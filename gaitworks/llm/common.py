"""Shared helpers: scratch tables in the cluster's shared folder, input columns, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names.

    Where it is unset a temporary folder serves a local master; on any other master that is an error, because executors
    could not see the folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="gaitworks-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts lineage and outlives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_rows(df: DataFrame, *columns: tuple[str, str, str]) -> DataFrame:
    """Only the named input columns, as (source name, type, new name); all others, whatever their names, are left behind."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(n) for c, t, n in columns])


def spread(key: Column | str, salts: int) -> Column:
    """A salt from 0 to ``salts - 1`` that depends on the key only."""
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of (a, b) links; component is the smallest node reachable.

    Large-star / small-star rounds: links are rewired towards smaller nodes until every node hangs on its smallest.
    Each round is two aggregations over the links and is written out, so no task or driver holds a component. A node
    of very many links is aggregated with a map-side minimum and rewired by a join that AQE can split.
    """
    spark = edges.sparkSession
    links = stored(
        edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), name)
    while True:
        both = links.unionByName(links.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        low = both.groupBy(F.col("lo").alias("node")).agg(F.min("hi").alias("m")).select("node", F.least("node", "m").alias("m"))
        # large star: every larger neighbour of a node goes to the node's minimum
        large = links.join(low.withColumnRenamed("node", "lo"), "lo").select(F.col("m").alias("lo"), "hi").where("lo <> hi").distinct()
        # small star: a node's smaller neighbours and the node itself go to its minimum
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi").select(F.explode(F.array(F.struct("m", F.col("lo").alias("hi")), F.struct("m", F.col("hi").alias("hi")))).alias("e"))
            .select(F.col("e.m").alias("lo"), F.col("e.hi").alias("hi")).where("lo <> hi").distinct()
        )
        new = stored(small, name)
        state = lambda d: d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state(new)) == tuple(state(links)):
            break
        links = new
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return roots.unionByName(links.select(F.col("hi").alias("node"), F.col("lo").alias("component")))
