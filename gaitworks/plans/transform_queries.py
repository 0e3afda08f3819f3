"""Composable transforms and registries over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaitworks.functions import projections as P
from gaitworks.operators import transforms as T
from gaitworks.plans.registry import query
from gaitworks.plans.tables import emb, table


def _long(df, column):
    t = df.select("vec_id", F.posexplode(column).alias("dim", "x"))
    return t.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("value"))


def _chain() -> T.Chain:
    v = "embedding"
    return T.Chain((
        T.column_step("scale", v, lambda c: F.transform(c, lambda x: x * 4), lambda c: F.transform(c, lambda x: x / 4)),
        T.column_step("noise", v, lambda c: F.transform(c, lambda x, i: x + 0.125 * (i % 2)), training_only=True),
        T.column_step("flip", v, F.reverse, F.reverse),
        T.column_step("shift", v, lambda c: F.transform(c, lambda x, i: x - i), lambda c: F.transform(c, lambda x, i: x + i)),
    ))


LONG = "SELECT vec_id, dim, round({x},6) AS value FROM (SELECT vec_id, embedding::double[] AS v, unnest(range(64)) AS dim FROM embeddings)"


@query("transform_chain", LONG.format(x="v[64-dim]*4 + CASE WHEN (63-dim)%2=1 THEN 0.125 ELSE 0 END - dim"))
def transform_chain(spark, d):
    return _long(_chain().apply(emb(spark, d)), "embedding")


@query("transform_eval_mode", LONG.format(x="v[64-dim]*4 - dim"))
def transform_eval_mode(spark, d):
    return _long(_chain().apply(emb(spark, d), training=False), "embedding")


@query("transform_round_trip", LONG.format(x="v[dim+1]"))
def transform_round_trip(spark, d):
    c = _chain()
    return _long(c.undo(c.apply(emb(spark, d), training=False)), "embedding")


@query("repack_then_field", """SELECT l_orderkey AS episode, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, round(l_quantity/50,6) AS amount, round(l_tax*100,6) AS tax FROM lineitem""")
def repack_then_field(spark, d):
    """Stage one renames into a nested record, stage two works on its fields."""
    names = {"id/episode": "l_orderkey", "id/line": "l_linenumber", "id/part": "l_partkey", "id/supplier": "l_suppkey", "state/amount": "l_quantity", "state/tax": "l_tax"}
    repack = T.Chain((T.Step("repack", lambda df: P.repack(df, names)),))
    fields = T.Chain((
        T.column_step("amount", "state", lambda s: s.withField("amount", s["amount"] / 50)),
        T.column_step("tax", "state", lambda s: s.withField("tax", s["tax"] * 100)),
    ))
    t = repack.then(fields).apply(table(spark, d, "lineitem"))
    return t.select("id.*", F.round("state.amount", 6).alias("amount"), F.round("state.tax", 6).alias("tax"))


@query("transform_groups", LONG.format(x="((v[dim+1]*2 + 1) * 3 - 1) / 2"))
def transform_groups(spark, d):
    """Inputs, a stand-in for the model (times three), outputs: what was added last is undone first."""
    pair = lambda name, f, g: (T.Chain((T.column_step(name, "embedding", f),)), T.Chain((T.column_step(name, "embedding", g),)))
    each = lambda fn: lambda c: F.transform(c, fn)
    group = T.Group().with_steps(*pair("double", each(lambda x: x * 2), each(lambda x: x / 2))).with_steps(*pair("one", each(lambda x: x + 1), each(lambda x: x - 1)))
    seen = group.inputs.apply(emb(spark, d)).withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    return _long(group.outputs.apply(seen), "embedding")


@query("mixture_registry", """WITH m AS (SELECT r_name AS mixture, n_name AS dataset, (1 + n_nationkey % 4)::double AS weight, 'body' || (n_nationkey % 3)::varchar AS embodiment FROM nation JOIN region ON n_regionkey=r_regionkey),
 s AS (SELECT s_suppkey, n_name AS dataset FROM supplier JOIN nation ON s_nationkey=n_nationkey)
SELECT m.mixture, m.dataset, m.embodiment, round(weight / sum(weight) OVER (PARTITION BY mixture), 9) AS ratio, (SELECT count(*) FROM s WHERE s.dataset=m.dataset) AS members FROM m""")
def mixture_registry(spark, d):
    """Regions as mixtures of their nations, read from tables."""
    m = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("mixture"), F.col("n_name").alias("dataset"), (1 + F.col("n_nationkey") % 4).cast("double").alias("weight"),
        F.concat(F.lit("body"), (F.col("n_nationkey") % 3).cast("string")).alias("embodiment"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("dataset")).agg(F.count(F.lit(1)).alias("members"))
    t = T.mixture_ratios(m).join(s, "dataset", "left")
    return t.select("mixture", "dataset", "embodiment", F.round("ratio", 9).alias("ratio"), F.coalesce("members", F.lit(0)).alias("members"))


@query("embodiment_registry", """WITH c AS (SELECT n_regionkey AS e, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
 u AS (SELECT vec_id, label % 5 AS e, embedding::double[] AS v, unnest(range(12)) AS dim FROM embeddings)
SELECT vec_id, dim, round(coalesce(CASE WHEN i IS NOT NULL THEN v[(3*i + u.e + dim%2)::bigint + 1] END, 0), 6) AS value FROM u LEFT JOIN c ON c.e = u.e AND 2*(4-i) = dim - dim%2""")
def embodiment_registry(spark, d):
    """Five bodies, each with five spans of two, kept as rows: span i of body e starts at 3i + e and goes to slot 2(4 - i)."""
    i = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    c = table(spark, d, "nation").select(F.col("n_regionkey").alias("embodiment"), i.cast("long").alias("i")).select(
        "embodiment", (3 * F.col("i") + F.col("embodiment")).alias("source_start"), (3 * F.col("i") + F.col("embodiment") + 2).alias("source_stop"), (2 * (4 - F.col("i"))).alias("slot_start"))
    t = emb(spark, d).withColumn("e", F.col("label") % 5)
    return _long(T.place_by_registry(t, c, "embedding", "e", 12, "placed"), "placed")
