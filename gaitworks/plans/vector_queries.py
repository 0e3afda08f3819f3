"""Projections of vector columns, embodiment layouts, text and JSON helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.functions import embodiment as E
from gaitworks.functions import projections as P
from gaitworks.functions import vectors as V
from gaitworks.operators import stats as S
from gaitworks.plans.registry import query
from gaitworks.plans.tables import EMB_LONG, emb, steps, table

EMB = "e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings)"


def long(df, column: str, digits: int = 6, id_: str = "vec_id"):
    t = df.select(id_, F.posexplode(column).alias("dim", "x"))
    return t.select(id_, F.col("dim").cast("bigint").alias("dim"), F.round("x", digits).alias("value"))


def long_sql(expr: str, ctes: str = EMB, digits: int = 6, src: str = "e") -> str:
    return f"""WITH {ctes}, l AS (SELECT vec_id, {expr} AS l FROM {src}), u AS (SELECT vec_id, unnest(range(len(l))) AS dim, unnest(l) AS value FROM l)
SELECT vec_id, dim, round(value,{digits}) AS value FROM u"""


@query("slice_modality", long_sql("v[11:20]"))
def slice_modality(spark, d):
    return long(emb(spark, d).select("vec_id", V.take_span(F.col("embedding"), 10, 20).alias("s")), "s")


@query("select_modality_keys", long_sql("v[1:8] || v[21:30:2] || [v[64]]"))
def select_modality_keys(spark, d):
    keys = ["embedding[:8]", "embedding[20:30:2]", "embedding[-1]"]
    return long(emb(spark, d).select("vec_id", P.select_keys(keys).alias("s")), "s")


@query("concat_vectors", long_sql("v[33:64] || v[1:16]"))
def concat_vectors(spark, d):
    e = emb(spark, d).withColumns({"arm": F.slice("embedding", 33, 32), "leg": F.slice("embedding", 1, 16)})
    return long(e.withColumn("c", F.concat(V.require_width(F.col("arm"), 32, "arm"), V.require_width(F.col("leg"), 16, "leg"))), "c")


@query("split_vector", f"""WITH {EMB}, l AS (SELECT vec_id, 'arm' AS part, v[1:24] AS l FROM e UNION ALL SELECT vec_id, 'leg', v[25:60] FROM e UNION ALL SELECT vec_id, 'hand', v[61:64] FROM e)
SELECT vec_id, part, len(l) AS width, round(list_sum(l),4) AS total FROM l""")
def split_vector(spark, d):
    spans = {"arm": (0, 24), "leg": (24, 60), "hand": (60, 64)}
    v = V.require_width(F.col("embedding"), 64, "embedding")
    parts = F.array(*[F.struct(F.lit(n).alias("part"), V.take_span(v, a, b).alias("v")) for n, (a, b) in spans.items()])
    t = emb(spark, d).select("vec_id", F.explode(parts).alias("p"))
    return t.select("vec_id", "p.part", F.size("p.v").cast("bigint").alias("width"), F.round(V.vector_sum(F.col("p.v")), 4).alias("total"))


@query("repack_columns", """SELECT l_orderkey AS obs_episode, l_quantity AS obs_pose_x, l_tax AS obs_pose_y, l_returnflag AS body FROM lineitem""")
def repack_columns(spark, d):
    t = P.repack(table(spark, d, "lineitem"), {
        "obs/episode": "l_orderkey", "obs/pose/x": "l_quantity", "obs/pose/y": "l_tax", "body": "l_returnflag"})
    flat = P.flatten_struct(t, "obs")
    return flat.select(F.col("`episode`").alias("obs_episode"), F.col("`pose.x`").alias("obs_pose_x"), F.col("`pose.y`").alias("obs_pose_y"), "body")


@query("rename_by_pattern", """SELECT p_partkey AS key, p_name AS part_name, p_brand AS part_brand, p_size AS part_size FROM part""")
def rename_by_pattern(spark, d):
    return P.rename_by_patterns(table(spark, d, "part"), {"p_partkey": "key", "p_(name|brand|size)": r"part_\1", "p_.*": None})


@query("flatten_nested_action", """SELECT event_id, value AS arm_left, json_extract(props,'$.k')::bigint AS arm_right_k, user_id AS base FROM events""")
def flatten_nested_action(spark, d):
    k = F.struct(F.from_json("props", "k bigint").getField("k").alias("k"))
    t = table(spark, d, "events").select(
        "event_id", F.struct(F.struct(F.col("value").alias("left"), k.alias("right")).alias("arm"), F.col("user_id").alias("base")).alias("action"))
    return P.flatten_struct(t, "action", sep="_")


BODY = "CASE label % 3 WHEN 0 THEN 'g1' WHEN 1 THEN 'g1neck' ELSE 'h1' END"


def with_body(spark, d):
    return emb(spark, d).withColumn("body", F.when(F.col("label") % 3 == 0, "g1").when(F.col("label") % 3 == 1, "g1neck").otherwise("h1"))


@query("canonicalise_embodiment", long_sql("""CASE label % 3 WHEN 0 THEN v[1:43] || [0,0]::double[] WHEN 1 THEN v[1:45]
 ELSE v[1:12] || [0,0]::double[] || v[13:26] || v[27:38] || [v[39]] || [0,0,0,0]::double[] END"""))
def canonicalise_embodiment(spark, d):
    w = F.when(F.col("body") == "g1", 43).when(F.col("body") == "g1neck", 45).otherwise(39)
    t = with_body(spark, d).withColumn("state", F.slice("embedding", F.lit(1), w))
    return long(t.withColumn("c", E.canonical(F.col("state"), F.col("body"), E.STATE_SLOTS, E.STATE_WIDTH)), "c")


@query("canonicalise_action", long_sql("CASE label % 3 WHEN 2 THEN v[1:12] || [0,0]::double[] || v[13:34] ELSE v[1:36] END"))
def canonicalise_action(spark, d):
    t = with_body(spark, d).withColumn("action", F.slice("embedding", F.lit(1), F.when(F.col("body") == "h1", 34).otherwise(36)))
    return long(t.withColumn("c", E.canonical(F.col("action"), F.col("body"), E.ACTION_SLOTS, E.ACTION_WIDTH)), "c")


@query("embodiment_mask", f"""WITH m AS (SELECT vec_id, unnest(range(80)) AS dim, unnest(embedding::double[] || embedding[1:16]::double[]) AS x, {BODY} AS body FROM embeddings)
SELECT vec_id, dim, round(x * CASE WHEN dim >= 78 AND body <> 'g1neck' THEN 0 WHEN dim IN (76,77) AND body='h1' THEN 0 ELSE 1 END,6) AS value FROM m""")
def embodiment_mask(spark, d):
    t = with_body(spark, d).withColumn("v", F.concat("embedding", F.slice("embedding", 1, 16)))
    return long(t.withColumn("m", V.multiply(F.col("v"), E.valid_mask(F.col("body"), E.MODEL_ABSENT, E.MODEL_WIDTH))), "m")


JOINTS = [f"joint_{i:02d}" for i in range(64)]
SHUFFLED = [f"joint_{(i * 5 + 3) % 64:02d}" for i in range(64)]


@query("permute_vector_by_name", long_sql("list_transform(range(64), lambda i: v[(i*5+3)%64+1])"))
def permute_vector_by_name(spark, d):
    order = P.permutation(JOINTS, SHUFFLED)
    return long(emb(spark, d).select("vec_id", V.permute(F.col("embedding"), order).alias("p")), "p")


@query("permute_stats", f"""WITH {EMB_LONG}, s AS (SELECT dim, avg(value) AS mean, stddev_pop(value) AS std FROM emb_long GROUP BY dim), p AS (SELECT unnest(range(64)) AS i)
SELECT i AS dim, round(mean,6) AS mean, round(std,6) AS std FROM p JOIN s ON s.dim=(i*5+3)%64""")
def permute_stats(spark, d):
    st = S.moment_stats(V.explode_vector(emb(spark, d), "embedding"), ["dim"])
    order = P.permutation(JOINTS, SHUFFLED)
    back = F.element_at(F.array(*[F.lit(order.index(i)) for i in range(64)]), F.col("dim") + 1)
    return st.select(back.cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("reorder_by_spans", long_sql("v[15:29] || v[1:14] || v[30:43]"))
def reorder_by_spans(spark, d):
    return long(emb(spark, d).select("vec_id", V.concat_spans(F.col("embedding"), [(14, 29), (0, 14), (29, 43)]).alias("p")), "p")


@query("pad_vector", f"""WITH {EMB}, l AS (SELECT vec_id, v[1:(vec_id%10+60)::bigint] AS l FROM e), r AS (SELECT vec_id, l, unnest(range(70)) AS dim FROM l)
SELECT vec_id, dim, round(coalesce(l[dim+1],0),6) AS value, CASE WHEN dim < len(l) THEN 1.0::double ELSE 0.0::double END AS mask FROM r""")
def pad_vector(spark, d):
    t = emb(spark, d).select("vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 10 + 60).cast("int")).alias("s"))
    z = t.select("vec_id", F.posexplode(F.arrays_zip(V.pad_right(F.col("s"), 70).alias("p"), V.valid_mask(F.col("s"), 70).alias("m"))).alias("dim", "z"))
    return z.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("z.p", 6).alias("value"), F.col("z.m").alias("mask"))


@query("pad_or_trim", long_sql("list_resize(v[1:(vec_id%40+30)::bigint], 50, 0.0)"))
def pad_or_trim(spark, d):
    t = emb(spark, d).select("vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 40 + 30).cast("int")).alias("s"))
    return long(t.withColumn("p", V.pad_or_trim(F.col("s"), 50)), "p")


@query("sincos_encode", long_sql("list_transform(v, lambda x: sin(x)) || list_transform(v, lambda x: cos(x))"))
def sincos_encode(spark, d):
    return long(emb(spark, d).select("vec_id", V.sincos(F.col("embedding")).alias("p")), "p")


@query("affine_hand_convert", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1.7-l_quantity,6) AS thumb, round(1.0-l_tax,6) AS index_finger FROM lineitem""")
def affine_hand_convert(spark, d):
    q = F.array("l_quantity", "l_discount", "l_tax")
    offsets = [(0, 1.7), (2, 1.0)]  # (source joint, constant)
    hand = F.array(*[F.lit(c) - F.get(q, i) for i, c in offsets])
    t = table(spark, d, "lineitem").withColumn("h", hand)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.get("h", 0), 6).alias("thumb"), F.round(F.get("h", 1), 6).alias("index_finger"))


GRASP = f"""WITH {EMB_LONG}, s AS (SELECT dim, min(value) AS lo, max(value) AS hi FROM emb_long WHERE dim < 7 GROUP BY dim),
 f AS (SELECT e.vec_id, e.dim, lo, hi, hi-lo > 0.75 AS live, least(greatest((value-lo)/greatest(hi-lo,1e-6),0),1) AS pos FROM emb_long e JOIN s ON e.dim=s.dim),
 o AS (SELECT vec_id, CASE WHEN sum(live::int)=0 THEN avg(pos) ELSE sum(CASE WHEN live THEN pos ELSE 0 END)/sum(live::int) END AS openness FROM f GROUP BY vec_id)"""


def _hand(spark, d):
    st = S.moment_stats(V.explode_vector(emb(spark, d), "embedding").where("dim < 7"), ["dim"])
    row = S.stats_vectors(st, [], columns=("min", "max")).select(F.struct("min", "max").alias("s"))
    return emb(spark, d).select("vec_id", F.slice("embedding", 1, 7).alias("hand")).withColumn("_s", row.scalar()).select("vec_id", "hand", "_s.min", "_s.max")


@query("collapse_grasp", GRASP + " SELECT vec_id, round(openness,6) AS openness FROM o")
def collapse_grasp(spark, d):
    return _hand(spark, d).select("vec_id", F.round(P.openness(F.col("hand"), F.col("min"), F.col("max"), 0.75), 6).alias("openness"))


@query("expand_grasp", GRASP + """ SELECT f.vec_id, f.dim, round(CASE WHEN live OR (SELECT count(*) FROM s WHERE hi-lo > 0.75)=0 THEN lo+openness*(hi-lo) ELSE (lo+hi)/2 END,6) AS value
 FROM f JOIN o ON f.vec_id=o.vec_id""")
def expand_grasp(spark, d):
    t = _hand(spark, d).withColumn("o", P.openness(F.col("hand"), F.col("min"), F.col("max"), 0.75))
    return long(t.withColumn("h", P.hand_from_openness(F.col("o"), F.col("min"), F.col("max"), 0.75)), "h")


@query("rename_path_token", """SELECT o_orderkey, 'videos/cam/episode_' || lpad((o_orderkey+7)::varchar,6,'0') || '.mp4' AS path FROM orders""")
def rename_path_token(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.format_string("videos/cam/episode_%06d.mp4", "o_orderkey").alias("path"))
    return o.withColumn("path", P.renumber_path(F.col("path"), F.col("o_orderkey"), F.col("o_orderkey") + 7))


@query("default_column", """SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id%3=0 THEN '  ' WHEN doc_id%3=1 THEN NULL ELSE lang END),''),'do the task') AS prompt FROM documents""")
def default_column(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 3 == 2, F.col("lang")).alias("p"))
    return t.select("doc_id", P.default_text(F.col("p"), "do the task").alias("prompt"))


def keypoint_cell(i: str) -> str:
    return f"v[({i})%64+1]"


@query("keypoints_140_to_48", f"""WITH {EMB}, k AS (SELECT vec_id, label, list_transform(range(140), lambda i: v[(i*3)%64+1]) AS k FROM e),
 a AS (SELECT vec_id, arm, k, 70*arm AS b, CASE WHEN label%2=0 THEN [0,1,2,3,4] ELSE [4,8,12,16,20] END AS tips FROM k, (VALUES (0),(1)) t(arm)),
 q AS (SELECT *, k[b+4] AS w, k[b+5] AS x, k[b+6] AS y, k[b+7] AS z FROM a),
 o AS (SELECT vec_id, arm, k[b+1:b+3] || [1-2*(y*y+z*z), 2*(x*y+w*z), 2*(x*z-w*y), 2*(x*y-w*z), 1-2*(x*x+z*z), 2*(y*z+w*x)]
   || flatten(list_transform(tips, lambda t: k[b+8+3*t:b+10+3*t])) AS l FROM q),
 u AS (SELECT vec_id, arm, unnest(range(24)) AS j, unnest(l) AS value FROM o)
SELECT vec_id, 24*arm+j AS dim, round(value,6) AS value FROM u""")
def keypoints_140_to_48(spark, d):
    kp = F.transform(F.sequence(F.lit(0), F.lit(139)), lambda i: F.get(F.col("embedding"), (i * 3) % 64))
    t = emb(spark, d).select("vec_id", kp.alias("kp"), F.when(F.col("label") % 2 == 0, "aria").otherwise("mecka").alias("body"))
    return long(t.withColumn("c", P.keypoints_to_48(F.col("kp"), F.col("body"))), "c")


@query("build_48d_action", f"""WITH {EMB}, k AS (SELECT vec_id, list_transform(range(192), lambda i: v[(i*5)%64+1]) AS k FROM e),
 o AS (SELECT vec_id, flatten(list_transform([0,1], lambda h: list_transform([3,7,11,0,4,8,1,5,9], lambda c: k[96*h+c+1])
   || flatten(list_transform([1,2,3,4,5], lambda f: list_transform([3,7,11], lambda c: k[96*h+16*f+c+1]))))) AS l FROM k),
 u AS (SELECT vec_id, unnest(range(48)) AS dim, unnest(l) AS value FROM o)
SELECT vec_id, dim, round(value,6) AS value FROM u""")
def build_48d_action(spark, d):
    """Twelve 4x4 transforms per frame (wrist and five tips per hand) derived from the vector."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: F.get(F.col("embedding"), (i * 5) % 64))
    t = emb(spark, d).select("vec_id", cells.alias("k"))
    mats = [F.slice("k", 16 * i + 1, 16) for i in range(12)]
    both = F.concat(*[P.hand_vector(mats[h], F.array(*mats[h + 1:h + 6])) for h in (0, 6)])
    return long(t.withColumn("c", both), "c")


@query("extract_json_block", """SELECT event_id, json_extract(props,'$.k')::bigint AS k FROM events""")
def extract_json_block(spark, d):
    noisy = F.concat(F.lit("answer for "), F.col("event_type"), F.lit(":\n"), F.col("props"), F.lit("\nthank you"))
    t = table(spark, d, "events").select("event_id", noisy.alias("text"))
    return t.select("event_id", P.json_block(F.col("text"), "k bigint").getField("k").alias("k"))


@query("invert_repack_spans", long_sql("v[1:48]"))
def invert_repack_spans(spark, d):
    """Model order back to recorded order: the two steps together are the identity."""
    spans = [(30, 48), (0, 14), (14, 30)]
    model = emb(spark, d).select("vec_id", V.concat_spans(F.col("embedding"), spans).alias("m"))
    return long(model.withColumn("r", V.permute(F.col("m"), P.recorded_order(spans, 48))), "r")


FLIP_SQL = ", ".join(f"{s}*v[{i + 1}]" for i, s in enumerate(P.JOINT_FLIP))


def flip_sql(expr: str) -> str:
    cells = []
    for i, s in enumerate(P.JOINT_FLIP):
        x = f"({s}*v[{i + 1}])"
        cells.append(expr.replace("$", x) if i in (6, 13) else x)
    return long_sql("[" + ", ".join(cells) + "]")


@query("joint_flip_and_gripper", flip_sql("((asin(least(greatest((0.022*0.022 + (($)*(0.05800-0.01844)+0.01844)*(($)*(0.05800-0.01844)+0.01844) - 0.036*0.036)/(2*0.022*(($)*(0.05800-0.01844)+0.01844)),-1),1)) - 0.5476)/(1.6296-0.5476))"))
def joint_flip_and_gripper(spark, d):
    t = emb(spark, d).select("vec_id", F.slice("embedding", 1, 14).alias("v"))
    return long(t.withColumn("f", P.on_dims(P.mirrored(F.col("v")), P.GRIPPER_DIMS, lambda x: P.gripper(x, "slider share", "turn share"))), "f")


@query("gripper_from_angle", flip_sql("((($)+0.5476+0.6213)/(1.4910+0.6213))"))
def gripper_from_angle(spark, d):
    t = emb(spark, d).select("vec_id", F.slice("embedding", 1, 14).alias("v"))
    return long(t.withColumn("f", P.on_dims(P.mirrored(F.col("v")), P.GRIPPER_DIMS, lambda x: P.gripper(x, "turn from start", "joint share"))), "f")


@query("gripper_from_angle_inverse", flip_sql("(($)*(1.4910+0.6213)-0.6213-0.5476)"))
def gripper_from_angle_inverse(spark, d):
    t = emb(spark, d).select("vec_id", F.slice("embedding", 1, 14).alias("v"))
    return long(t.withColumn("f", P.on_dims(P.mirrored(F.col("v")), P.GRIPPER_DIMS, lambda x: P.gripper(x, "joint share", "turn from start"))), "f")


@query("zero_tail_shift", long_sql("v[6:64] || [0,0,0,0,0]::double[]"))
def zero_tail_shift(spark, d):
    return long(emb(spark, d).select("vec_id", V.tail_shift(F.col("embedding"), 5, F.lit(0.0)).alias("s")), "s")


# --- text, date and hash functions ------------------------------------------------------------

@query("clean_instruction", r"""SELECT conv_id, turn, regexp_replace(replace(replace(lower(trim(list_last(string_split(role || ': ' || text, ': ')))),'_',' '),'-',' '),'\s+',' ','g') AS instruction FROM conversations""")
def clean_instruction(spark, d):
    from gaitworks.functions import text as X

    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.clean_instruction(F.concat("role", F.lit(": "), "text")).alias("instruction"))


@query("pick_description", """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') AND o_orderstatus='F' THEN 'reverse ' || o_orderstatus ELSE 'forward ' || o_orderstatus END AS description FROM orders""")
def pick_description(spark, d):
    from gaitworks.functions import text as X

    o = table(spark, d, "orders")
    return o.select("o_orderkey", X.pick_description(
        F.concat(F.lit("forward "), "o_orderstatus"), F.concat(F.lit("reverse "), "o_orderstatus"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "F")).alias("description"))


@query("hash_timestamp", """SELECT event_id, strftime(ts,'%Y-%m-%d-%H-%M-%S-') || lpad((epoch_us(ts)%1000000)::varchar,6,'0') AS episode_hash, (epoch_us(ts)//1000)::bigint AS ms FROM events""")
def hash_timestamp(spark, d):
    from gaitworks.functions import text as X

    e = table(spark, d, "events").select("event_id", X.timestamp_hash(F.col("ts")).alias("episode_hash"))
    return e.withColumn("ms", X.hash_millis(F.col("episode_hash")))


@query("folder_description", r"""SELECT p_partkey, regexp_replace(replace(lower(p_type || '_' || replace(p_name,' ','_') || '_12'),'_',' '),'\s+\d+$','') AS description FROM part""")
def folder_description(spark, d):
    from gaitworks.functions import text as X

    p = table(spark, d, "part")
    name = F.concat_ws("_", "p_type", F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("12"))
    return p.select("p_partkey", X.folder_description(name).alias("description"))
