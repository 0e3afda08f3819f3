"""Rotation conversions, frame changes, relative poses and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaitworks.functions import rotations as R
from gaitworks.functions import vectors as V
from gaitworks.operators import poses as P
from gaitworks.plans.registry import query
from gaitworks.plans.tables import emb


def out(df, column: str, digits: int = 5):
    t = df.select("vec_id", F.posexplode(column).alias("dim", "x"))
    return t.select("vec_id", F.col("dim").cast("bigint").alias("dim"), (F.round("x", digits) + 0.0).alias("value"))


def span(a: int, b: int):
    return F.slice("embedding", a + 1, b - a)


# --- SQL twins: every name is a list-valued expression over v -------------------------------

def at(l: str, i: int) -> str:
    return f"({l})[{i + 1}]"


BASE = """WITH e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings)"""


def unit_quat_cte(name: str, src: str, a: int) -> str:
    n = "sqrt(" + "+".join(f"v[{a + i + 1}]*v[{a + i + 1}]" for i in range(4)) + ")"
    return f"{name} AS (SELECT *, v[{a + 1}]/{n} AS w, v[{a + 2}]/{n} AS x, v[{a + 3}]/{n} AS y, v[{a + 4}]/{n} AS z FROM {src})"


QM = ["1-2*(y*y+z*z)", "2*(x*y-w*z)", "2*(x*z+w*y)", "2*(x*y+w*z)", "1-2*(x*x+z*z)", "2*(y*z-w*x)", "2*(x*z-w*y)", "2*(y*z+w*x)", "1-2*(x*x+y*y)"]


def euler_m(y: str, p: str, r: str) -> list[str]:
    cy, sy, cp, sp, cr, sr = f"cos({y})", f"sin({y})", f"cos({p})", f"sin({p})", f"cos({r})", f"sin({r})"
    return [f"{cy}*{cp}", f"{cy}*{sp}*{sr}-{sy}*{cr}", f"{cy}*{sp}*{cr}+{sy}*{sr}", f"{sy}*{cp}", f"{sy}*{sp}*{sr}+{cy}*{cr}",
            f"{sy}*{sp}*{cr}-{cy}*{sr}", f"-{sp}", f"{cp}*{sr}", f"{cp}*{cr}"]


def emit(ctes: str, src: str, cells: list[str], digits: int = 5) -> str:
    return f"""{BASE}, {ctes} l AS (SELECT vec_id, [{', '.join(cells)}] AS l FROM {src}), u AS (SELECT vec_id, unnest(range(len(l))) AS dim, unnest(l) AS value FROM l)
SELECT vec_id, dim, round(value,{digits})+0.0 AS value FROM u"""


U = unit_quat_cte("q", "e", 0) + ","
EUL = ["atan2(2*(x*y+w*z), 1-2*(y*y+z*z))", "atan2(-(2*(x*z-w*y)), sqrt((1-2*(y*y+z*z))*(1-2*(y*y+z*z))+(2*(x*y+w*z))*(2*(x*y+w*z))))", "atan2(2*(y*z+w*x), 1-2*(x*x+y*y))"]
SGN = "(CASE WHEN w < 0 THEN -1 ELSE 1 END)"
AAK = f"(2*atan2(sqrt(x*x+y*y+z*z), {SGN}*w)/sqrt(x*x+y*y+z*z)*{SGN})"


@query("rotation_convert_columns", emit(U, "q", QM))
def rotation_convert_columns(spark, d):
    return out(emb(spark, d).select("vec_id", R.convert(span(0, 4), "quaternion", "matrix").alias("m")), "m")


@query("rotation_quat_to_euler", emit(U, "q", EUL))
def rotation_quat_to_euler(spark, d):
    return out(emb(spark, d).select("vec_id", R.convert(span(0, 4), "quaternion", "euler").alias("m")), "m")


@query("rotation_quat_to_axis_angle", emit(U, "q", [f"{AAK}*x", f"{AAK}*y", f"{AAK}*z"]))
def rotation_quat_to_axis_angle(spark, d):
    return out(emb(spark, d).select("vec_id", R.convert(span(0, 4), "quaternion", "axis_angle").alias("m")), "m")


@query("rotation_round_trip", emit(U, "q", [f"{SGN}*w", f"{SGN}*x", f"{SGN}*y", f"{SGN}*z"]))
def rotation_round_trip(spark, d):
    """quaternion -> rot6d -> euler -> axis-angle -> quaternion."""
    v = span(0, 4)
    for a, b in [("quaternion", "rotation_6d"), ("rotation_6d", "euler"), ("euler", "axis_angle"), ("axis_angle", "quaternion")]:
        v = R.convert(v, a, b)
    return out(emb(spark, d).select("vec_id", v.alias("m")), "m")


def gs_cte(name: str, src: str, a: int) -> str:
    g = [f"v[{a + i + 1}]" for i in range(6)]
    n1 = f"sqrt({g[0]}*{g[0]}+{g[1]}*{g[1]}+{g[2]}*{g[2]})"
    return f"""{name}1 AS (SELECT *, {g[0]}/{n1} AS {name}a0, {g[1]}/{n1} AS {name}a1, {g[2]}/{n1} AS {name}a2 FROM {src}),
 {name}2 AS (SELECT *, {name}a0*{g[3]}+{name}a1*{g[4]}+{name}a2*{g[5]} AS {name}d FROM {name}1),
 {name}3 AS (SELECT *, {g[3]}-{name}d*{name}a0 AS {name}c0, {g[4]}-{name}d*{name}a1 AS {name}c1, {g[5]}-{name}d*{name}a2 AS {name}c2 FROM {name}2),
 {name} AS (SELECT *, {name}c0/sqrt({name}c0*{name}c0+{name}c1*{name}c1+{name}c2*{name}c2) AS {name}b0, {name}c1/sqrt({name}c0*{name}c0+{name}c1*{name}c1+{name}c2*{name}c2) AS {name}b1,
  {name}c2/sqrt({name}c0*{name}c0+{name}c1*{name}c1+{name}c2*{name}c2) AS {name}b2 FROM {name}3)"""


def gs_m(n: str) -> list[str]:
    a, b = [f"{n}a{i}" for i in range(3)], [f"{n}b{i}" for i in range(3)]
    c = [f"({a[1]}*{b[2]}-{a[2]}*{b[1]})", f"({a[2]}*{b[0]}-{a[0]}*{b[2]})", f"({a[0]}*{b[1]}-{a[1]}*{b[0]})"]
    return [a[0], b[0], c[0], a[1], b[1], c[1], a[2], b[2], c[2]]


@query("rot6d_orthonormalise", emit(gs_cte("g", "e", 0) + ",", "g", gs_m("g")))
def rot6d_orthonormalise(spark, d):
    return out(emb(spark, d).select("vec_id", R.rot6d_to_matrix(span(0, 6)).alias("m")), "m")


def mul(a, b):
    return [" + ".join(f"({a[3 * i + k]})*({b[3 * k + j]})" for k in range(3)) for i in range(3) for j in range(3)]


def tr(a):
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def mv(a, p):
    return [" + ".join(f"({a[3 * i + k]})*({p[k]})" for k in range(3)) for i in range(3)]


def minus(a, b):
    return [f"({x})-({y})" for x, y in zip(a, b)]


def pose16(r, t):
    return [r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2], "0", "0", "0", "1"]


EX = [f"r{i}" for i in range(9)]
QCTE = U + " m AS (SELECT *, " + ", ".join(f"{c} AS r{i}" for i, c in enumerate(QM)) + " FROM q),"
T1, PT = ["v[5]", "v[6]", "v[7]"], ["v[8]", "v[9]", "v[10]"]
E2 = euler_m("v[11]", "v[12]", "v[13]")
T2 = ["v[14]", "v[15]", "v[16]"]


def ext():
    return R.pose(R.quat_to_matrix(span(0, 4)), span(4, 7))


def pose2():
    return R.pose(R.euler_to_matrix(span(10, 13)), span(13, 16))


@query("to_camera_frame", emit(QCTE, "m", pose16(mul(tr(EX), E2), mv(tr(EX), minus(T2, T1)))))
def to_camera_frame(spark, d):
    t = emb(spark, d).select("vec_id", ext().alias("ext"), pose2().alias("pose"))
    return out(t.withColumn("m", P.to_camera(F.col("pose"), F.col("ext"))), "m")


@query("points_to_camera", emit(QCTE, "m", mv(tr(EX), minus(PT, T1))))
def points_to_camera(spark, d):
    t = emb(spark, d).select("vec_id", ext().alias("ext"), span(7, 10).alias("p"))
    return out(t.withColumn("m", P.point_to_camera(F.col("p"), F.col("ext"))), "m")


@query("pose_relative_actions", emit(QCTE, "m", pose16(mul(E2, tr(EX)), minus(T2, T1))))
def pose_relative_actions(spark, d):
    t = emb(spark, d).select("vec_id", ext().alias("base"), pose2().alias("pose"))
    return out(t.withColumn("m", P.relative(F.col("pose"), F.col("base"), "rel")), "m")


@query("pose_relative_round_trip", emit(QCTE, "m", pose16(E2, T2)))
def pose_relative_round_trip(spark, d):
    """``relative`` and its inverse, then ``delta`` over a chunk of two and its inverse: the second pose comes back."""
    t = emb(spark, d).select("vec_id", ext().alias("base"), pose2().alias("pose"))
    t = t.withColumn("rel", P.relative(F.col("pose"), F.col("base"), "relative"))
    t = t.withColumn("back", P.absolute(F.col("rel"), F.col("base"), "relative"))
    t = t.withColumn("delta", P.delta_chunk(F.array("rel", "back"), F.col("base")))
    return out(t.withColumn("m", F.element_at(P.delta_chunk_inverse(F.col("delta"), F.col("base")), -1)), "m")


def euler_of(m):
    flat = f"sqrt(({m[0]})*({m[0]})+({m[3]})*({m[3]}))"
    return [f"atan2({m[3]},{m[0]})", f"atan2(-({m[6]}),{flat})", f"atan2({m[7]},{m[8]})"]


B1, B2 = euler_m("v[4]", "v[5]", "v[6]"), euler_m("v[23]", "v[24]", "v[25]")
C1, C2 = euler_m("v[10]", "v[11]", "v[12]"), euler_m("v[17]", "v[18]", "v[19]")
REL1, REL2 = mul(tr(B1), C1), mul(tr(B2), C2)
BI = (mv(tr(B1), minus(["v[7]", "v[8]", "v[9]"], ["v[1]", "v[2]", "v[3]"])) + euler_of(REL1) + ["v[13]"]
      + mv(tr(B2), minus(["v[14]", "v[15]", "v[16]"], ["v[20]", "v[21]", "v[22]"])) + euler_of(REL2) + ["v[20]"])


@query("bimanual_relative_actions", emit("", "e", BI))
def bimanual_relative_actions(spark, d):
    t = emb(spark, d).select("vec_id", F.array(span(6, 20)).alias("chunk"), span(0, 6).alias("left"), span(19, 25).alias("right"))
    return out(t.select("vec_id", F.get(P.bimanual_relative(F.col("chunk"), F.col("left"), F.col("right")), 0).alias("m")), "m")


def _delta48() -> str:
    """Prior vector: the same row rotated by 16 places."""
    ctes = QCTE + ",".join([gs_cte("g", "m", 3), gs_cte("h", "g", 19), gs_cte("k", "h", 27), gs_cte("o", "k", 43)])
    turns, cells = [], []
    for tag, (n, p) in (("l", ("g", "h")), ("r", ("k", "o"))):
        t = mul(mul(tr(EX), gs_m(n)), tr(mul(tr(EX), gs_m(p))))
        turns += [f"{c} AS {tag}t{i}" for i, c in enumerate(t)]
    ctes += ", t AS (SELECT *, " + ", ".join(turns) + " FROM o),"
    for tag, b in (("l", 0), ("r", 24)):
        def step(a):
            return mv(tr(EX), [f"v[{a + i + 1}]-v[{a + i + 17}]" for i in range(3)])

        cells += step(b) + euler_of([f"{tag}t{i}" for i in range(9)])[::-1] + ["0", "0", "0"]
        for k in range(5):
            cells += step(b + 9 + 3 * k)
    return emit(ctes, "t", cells)


@query("pose_delta_actions", _delta48())
def pose_delta_actions(spark, d):
    """48-D delta between the vector and its rotation by 16 places, also compared with brute force in the tests."""
    prev = F.concat(F.slice("embedding", 17, 48), F.slice("embedding", 1, 16))
    t = emb(spark, d).select("vec_id", F.slice("embedding", 1, 48).alias("a"), F.slice(prev, 1, 48).alias("p"), ext().alias("ext"))
    return out(t.withColumn("m", P.pose_delta_48(F.col("a"), F.col("p"), F.col("ext"))), "m")


SL = """s0 AS (SELECT vec_id, v, sqrt(v[4]*v[4]+v[5]*v[5]+v[6]*v[6]+v[7]*v[7]) AS n1, sqrt(v[11]*v[11]+v[12]*v[12]+v[13]*v[13]+v[14]*v[14]) AS n2 FROM e),
 s1 AS (SELECT *, (v[4]*v[11]+v[5]*v[12]+v[6]*v[13]+v[7]*v[14])/(n1*n2) AS d FROM s0),
 s2 AS (SELECT *, acos(least(abs(d),1)) AS th, CASE WHEN d<0 THEN -1 ELSE 1 END AS sg FROM s1),
 s3 AS (SELECT *, sin(0.7*th)/sin(th) AS wa, sin(0.3*th)/sin(th)*sg AS wb FROM s2),"""
SLERP = [f"CASE WHEN vec_id%9=0 THEN 1e9 ELSE v[{i}]+(v[{i + 7}]-v[{i}])*0.3 END" for i in (1, 2, 3)] + [
    f"CASE WHEN vec_id%9=0 THEN 1e9 ELSE wa*v[{i}]/n1+wb*v[{i + 7}]/n2 END" for i in (4, 5, 6, 7)]


@query("resample_pose_slerp", emit(SL, "s3", SLERP))
def resample_pose_slerp(spark, d):
    def unitq(v):
        return V.let(v, lambda q: F.array(*R.unit([F.get(q, i) for i in range(4)])))

    a = F.concat(F.when(F.col("vec_id") % 9 == 0, F.array_repeat(F.lit(1e9), 3)).otherwise(span(0, 3)), unitq(span(3, 7)))
    t = emb(spark, d).select("vec_id", a.alias("a"), F.concat(span(7, 10), unitq(span(10, 14))).alias("b"))
    return out(t.withColumn("m", P.resample_pose(F.col("a"), F.col("b"), F.lit(0.3))), "m")


def marks_out(df, digits: int = 5):
    """One row per mark and dimension."""
    t = df.select("vec_id", F.posexplode("m").alias("mark", "row")).select("vec_id", F.col("mark").cast("bigint").alias("mark"), F.posexplode("row").alias("dim", "x"))
    return t.select("vec_id", "mark", F.col("dim").cast("bigint").alias("dim"), (F.round("x", digits) + 0.0).alias("value"))


def chunk(rows: int, width: int):
    """The vector as a chunk of poses; every ninth holds a marker."""
    c = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice("embedding", i * width + 1, width))
    return F.transform(c, lambda row, i: F.when((F.col("vec_id") % 9 == 0) & (i == 4), F.array_repeat(F.lit(1e9), width)).otherwise(row))


def marks_sql(rows: int, width: int, count: int, ctes: str, src: str, cells: list[str]) -> str:
    """Row pairs (a, b) around each mark with its fraction f; ``src`` holds the rows."""
    return f"""{BASE}, r AS (SELECT vec_id, i, [v[{width}*i+k] for k in range(1,{width + 1})] AS x FROM e, range({rows}) t(i)), {ctes}
 mk AS (SELECT j AS mark, least(j*{rows - 1}//{count - 1},{rows - 2}) AS i, j*{rows - 1}/{count - 1}.0::double - least(j*{rows - 1}//{count - 1},{rows - 2}) AS f FROM range({count}) t(j)),
 ab AS (SELECT a.vec_id, mark, f, a AS a, b AS b FROM mk JOIN {src} a ON a.i=mk.i JOIN {src} b ON b.vec_id=a.vec_id AND b.i=mk.i+1),
 l AS (SELECT vec_id, mark, CASE WHEN vec_id%9=0 THEN [1e9 for k in range({width})] ELSE [{', '.join(cells)}] END AS l FROM ab), u AS (SELECT vec_id, mark, unnest(range(len(l))) AS dim, unnest(l) AS value FROM l)
SELECT vec_id, mark, dim, round(value,5)+0.0 AS value FROM u"""


CONTINUOUS = """n AS (SELECT *, sqrt(x[4]*x[4]+x[5]*x[5]+x[6]*x[6]+x[7]*x[7]) AS m FROM r), q AS (SELECT vec_id, i, x, [x[4]/m,x[5]/m,x[6]/m,x[7]/m] AS q FROM n),
 g AS (SELECT *, CASE WHEN list_dot_product(q, lag(q) OVER (PARTITION BY vec_id ORDER BY i)) < 0 THEN -1 ELSE 1 END AS g FROM q),
 c AS (SELECT vec_id, i, x, q, product(g) OVER (PARTITION BY vec_id ORDER BY i) AS s FROM g),"""
TH = "acos(least(abs(list_dot_product(a.q,b.q)),1))"
CHUNKED = [f"a.x[{k}]+(b.x[{k}]-a.x[{k}])*f" for k in (1, 2, 3)] + [
    f"(sin((1-f)*{TH})*a.s*a.q[{k}]+sin(f*{TH})*b.s*b.q[{k}])/sin({TH})" for k in (1, 2, 3, 4)]


@query("resample_pose_chunk", marks_sql(9, 7, 14, CONTINUOUS, "c", CHUNKED))
def resample_pose_chunk(spark, d):
    return marks_out(emb(spark, d).select("vec_id", P.resample_pose_chunk(chunk(9, 7), 14).alias("m")))


TURN = "((b.x[{k}]*4-a.x[{k}]*4) - 2*pi()*floor((b.x[{k}]*4-a.x[{k}]*4+pi())/(2*pi())))"
ANGLES = [f"a.x[{k}]*4+(b.x[{k}]*4-a.x[{k}]*4)*f" for k in (1, 2, 3)] + [
    f"(a.x[{k}]*4+{TURN.format(k=k)}*f+pi()) - 2*pi()*floor((a.x[{k}]*4+{TURN.format(k=k)}*f+pi())/(2*pi())) - pi()" for k in (4, 5, 6)]


@query("resample_euler_chunk", marks_sql(10, 6, 7, "", "r", ANGLES))
def resample_euler_chunk(spark, d):
    """Angles of four times the components, so that many steps pass half a turn."""
    wide = F.transform(chunk(10, 6), lambda row: F.transform(row, lambda x: x * 4))
    return marks_out(emb(spark, d).select("vec_id", P.resample_euler_chunk(wide, 7).alias("m")))


@query("head_to_world", emit(QCTE, "m", [f"{a} + {b}" for a, b in zip(mv(EX, PT), T1)]))
def head_to_world(spark, d):
    t = emb(spark, d).select("vec_id", R.matrix_to_quat(R.quat_to_matrix(span(0, 4))).alias("q"), span(7, 10).alias("p"), span(4, 7).alias("t"))
    return out(t.withColumn("m", P.head_to_world(F.col("p"), F.col("q"), F.col("t"))), "m")


@query("project_to_pixels", BASE + """, p AS (SELECT vec_id, v[1]*500/nullif(v[3],0)+320 AS u, v[2]*500/nullif(v[3],0)+240 AS w, v[3] AS z FROM e)
SELECT vec_id, round(u,4)+0.0 AS u, round(w,4)+0.0 AS v, z>0 AND u>=0 AND u<640 AND w>=0 AND w<480 AS visible FROM p""")
def project_to_pixels(spark, d):
    t = emb(spark, d).select("vec_id", P.project(span(0, 3), 500.0, 500.0, 320.0, 240.0, 640, 480).alias("p"))
    return t.select("vec_id", (F.round("p.u", 4) + 0.0).alias("u"), (F.round("p.v", 4) + 0.0).alias("v"), "p.visible")


GZ = "sqrt(tan(v[8])*tan(v[8])+tan(v[9])*tan(v[9])+1)"


@query("gaze_endpoint", emit(QCTE, "m", [f"{a} + {b}" for a, b in zip(mv(EX, [f"tan(v[8])/{GZ}*(2+v[10])", f"tan(v[9])/{GZ}*(2+v[10])", f"1/{GZ}*(2+v[10])"]), T1)]))
def gaze_endpoint(spark, d):
    t = emb(spark, d).select("vec_id", ext().alias("ext"), span(7, 10).alias("g"))
    return out(t.withColumn("m", P.gaze_endpoint(F.get("g", 0), F.get("g", 1), 2.0 + F.get("g", 2), F.col("ext"))), "m")
