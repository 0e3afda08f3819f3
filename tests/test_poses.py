import numpy as np
from pyspark.sql import functions as F

from gaitworks.functions import rotations as R
from gaitworks.operators import poses


def rand_rot(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def rot6d(v):
    a = v[:3] / np.linalg.norm(v[:3])
    b = v[3:6] - a @ v[3:6] * a
    b /= np.linalg.norm(b)
    return np.stack([a, b, np.cross(a, b)], axis=1)


def test_conversions_agree_for_any_rotation(spark):
    rng = np.random.default_rng(0)
    mats = [rand_rot(rng) for _ in range(40)] + [np.diag([1, -1, -1.0]), np.diag([-1, 1, -1.0]), np.diag([-1, -1, 1.0]), np.eye(3)]
    df = spark.createDataFrame([([float(x) for x in m.ravel()],) for m in mats], "m array<double>")
    for name in ("quaternion", "rotation_6d", "euler", "axis_angle"):
        back = R.convert(R.convert(F.col("m"), "matrix", name), name, "matrix")
        for r in df.select("m", back.alias("b")).collect():
            np.testing.assert_allclose(r.b, r.m, atol=1e-9)


def test_zero_quaternion_is_identity(spark):
    got = spark.createDataFrame([([0.0] * 4,)], "q array<double>").select(R.quat_to_matrix(F.col("q")).alias("m")).first().m
    np.testing.assert_allclose(got, np.eye(3).ravel())


def test_pitch_singularity(spark):
    df = spark.createDataFrame([([0.4, np.pi / 2, 0.3],), ([0.4, -np.pi / 2, 0.3],)], "e array<double>")
    m = R.euler_to_matrix(F.col("e"))
    for r in df.select(m.alias("m"), R.euler_to_matrix(R.matrix_to_euler(m)).alias("b")).collect():
        np.testing.assert_allclose(r.b, r.m, atol=1e-6)


def test_pose_delta_48(spark):
    rng = np.random.default_rng(2)
    ext = np.eye(4)
    ext[:3, :3], ext[:3, 3] = rand_rot(rng), rng.normal(size=3)
    rows = [([float(x) for x in rng.normal(size=48)], [float(x) for x in rng.normal(size=48)], [float(x) for x in ext.ravel()]) for _ in range(6)]
    df = spark.createDataFrame(rows, "a array<double>, p array<double>, e array<double>")
    inv = np.linalg.inv(ext)
    for r in df.select("a", "p", poses.pose_delta_48(F.col("a"), F.col("p"), F.col("e")).alias("d")).collect():
        a, p, want = np.array(r.a), np.array(r.p), []
        for b in (0, 24):
            ts = []
            for v in (a, p):
                t = np.eye(4)
                t[:3, :3], t[:3, 3] = rot6d(v[b + 3 : b + 9]), v[b : b + 3]
                ts.append(inv @ t)
            turn = ts[0][:3, :3] @ ts[1][:3, :3].T
            rpy = [np.arctan2(turn[2, 1], turn[2, 2]), np.arctan2(-turn[2, 0], np.hypot(turn[0, 0], turn[1, 0])), np.arctan2(turn[1, 0], turn[0, 0])]
            want += [*(ts[0][:3, 3] - ts[1][:3, 3]), *rpy, 0, 0, 0]
            for k in range(5):
                s = slice(b + 9 + 3 * k, b + 12 + 3 * k)
                want += list(inv[:3, :3] @ (a[s] - p[s]))
        np.testing.assert_allclose(r.d, want, atol=1e-9)


def test_invalid_pose_marks(spark):
    df = spark.createDataFrame([([1e9] * 3 + [1.0, 0.0, 0.0, 0.0], [0.0] * 3 + [1.0, 0.0, 0.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(poses.resample_pose(F.col("a"), F.col("b"), F.lit(0.5)).alias("m")).first().m == [1e9] * 7


def slerp_marks(chunk, count):
    """Plain loop: signs row after row, then the bracket of each mark."""
    q = np.array([r[3:] if np.linalg.norm(r[3:]) > 0 else [1, 0, 0, 0] for r in chunk], float)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    for i in range(1, len(q)):
        if q[i - 1] @ q[i] < 0:
            q[i] = -q[i]
    at = np.linspace(0, len(chunk) - 1, count)
    xyz = np.stack([np.interp(at, range(len(chunk)), chunk[:, k]) for k in range(3)], axis=1)
    out = []
    for x in at:
        i = min(int(x + 1e-9), max(len(q) - 2, 0))
        a, b, f = q[i], q[min(i + 1, len(q) - 1)], x - i
        th = np.arccos(np.clip(a @ b, -1, 1))
        out.append(a if th < 1e-9 else (np.sin((1 - f) * th) * a + np.sin(f * th) * b) / np.sin(th))
    return np.hstack([xyz, out])


def test_pose_chunks_against_a_loop(spark):
    rng = np.random.default_rng(5)
    chunks = [rng.normal(size=(t, 7)) for t in (1, 2, 3, 9, 30)]
    chunks[3][4, 3:] = 0.0
    chunks[2][1, 3:] = -chunks[2][0, 3:]
    rows = [(i, [[float(x) for x in row] for row in c]) for i, c in enumerate(chunks)]
    df = spark.createDataFrame(rows, "i int, c array<array<double>>")
    for count in (1, 4, 9, 50):
        for r in df.select("i", poses.resample_pose_chunk(F.col("c"), count).alias("m")).collect():
            np.testing.assert_allclose(np.array(r.m), slerp_marks(chunks[r.i], count), atol=1e-9)


def test_euler_chunks_against_a_loop(spark):
    rng = np.random.default_rng(6)
    chunks = [rng.normal(size=(t, 7)) * 3 for t in (1, 2, 5, 20)] + [np.array([[0.0] * 7, [0.0, 0, 0, np.pi, -np.pi, 9, 1]])]
    rows = [(i, [[float(x) for x in row] for row in c]) for i, c in enumerate(chunks)]
    df = spark.createDataFrame(rows, "i int, c array<array<double>>")
    for count in (1, 5, 33):
        for r in df.select("i", poses.resample_euler_chunk(F.col("c"), count, 7).alias("m")).collect():
            c = chunks[r.i]
            at, wound = np.linspace(0, len(c) - 1, count), np.hstack([c[:, :3], np.unwrap(c[:, 3:6], axis=0), c[:, 6:]])
            want = np.stack([np.interp(at, range(len(c)), wound[:, k]) for k in range(7)], axis=1)
            got = np.array(r.m)
            np.testing.assert_allclose(got[:, [0, 1, 2, 6]], want[:, [0, 1, 2, 6]], atol=1e-9)
            np.testing.assert_allclose(np.exp(1j * got[:, 3:6]), np.exp(1j * want[:, 3:6]), atol=1e-9)
            assert (got[:, 3:6] >= -np.pi).all() and (got[:, 3:6] < np.pi).all()


def test_a_marker_spoils_the_chunk_and_no_rows_give_null(spark):
    ok = [1.0, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(0, [ok, ok[:6] + [1e8], ok]), (1, []), (2, None)], "i int, c array<array<double>>")
    for made in (poses.resample_pose_chunk(F.col("c"), 2), poses.resample_euler_chunk(F.col("c"), 2, 7)):
        assert [r.m for r in df.select("i", made.alias("m")).orderBy("i").collect()] == [[[1e9] * 7] * 2, None, None]
