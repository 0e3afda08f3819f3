import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from gaitworks.streaming import jobs, recorder

GAP = 3600 * 10**6
T0 = datetime(2025, 3, 1)
SCHEMA = "device string, t timestamp, n long, stop boolean"


def plain_episodes(frames, now):
    """Frame by frame: (start, stop, frames, ended) of one recorder's frames in order of time."""
    out = []
    for us, flag in frames:
        if not out or out[-1][3] == "flag" or us - out[-1][1] >= GAP:
            out.append([us, us, 0, "open"])
        out[-1][1], out[-1][2] = us, out[-1][2] + 1
        if flag:
            out[-1][3] = "flag"
    for i, e in enumerate(out):
        if e[3] != "flag" and (i + 1 < len(out) or e[1] + GAP <= now):
            e[3] = "gap"
    return [tuple(e) for e in out]


def test_cut_in_pieces_equals_a_loop():
    rnd = random.Random(3)
    for _ in range(200):
        us = np.cumsum([rnd.choice([0, 1, GAP // 3, GAP - 1, GAP, 2 * GAP]) for _ in range(rnd.randint(0, 12))]).astype("int64")
        flag = np.array([rnd.random() < 0.3 for _ in us], bool)
        now = int(us[-1]) + rnd.choice([0, GAP - 1, GAP]) if len(us) else 0
        held, seen, at = recorder.NOTHING_YET, {}, 0
        while at < len(us):
            step = rnd.randint(0, 4)
            held, t = recorder.cut(held, us[at : at + step], flag[at : at + step], GAP, int(us[min(at + step, len(us)) - 1]) if at + step else -1)
            seen |= {r.episode: (r.start, r.stop, r.frames, r.ended) for r in t.itertuples()}
            at += step
        held, t = recorder.cut(held, us[:0], flag[:0], GAP, now)
        seen |= {r.episode: (r.start, r.stop, r.frames, r.ended) for r in t.itertuples()}
        assert seen == dict(enumerate(plain_episodes(list(zip(us.tolist(), flag)), now)))


def micros(t):
    return int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, check):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    t = recorder.run_recorder(recorder.recorded_episodes(s, "device", "t", "n", "stop", "1 hour"), "device", out, check)
    got = {}
    for r in t.collect():
        got.setdefault(r.device, []).append((r.episode, micros(r.start), micros(r.stop), r.frames, r.ended))
    return {k: sorted(v) for k, v in got.items()}


def expected(rows, now):
    by = {}
    for k, t, n, stop in rows:
        if k is not None and t is not None:
            by.setdefault(k, []).append((micros(t), n, bool(stop)))
    return {k: [(i, *e) for i, e in enumerate(plain_episodes([(us, f) for us, _, f in sorted(v)], now))] for k, v in by.items()}


def test_disorder_within_the_delay_and_a_restart(spark, tmp_path):
    rnd = random.Random(4)
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows, t = [], T0
    for n in range(90):
        t += timedelta(minutes=rnd.choice([0, 1, 2, 3, 61, 130]))
        rows.append((rnd.choice("ab"), t, n, rnd.choice([True, False, False, None])))
    # frames up to four minutes apart change places, also over the edges of files
    shuffled = sorted(rows, key=lambda r: (r[1] + timedelta(minutes=rnd.random() * 4), r[2])) + [(None, T0, 0, True), ("a", None, 0, True)]
    files = [shuffled[:30], shuffled[30:60], shuffled[60:]]
    for i, part in enumerate(files):
        land(spark, folder, part)
        seen = [r for f in files[: i + 1] for r in f]
        now = micros(max(r[1] for r in seen if r[1])) - 10 * 60 * 10**6
        assert run(spark, folder, out, check) == expected(seen, now)  # each call goes on from the last one's state
    assert spark.conf.get(recorder.STORE, "").endswith("RocksDBStateStoreProvider") is False


def test_a_late_frame_that_joins_two_episodes(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    first = [("a", at(0), 0, False), ("a", at(7), 1, True), ("a", at(8), 2, False)]
    land(spark, folder, first)
    assert [e[3:] for e in run(spark, folder, out, check)["a"]] == [(2, "flag"), (1, "open")]
    late = [("a", at(3), 3, True), ("a", at(9), 4, None)]
    land(spark, folder, late)
    assert [e[3:] for e in run(spark, folder, out, check)["a"]] == [(2, "flag"), (1, "flag"), (2, "open")]


def test_no_frames(spark, tmp_path):
    land(spark, str(tmp_path / "in"), [(None, None, None, None)])
    assert run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")) == {}
    assert jobs.WATERMARK == "10 minutes" and isinstance(recorder.cut(recorder.NOTHING_YET, np.array([], "int64"), np.array([], bool), GAP, 0)[1], pd.DataFrame)
