import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from gaitworks.streaming import jobs, settled

T0 = datetime(2025, 3, 1)
WEIGHTS = [0.5, 0.3, 0.2]
ROWS = "k long, i long, t timestamp, x double"
VOTES = "k long, i long, t timestamp, decision string, next_subtask string, capture_key string, capture_fresh boolean"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def land(spark, folder, rows, schema, parts=1):
    """Several files, one a trigger, so that state crosses triggers."""
    for chunk in np.array_split(np.arange(len(rows)), parts):
        spark.createDataFrame([rows[j] for j in chunk], schema).coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def filtered(spark, tmp_path, idle="1 day", result="out"):
    t = settled.weighted_filter(read(spark, str(tmp_path / "in"), ROWS), "k", "t", "i", "x", WEIGHTS, idle)
    return {(r.k, r.i): r.filtered for r in settled.run_settled(t, "k", "i", str(tmp_path / result), str(tmp_path / f"{result}-check")).collect()}


def plain_filter(rows, idle=timedelta(days=1)):
    """Row by row in order of time."""
    out, queues, last = {}, {}, {}
    for k, i, t, x in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: (r[2], r[1])):
        if k in last and t - last[k] >= idle:
            queues[k] = []
        last[k], queue = t, queues.setdefault(k, [])
        if x is None:
            out[k, i] = None
            continue
        if not queue or queue[-1] != x:
            queue = queues[k] = (queue + [x])[-3:]
        out[k, i] = sum(w * v for w, v in zip(WEIGHTS, queue[::-1])) if len(queue) == 3 else queue[-1]
    return out


def same(got, want):
    assert set(got) == set(want)
    assert all(got[k] is None if v is None else got[k] == pytest.approx(v) for k, v in want.items())


def test_filter_of_disordered_rows_over_triggers_and_a_restart(spark, tmp_path):
    rnd = random.Random(5)
    rows, minute = [], 0
    for i in range(80):
        minute += rnd.choice([0, 1, 2, 5])
        rows.append((rnd.choice([0, 0, 1]), i, at(minute), rnd.choice([1.0, 1.0, 2.0, 4.0, 7.0, None])))
    rows = sorted(rows, key=lambda r: (r[2] + timedelta(minutes=rnd.random() * 4), r[1])) + [(None, 0, T0, 1.0), (0, 99, None, 1.0)]
    for cut in (50, len(rows)):
        land(spark, str(tmp_path / "in"), rows[0 if cut == 50 else 50 : cut], ROWS, 2)
        same(filtered(spark, tmp_path), plain_filter(rows[:cut]))  # the second call goes on from the first one's state


def test_idle_state_starts_again_and_its_row_goes(spark, tmp_path):
    hours = [(0, 0, 0, 1.0), (0, 1, 0, 2.0), (1, 2, 40, 5.0), (1, 3, 41, 5.0), (1, 4, 42, 5.0), (1, 5, 43, 5.0), (0, 6, 44, 4.0), (0, 7, 44, 9.0)]
    rows = [(k, i, at(60 * h), x) for k, i, h, x in hours]
    land(spark, str(tmp_path / "in"), rows, ROWS, 4)
    got = filtered(spark, tmp_path, "2 hours")
    same(got, plain_filter(rows, timedelta(hours=2)))
    assert got[0, 7] == 9.0  # the second value of a new queue, not the fourth of the old one


def test_stretches_do_not_depend_on_the_cuts():
    import pandas as pd

    rnd = random.Random(8)
    step = lambda held, t: ((held[0] + len(t),), [held[0] + j for j in range(len(t))])
    for _ in range(100):
        us = np.cumsum([rnd.choice([0, 3, 9, 10, 25]) for _ in range(12)])
        rows = pd.DataFrame({"us": us})
        whole = settled.in_stretches(step, (0,), (0,), None, rows, 10)
        held, last, out, done = (0,), None, [], 0
        while done < 12:
            n = rnd.randint(0, 5)
            held, last, got = settled.in_stretches(step, (0,), held, last, rows[done : done + n], 10)
            out, done = out + got, done + n
        assert (held, last, out) == whole


def test_votes_over_triggers(spark, tmp_path):
    votes = [("continue", "Open Door", 1, True), ("continue", "open  door", 1, True), ("continue", "close", 2, True), ("switch", "Open Door", 3, True),
             ("switch", "OPEN door", 4, False), ("switch", "OPEN door", 5, True), ("switch", "close", 6, True), ("continue", "close", 7, True),
             ("switch", "close", 8, True), ("switch", "open door", 9, True), ("switch", "close", 10, True), ("switch", "Close", 11, True),
             ("done", None, 12, True), ("done", None, 13, True), ("switch", "again", 14, True), ("switch", "again", 15, True)]
    rows = [(0, i, at(i), d, t, str(c), ok) for i, (d, t, c, ok) in enumerate(votes)]
    rows[3], rows[4] = rows[4], rows[3]  # they arrive in another order
    land(spark, str(tmp_path / "in"), rows, VOTES, 3)
    t = settled.run_settled(settled.confirmed_switch(read(spark, str(tmp_path / "in"), VOTES), "k", "t", "i", 2), "k", "i")
    got = [(r.i, r.committed) for r in t.orderBy("i").collect()]
    assert len(got) == len(votes)
    assert [g for g in got if g[1]] == [(5, "OPEN door"), (11, "Close"), (13, "done")]


def test_weights_and_limits(spark, tmp_path):
    land(spark, str(tmp_path / "in"), [(1, 1, T0, 1.0)], ROWS)
    with pytest.raises(ValueError, match="sum to 1"):
        settled.weighted_filter(read(spark, str(tmp_path / "in"), ROWS), "k", "t", "i", "x", [0.5, 0.3])
    spark.read.parquet(str(tmp_path / "in")).coalesce(1).write.parquet(str(tmp_path / "tables" / "x.parquet"))
    source = jobs.file_stream(spark, str(tmp_path / "tables"), "x.parquet", bytes_per_trigger=settled.TRIGGER_BYTES)
    assert source.isStreaming and source.columns == ["k", "i", "t", "x"]


class Store:
    """A state variable that counts how often it is asked."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def __getattr__(self, name):
        def call(value=None):
            self.calls += 1
            if name == "exists":
                return bool(self.rows)
            if name == "get":
                return iter(list(self.rows)) if self.is_list else (self.rows[0] if self.rows else None)
            self.rows = {"clear": [], "appendList": self.rows + list(value or []), "put": value, "update": [value]}[name]
        return call


def test_a_key_asks_its_state_four_times_a_trigger():
    from types import SimpleNamespace

    import pandas as pd

    waiting, held = Store(), Store()
    waiting.is_list, held.is_list = True, False
    step = lambda queue, rows: settled.average(queue, rows["value"].to_numpy(float), np.asarray(WEIGHTS))
    work = settled.Settled("k", "i", "filtered", {"value": "double"}, "queue array<double>", ([],), lambda q, rows: (lambda h, got: (h, got.tolist()))(*step(q, rows)), 10**9)
    work.init(SimpleNamespace(getListState=lambda *_: waiting, getValueState=lambda *_: held, registerTimer=lambda _: None))
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    rows = pd.DataFrame({"us": [3000, 1000, 2000], "place": [3, 1, 2], "value": [4.0, 1.0, 2.0]})
    shown = pd.concat(work.handleInputRows((0,), iter([rows]), clock(0)))
    assert shown[["i", "filtered"]].to_numpy().tolist() == [[1, 1.0], [2, 2.0], [3, pytest.approx(2.8)]]
    assert waiting.calls + held.calls <= 4
    shown = pd.concat(work.handleExpiredTimer((0,), clock(10), None))
    assert shown["filtered"].tolist() == [1.0, 2.0, pytest.approx(2.8)] and not waiting.rows
    assert waiting.calls + held.calls <= 8


def test_many_commits_of_one_episode_are_one_pass():
    import time

    import pandas as pd

    n = 6000
    votes = pd.DataFrame({"decision": "switch", "next_subtask": [f"task {i // 2}" for i in range(n)], "capture_key": [str(i) for i in range(n)], "capture_fresh": True})
    votes.loc[:1, "decision"] = "continue"
    start = time.process_time()
    _, commits = jobs.count_votes(votes, ("", False, "", []), dict.fromkeys(("first", "switch", "done"), 2))
    assert time.process_time() - start < 2
    assert commits == [(i, f"task {i // 2}") for i in range(1, n, 2)]
