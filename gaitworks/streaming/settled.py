"""Ordered work per key in a stream: rows wait until the watermark has passed them, are then handled in order of time, and
until then are shown as they would come out now."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaitworks.streaming import jobs
from gaitworks.streaming.recorder import state_store

TRIGGER_BYTES = 512 << 20  # of landed files a trigger; a key holding a third of them still fits one task
Step = Callable[[tuple, pd.DataFrame], tuple[tuple, list]]


def in_stretches(step: Step, start: tuple, held: tuple, last: int | None, rows: pd.DataFrame, idle: int) -> tuple[tuple, int | None, list]:
    """``step`` over rows in order of ``us``; after ``idle`` microseconds or more without a row it starts again.

    Returns what is held, the time of the last row and one result per row.
    """
    us = rows["us"].to_numpy()
    before = np.concatenate(([us[0] if last is None else last], us[:-1])) if len(us) else us
    out: list = []
    cuts = [0, *np.flatnonzero(us - before >= idle).tolist(), len(us)]
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            held, got = step(start if number else held, rows if b - a == len(us) else rows.iloc[a:b].reset_index(drop=True))
            out += got
    return held, int(us[-1]) if len(us) else last, out


class Settled(StatefulProcessor):
    """State of a key: rows not yet behind the watermark, what the step holds, and the time of the last settled row.

    Rows may come in any order within the watermark's delay; the result does not depend on how triggers cut the stream.
    A timer settles them, another one deletes the state ``idle`` after the key's last row.
    """

    def __init__(self, key: str, order: str, result: str, payload: Mapping[str, str], held: str, start: tuple, step: Step, idle_us: int):
        self.key, self.order, self.result, self.fields = key, order, result, held
        self.payload = {"us": "bigint", "place": "bigint", **payload}
        self.columns = list(self.payload)
        self.start, self.step, self.idle = start, step, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {kind}" for c, kind in self.payload.items()))
        self.held = handle.getValueState("held", f"{self.fields}, last bigint, version bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            new += zip(*[[None if v != v else v for v in pdf[c].tolist()] for c in self.columns])
        if new:
            latest = max(r[0] for r in new)
            self.handle.registerTimer(latest // 1000 + 1)
            self.handle.registerTimer((latest + self.idle) // 1000 + 1)
        yield from self._show(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._show(key, timerValues)

    def _show(self, key, timerValues, new: Sequence[tuple] = ()) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        *held, last, version = self.held.get() or (*self.start, None, 0)
        held = tuple(list(h) if isinstance(h, (list, tuple, np.ndarray)) else h for h in held)
        kept = [tuple(r) for r in self.waiting.get()]
        rows = sorted((*kept, *new), key=lambda r: r[:2])
        n = sum(r[0] < now for r in rows)
        if n == len(rows):
            if kept:
                self.waiting.clear()
        elif n:
            self.waiting.put(rows[n:])
        elif new:
            self.waiting.appendList(list(new))
        held, last, settled = in_stretches(self.step, self.start, held, last, self._frame(rows[:n]), self.idle)
        _, _, open_ = in_stretches(self.step, self.start, held, last, self._frame(rows[n:]), self.idle)
        if n == len(rows) and (last is None or last + self.idle < now):
            self.held.clear()
        else:
            self.held.update((*held, last, version + 1))
        if rows:
            yield pd.DataFrame({self.key: key[0], self.order: [r[1] for r in rows], self.result: settled + open_, "version": version + 1})

    def _frame(self, rows: Sequence[tuple]) -> pd.DataFrame:
        columns = zip(*rows) if rows else [()] * len(self.columns)
        return pd.DataFrame({c: np.array(v, "int64" if c in ("us", "place") else object) for c, v in zip(self.columns, columns)})


def _settle(stream: DataFrame, key: str, time: str, order: str, columns: Sequence[str], result: tuple[str, str], held: str, start: tuple, step: Step, idle: str) -> DataFrame:
    kinds = dict(stream.dtypes)
    idle_us = int(pd.Timedelta(idle) / pd.Timedelta(microseconds=1))
    s = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(order).isNotNull()).withWatermark(time, jobs.WATERMARK).select(
        F.col(key), F.col(time).alias("_time"), F.unix_micros(time).alias("us"), F.col(order).cast("bigint").alias("place"), *columns)
    work = Settled(key, order, result[0], {c: kinds[c] for c in columns}, held, start, step, idle_us)
    return s.groupBy(key).transformWithStateInPandas(
        work, f"`{key}` {kinds[key]}, `{order}` bigint, {result[0]} {result[1]}, version bigint", "update", "eventTime")


def average(held: tuple, values: np.ndarray, weights: np.ndarray) -> tuple[tuple, np.ndarray]:
    """Weighted mean of the last distinct-in-a-row values, newest first; until there are as many as weights, the value."""
    queue = np.asarray(held[0], float)
    line = np.concatenate((queue, values))
    new = np.concatenate(([True], line[1:] != line[:-1]))[: len(line)]
    runs, n = line[new], len(weights)
    means = runs.copy()
    if len(runs) >= n:
        means[n - 1 :] = np.lib.stride_tricks.sliding_window_view(runs, n) @ weights[::-1]
    return (runs[-n:].tolist(),), means[np.cumsum(new) - 1][len(queue) :]


def weighted_filter(stream: DataFrame, key: str, time: str, order: str, value: str, weights: Sequence[float], idle: str = "1 day") -> DataFrame:
    """Weighted moving average of the last W distinct-in-a-row values of a key; newest value times weights[0].

    Until W values are there the last value passes; a repeated value keeps the previous output. A null value takes no part
    and gets null. ``order`` is an integer, unique in a key, that orders rows of one time. Rows without key, time or order
    take no part; columns beside those named are not read.
    """
    w = np.asarray(weights, float)
    if not np.isclose(w.sum(), 1.0):
        raise ValueError("weights must sum to 1")

    def step(held: tuple, rows: pd.DataFrame) -> tuple[tuple, list]:
        x = rows["value"].to_numpy(float)
        there = ~np.isnan(x)
        held, got = average(held, x[there], w)
        out = np.full(len(x), None, object)
        out[there] = got
        return held, out.tolist()

    s = stream.withColumn("value", F.col(value).cast("double"))
    return _settle(s, key, time, order, ["value"], ("filtered", "double"), "queue array<double>", ([],), step, idle)


def confirmed_switch(stream: DataFrame, key: str, time: str, order: str, votes: int | Mapping[str, int], idle: str = "1 day") -> DataFrame:
    """A proposed subtask is committed after so many votes from distinct fresh captures; ``votes`` may differ for the
    first subtask, a switch and done. One row per vote, ``committed`` null where nothing is.

    Columns: decision, next_subtask, capture_key, capture_fresh. What is held per episode is bounded by the number of
    votes; it goes ``idle`` after the episode's last vote, so an episode that goes on later starts anew. ``order`` as above.
    """
    need = dict.fromkeys(("first", "switch", "done"), votes) if isinstance(votes, int) else dict(votes)

    def step(held: tuple, rows: pd.DataFrame) -> tuple[tuple, list]:
        held, commits = jobs.count_votes(rows, held, need)
        at = dict(commits)
        return held, [at.get(i) for i in range(len(rows))]

    s = stream.withColumn("capture_fresh", F.coalesce("capture_fresh", F.lit(False)))
    return _settle(s, key, time, order, ["decision", "next_subtask", "capture_key", "capture_fresh"], ("committed", "string"),
                   "current string, done boolean, run string, captures array<string>", ("", False, "", []), step, idle)


def run_settled(stream: DataFrame, key: str, order: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is there; each row as it was last shown. A later call with the same folders goes on."""
    with state_store(stream.sparkSession):
        return jobs.run_available(stream, "update", [key, order], path, checkpoint, newest="version").drop("version")
