"""Recorded episodes cut out of a stream of frames: ended by the operator's flag or by a pause, numbered per recorder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaitworks.streaming import jobs

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOTHING_YET = (-1, 0, 0, 0, True)  # episode, start, last frame, frames, whether it has ended


def cut(held: tuple, us: np.ndarray, flag: np.ndarray, gap: int, now: int) -> tuple[tuple, pd.DataFrame]:
    """Episodes among frames in time order, going on from ``held``: the new ``held`` and one row per episode touched.

    A frame opens an episode after a flagged frame or ``gap`` microseconds or more after the frame before. The last one
    ends by itself once ``now`` has reached its last frame plus the gap.
    """
    number, start, last, frames, done = held
    rows = [] if done else [[number, start, last, frames, "open"]]
    for at, flagged in zip(us.tolist(), flag.tolist()):
        if done or at - last >= gap:
            if not done:
                rows[-1][4] = "gap"
            number, start, frames = number + 1, at, 0
            rows.append([number, start, at, 0, "open"])
        last, frames, done = at, frames + 1, bool(flagged)
        rows[-1][2:] = [last, frames, "flag" if flagged else "open"]
    if rows and rows[-1][4] == "open" and last + gap <= now:
        rows[-1][4], done = "gap", True
    return (number, start, last, frames, done), pd.DataFrame(rows, columns=["episode", "start", "stop", "frames", "ended"])


class Recorder(StatefulProcessor):
    """State of a recorder: frames not yet behind the watermark, its open episode, and what it has shown.

    Frames may come in any order within the watermark's delay. They are settled in order of time once the watermark has
    passed them; until then their episodes are shown as they would stand now. ``version`` tells a newer row of an episode
    from an older one; an episode that late frames have merged away comes once more with no frames.
    """

    def __init__(self, key: str, gap_us: int):
        self.key, self.gap = key, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, place bigint, flag boolean")
        self.held = handle.getValueState("held", "episode bigint, start bigint, last bigint, frames bigint, done boolean, shown bigint, version bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            self.waiting.appendList(list(pdf[["us", "place", "flag"]].itertuples(index=False, name=None)))
            top = int(pdf["us"].max())
            latest = top if latest is None else max(latest, top)
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)               # these frames can be settled
            self.handle.registerTimer((latest + self.gap) // 1000 + 1)  # nothing came for the length of a gap
        yield from self._show(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._show(key, timerValues)

    def _show(self, key, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        *held, shown, version = self.held.get() if self.held.exists() else (*NOTHING_YET, -1, 0)
        rows = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["us", "place", "flag"])
        rows = rows.astype({"us": "int64", "place": "int64", "flag": "bool"}).sort_values(["us", "place"])
        behind = rows["us"] < now
        if behind.any():
            self.waiting.clear()
            if not behind.all():
                self.waiting.put(list(rows[~behind].itertuples(index=False, name=None)))
        arrays = lambda t: (t["us"].to_numpy(), t["flag"].to_numpy())
        held, settled = cut(tuple(held), *arrays(rows[behind]), self.gap, now)
        ahead, open_ = cut(held, *arrays(rows[~behind]), self.gap, now)
        both = pd.concat([settled, open_]).drop_duplicates("episode", keep="last")
        gone = pd.DataFrame({"episode": np.arange(ahead[0] + 1, shown + 1)}).assign(start=0, stop=0, frames=0, ended="open")
        self.held.update((*held, ahead[0], version + 1))
        out = pd.concat([both, gone])[["episode", "start", "stop", "frames", "ended"]]
        if len(out):
            out.insert(0, self.key, key[0])
            yield out.assign(version=version + 1)


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB):
    """Keyed state with lists and timers needs this state store; the session's own choice comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, provider)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def recorded_episodes(stream: DataFrame, key: str, time: str, place: str, flag: str, gap: str) -> DataFrame:
    """Episodes of each recorder: number from 0, first and last frame in microseconds, frames, ``ended`` flag, gap or open.

    ``place`` orders frames of one time. A null flag is none; frames without a key or time take no part. Rows of one
    episode replace each other by ``version``.
    """
    gap_us = int(pd.Timedelta(gap) / pd.Timedelta(microseconds=1))
    s = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, jobs.WATERMARK).select(
        key, time, F.unix_micros(time).alias("us"), F.col(place).cast("bigint").alias("place"), F.coalesce(flag, F.lit(False)).alias("flag"))
    out = f"`{key}` {dict(stream.dtypes)[key]}, episode bigint, start bigint, stop bigint, frames bigint, ended string, version bigint"
    return s.groupBy(key).transformWithStateInPandas(Recorder(key, gap_us), out, "update", "eventTime")


def run_recorder(stream: DataFrame, key: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is there; each episode as it was last shown. A later call with the same folders goes on."""
    with state_store(stream.sparkSession):
        t = jobs.run_available(stream, "update", [key, "episode"], path, checkpoint, newest="version")
    t = t.where("frames > 0").drop("version")
    return t.withColumns({c: F.timestamp_micros(c) for c in ("start", "stop")})
