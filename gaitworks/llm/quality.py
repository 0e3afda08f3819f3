"""Instruction quality: supervised subword embeddings, trained by numpy stochastic gradient descent."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import text_rows

BITS = 17  # hashed features
GRAMS = (2, 3, 4)  # character n-grams, in bytes of the text
DIM = 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)


def features(text: str | None) -> np.ndarray:
    """Hashed feature of every word and character n-gram of a whole text, repeats included; of each word pair, one of two
    features: the second word equals the first or not.

    White space is a boundary: an n-gram may begin or end with it, but not hold it inside.
    """
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8)
    space = _SPACE[raw]
    codes = np.where(space, np.uint8(32), raw).astype(np.uint64) + np.uint64(1)
    out = []
    for n in GRAMS:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        h, ok = np.full(m, n, np.uint64), ~(space[:m] & space[1:m + 1])
        for k in range(n):
            h = h * _PRIME + codes[k:m + k]
            if 0 < k < n - 1:
                ok &= ~space[k:m + k]
        out.append(h[ok])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    if len(starts):
        # a word's hash: the sum of its mixed bytes by place in the word
        place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
        mixed = (codes + (place.astype(np.uint64) << np.uint64(8))) * _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed *= _PRIME
        mixed[space] = 0
        words = np.add.reduceat(mixed, starts)
        out.append(words * _PRIME + np.uint64(1))
        # of pairs, what the second word is to the first: the same or another
        out.append((words[1:] == words[:-1]).astype(np.uint64) + np.uint64(77))
    h = np.concatenate(out) if out else np.empty(0, np.uint64)
    return (h * _MIX >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class SubwordModel:
    """Feature vectors, softmax weights and bias; ``logit`` holds each feature's share of the log-odds."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @property
    def logit(self) -> np.ndarray:
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.5, seed: int = 3) -> SubwordModel:
    """Fit on (features, counts, label) bags, one bag a step; a document is the mean of its feature vectors.

    Classes weigh the same whatever their shares. Without rows the model says 0.5 to all.
    """
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    w[:, 1] = rng.uniform(-0.5, 0.5, DIM)
    if not bags:
        w[:] = 0
    share = np.bincount([y for _, _, y in bags], minlength=2) / max(1, len(bags))
    scale = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)
    done, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            f, c, y = bags[i]
            step = rate * (1 - done / total)
            done += 1
            if not len(f):
                continue
            p = (c / c.sum()).astype(np.float32)
            v = p @ e[f]
            z = v @ w + b
            q = np.exp(z - z.max())
            q /= q.sum()
            q[y] -= 1
            g = (step * min(scale[y], 4.0)) * q
            dv = w @ g
            w -= np.outer(v, g)
            b -= 0.1 * g
            # rare features move as far as frequent ones would in a sum over the square root of their share
            e[f] -= np.outer(np.sqrt(p), dv)
    return SubwordModel(e, w, b)


def learnable(episode_index: int | None) -> bool:
    """True for rows that labels may be learnt from; the rest are held out."""
    return zlib.crc32(str(episode_index).encode()) % 4 != 2


def fit(episodes: DataFrame, labels: DataFrame, sample: int = 1_500) -> SubwordModel:
    """Train on labelled episodes: instructions of ``episodes``, ``good`` (0 / 1) of ``labels``, joined by episode_index.

    At most ``sample`` rows of each class, the first in the order of a hash of their index, are drawn from the rows that
    are not held out; their whole texts are turned into feature counts in Spark tasks, and the counts go to the driver.
    """
    schema = pa.schema([("label", pa.int32()), ("f", pa.binary()), ("c", pa.binary())])
    free = F.pmod(F.crc32(F.col("episode_index").cast("string").cast("binary")), F.lit(4)) != 2
    known = labels.select(F.col("episode_index").cast("long").alias("episode_index"), F.col("good").cast("int").alias("label")).where(
        free & F.col("label").isin(0, 1)).distinct()
    drawn = None
    for y in (0, 1):
        one = known.where(F.col("label") == y).orderBy(F.xxhash64("episode_index"), "episode_index").limit(sample)
        drawn = one if drawn is None else drawn.unionByName(one)

    def count(tables):
        for t in tables:
            rows = []
            for label, text in zip(t.column(0).to_pylist(), t.column(1)):
                f, c = np.unique(features(text.as_py()), return_counts=True)
                rows.append({"label": label, "f": f.astype("<i4").tobytes(), "c": c.astype("<f4").tobytes()})
                if len(rows) == 200:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    texts = text_rows(episodes, ("episode_index", "long", "episode_index"), ("instruction", "string", "instruction"))
    joined = texts.join(F.broadcast(drawn), "episode_index").select("label", "instruction", "episode_index")  # 2 * sample rows at most
    found = joined.select("label", "instruction").mapInArrow(count, "label int, f binary, c binary").toArrow()
    bags = [(np.frombuffer(f.as_buffer(), "<i4"), np.frombuffer(c.as_buffer(), "<f4"), y.as_py()) for y, f, c in zip(*[found.column(k) for k in ("label", "f", "c")])]
    bags.sort(key=lambda b: (zlib.crc32(b[0].tobytes()), zlib.crc32(b[1].tobytes()), b[2]))
    return train(bags)


def score_quality(episodes: DataFrame, model: SubwordModel, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score whole instructions of ``episodes`` (episode_index, instruction).

    Returns episode_index, held_out, score (0 to 1, higher: good likelier), predicted (1 if score >= threshold), and the
    columns named in ``keep``. A document's log-odds are the mean of its features' shares, so the tasks need one number
    a feature (half a megabyte). Null or empty text scores by the bias and two blanks. Repeated rows and null indexes
    are scored like any other; no rows give no rows. Further columns are ignored.
    """
    logit, offset = model.logit, model.offset

    def score(tables):
        for t in tables:
            scores = []
            for text in t.column("instruction"):
                f = features(text.as_py())
                x = offset + (float(logit[f].mean(dtype=np.float64)) if len(f) else 0.0)
                scores.append(float(1 / (1 + np.exp(-np.clip(x, -40, 40)))))
            yield pa.RecordBatch.from_arrays(
                [c for n, c in zip(t.schema.names, t.columns) if n in kept_names] + [pa.array(scores, pa.float64())], names=[*kept_names, "score"])

    base = episodes.select(F.col("episode_index").cast("long").alias("episode_index"), F.col("instruction").cast("string").alias("instruction"),
                           *[F.col(f"`{c}`") for c in keep if c != "instruction"])
    kept_names = [n for n in base.columns if n != "instruction" or "instruction" in keep]
    schema = ", ".join(f"`{n}` {d}" for n, d in base.dtypes if n in kept_names) + ", score double"
    held = F.coalesce(F.pmod(F.crc32(F.col("episode_index").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return base.mapInArrow(score, schema).withColumn("held_out", held).withColumn(
        "predicted", (F.col("score") >= F.lit(threshold)).cast("int"))
