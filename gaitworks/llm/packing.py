"""Packing along a space-filling curve: instructions of like wording share training sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.llm.common import stored, text_rows
from gaitworks.llm.tokens import batches, encoder, slices, wide

BINS = 512  # hashed token bins of a document vector
ENCODER = {"limit": 250_000, "segment": 4 << 20}  # a worker's memory beside what earlier stages of a pipeline left it with


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with ``bits``-bit coordinates, one row per point.

    Works from the highest bit down: a coordinate with that bit clear swaps its lower bits with the first coordinate's,
    one with it set flips them; the Gray code of what remains, read bit by bit over the axes, is the position.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for d in range(dims):
            up = (x[d] >> np.uint64(b) & np.uint64(1)).astype(bool)
            differ = np.where(up, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ differ)
            x[d] ^= differ
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint64(b) & np.uint64(1), np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << np.uint64(1) | (x[d] >> np.uint64(b) & np.uint64(1))
    return key.astype(np.int64)


def _projection(dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BINS, dims))


def curve_keys(ids: np.ndarray, border: np.ndarray, projection: np.ndarray, bits: int, rows: int = 1024) -> np.ndarray:
    """Hilbert key of each document, given flat ids and their borders.

    Hashed token counts, damped by the root and brought to length 1, are projected and put on a grid of ``2**bits``
    cells an axis. A document without ids has key 0. ``rows`` documents are worked on at a time.
    """
    out = np.zeros(len(border) - 1, np.int64)
    for lo in range(0, len(out), rows):
        hi = min(len(out), lo + rows)
        n = np.diff(border[lo:hi + 1])
        bins = (ids[border[lo]:border[hi]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(55)).astype(np.int64)
        v = np.sqrt(np.bincount(np.repeat(np.arange(hi - lo) * BINS, n) + bins, minlength=(hi - lo) * BINS).reshape(hi - lo, BINS))
        y = (v @ projection) / np.sqrt(np.maximum(n, 1))[:, None]  # the counts sum to n, so the root of n is v's length
        cells = np.clip((np.tanh(y) + 1) * (1 << bits - 1), 0, (1 << bits) - 1)
        out[lo:hi] = np.where(n > 0, hilbert_keys(cells, bits), 0)
    return out


def pack_along_curve(
    episodes: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, dims: int = 3, bits: int = 12, seed: int = 7,
) -> DataFrame:
    """Pack instructions (episode_index, instruction) into sequences of at most ``length`` ids.

    Each instruction's ids, closed by ``end_id``, get a key: hashed token counts projected to ``dims`` numbers, placed on
    a Hilbert curve. Rows are range-sorted by the key, and the ids along the curve are cut every ``length`` ids, so only
    the last sequence has padding. Returns one row per piece: episode_index, start (ids of the episode before it),
    length, episode_tokens, curve_key, sequence_index, offset (in the sequence), input_ids (binary, little-endian
    unsigned 32-bit).

    Ids are encoded once and stored in the shared folder; the sort and the running offset handle three numbers a row.
    Only the join of the offsets moves the ids again. Null or empty text: the end id alone. Repeated rows are packed as
    often as they occur; equal keys follow episode_index, then the stored row number. No rows: no pieces. Further
    columns are ignored.
    """
    encode_schema = pa.schema([("episode_index", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    piece_schema = pa.schema([
        ("episode_index", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("episode_tokens", pa.int64()),
        ("curve_key", pa.int64()), ("sequence_index", pa.int64()), ("offset", pa.int64()), ("input_ids", pa.binary())])

    def encode(tables):
        enc, projection = encoder(tokenizer, **ENCODER), _projection(dims, seed)

        def rows(t):
            flat, border = enc.column(t.column(1))
            keys = curve_keys(flat, border, projection, bits).tolist()
            for k, episode in enumerate(t.column(0).to_pylist()):
                ids = flat[border[k]:border[k + 1]]
                yield (episode, keys[k], len(ids) + 1, ids.tobytes()), ids.nbytes

        for t in tables:
            yield from batches((row for part in slices(t, 1, ENCODER["segment"]) for row in rows(part)), encode_schema)

    def cut(tables):
        dtype, end = encoder(tokenizer, **ENCODER).dtype, np.array([end_id], "<u4").tobytes()

        def rows(t):
            for episode, key, n, ids, at in zip(*[c.to_pylist() for c in t.columns]):
                ids, done = wide(ids, dtype) + end, 0
                while done < n:
                    take = min(n - done, length - (at + done) % length)
                    yield (episode, done, take, n, key, (at + done) // length, (at + done) % length, ids[4 * done:4 * (done + take)]), 4 * take
                    done += take

        for t in tables:
            yield from batches(rows(t), piece_schema)

    rows = text_rows(episodes, ("episode_index", "long", "episode_index"), ("instruction", "string", "instruction"))
    encoded = rows.mapInArrow(encode, "episode_index long, key long, n long, ids binary")
    encoded = stored(encoded.withColumn("row_no", F.monotonically_increasing_id()), "pack-ids", "zstd")
    order = ["key", "episode_index", "row_no"]
    # the range partitions are written, so that both passes over them see the same bounds
    ranged = stored(encoded.select(*order, "n").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "pack-order")
    whole = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = whole.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))  # one row a partition
    along = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("within", F.coalesce(F.sum("n").over(along), F.lit(0))).join(bases, "part")
    placed = placed.select("row_no", (F.col("base") + F.col("within")).alias("at"))
    return (
        encoded.join(placed.hint("shuffle_hash"), "row_no").select("episode_index", "key", "n", "ids", "at")
        .mapInArrow(cut, "episode_index long, start long, length long, episode_tokens long, curve_key long, sequence_index long, "
                         "offset long, input_ids binary")
    )
