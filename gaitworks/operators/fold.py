"""Block arithmetic of the sequential shard fold (numpy inside Spark tasks)."""

from __future__ import annotations

import numpy as np
import pandas as pd


def _next_starts(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For a shard beginning empty at i: where the next one begins (n when it stays open)."""
    n = len(lengths)
    cum = np.concatenate([[0], np.cumsum(lengths)])
    j = np.searchsorted(cum[1:], cum[:-1] + size, side="left")  # episode that reaches size
    start = np.arange(n)
    reached = j < n
    over = reached & (j > start) & (cum[np.minimum(j, n - 1) + 1] - cum[:-1] > 2 * size)
    nxt = np.where(over, j, j + 1)
    return np.where(reached, nxt, n), reached


def _suffix(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards closed and fill left at the block end, for an empty shard beginning at each position."""
    n = len(lengths)
    nxt, reached = _next_starts(lengths, size)
    left = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]])
    closed, out = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        if reached[i]:
            closed[i], out[i] = closed[nxt[i]] + 1, out[nxt[i]]
        else:
            out[i] = left[i]
    return closed, out


def tabulate(lengths: np.ndarray, size: int) -> pd.DataFrame:
    """The block as a step function: fill-in range -> shards closed, fill-out (relative to fill-in when none closes)."""
    lengths = lengths.astype(np.int64)
    closed, out = _suffix(lengths, size)
    cum = np.cumsum(lengths)
    rows = []
    open_until = size - int(cum[-1]) - 1  # fills up to here close nothing
    if open_until >= 0:
        rows.append((0, open_until, 0, -1))
    before = 0
    for j in range(len(lengths)):
        lo, hi = max(size - int(cum[j]), 0), size - before - 1
        before = int(cum[j])
        if lo > hi:
            continue
        limit = 2 * size - int(cum[j])  # above it the shard closes before episode j
        a, b = (lo, min(hi, limit)), (max(lo, limit + 1), hi)
        if j == 0 and b[0] <= 0 <= b[1]:
            a, b = (0, 0), (1, hi)  # an empty shard takes any first episode
        for (x, y), start in ((a, j + 1), (b, j)):
            if x <= y:
                rows.append((x, y, int(closed[start]) + 1, int(out[start])))
        if before >= size:
            break
    t = pd.DataFrame(rows, columns=["f_lo", "f_hi", "closed", "f_out"])
    # -1 marks "nothing closed": the fill grows by the block's own length
    t.loc[t["f_out"] == -1, "f_out"] = -1 - int(cum[-1])
    return t


def compose(tables: pd.DataFrame) -> pd.DataFrame:
    """The step function of several blocks run one after the other (columns _b and those of ``tabulate``).

    A piece that closed something goes on from one fill, so it stays one piece; a piece that closed nothing is cut by
    the next block's pieces. Neighbours that end alike are joined, so there are at most ``size`` pieces.
    """
    blocks = [t[["f_lo", "f_hi", "closed", "f_out"]].to_numpy(np.int64) for _, t in tables.sort_values(["_b", "f_lo"]).groupby("_b", sort=True)]
    pieces = blocks[0].tolist()
    for block in blocks[1:]:
        new = []
        for lo, hi, closed, out in pieces:
            if out >= 0:
                (_, _, more, end), = block[(block[:, 0] <= out) & (out <= block[:, 1])]
                new.append([lo, hi, closed + more, end if end >= 0 else out - 1 - end])
                continue
            grown = -1 - out
            for f_lo, f_hi, more, end in block:
                x, y = max(lo, f_lo - grown), min(hi, f_hi - grown)
                if x <= y:
                    new.append([x, y, more, end if end >= 0 else end - grown])
        pieces = []
        for piece in map(lambda q: [int(v) for v in q], new):
            if pieces and pieces[-1][2:] == piece[2:] and pieces[-1][1] + 1 == piece[0]:
                pieces[-1][1] = piece[1]
            else:
                pieces.append(piece)
    return pd.DataFrame(pieces, columns=["f_lo", "f_hi", "closed", "f_out"])


def chain(tables: pd.DataFrame, fill: int = 0, base: int = 0) -> pd.DataFrame:
    """Walk blocks in order from a fill and a shard number: those at each block's start."""
    rows = []
    for b, t in tables.sort_values(["_b", "f_lo"]).groupby("_b", sort=True):
        rows.append((b, fill, base))
        hit = t[(t["f_lo"] <= fill) & (fill <= t["f_hi"])].iloc[0]
        if hit["f_out"] < 0:
            fill += -1 - int(hit["f_out"])
        else:
            base, fill = base + int(hit["closed"]), int(hit["f_out"])
    return pd.DataFrame(rows, columns=["_b", "f_in", "base"])


def number(lengths: np.ndarray, size: int, fill: int, base: int) -> np.ndarray:
    """Shard number of every episode of a block, given the fill and number it starts with."""
    lengths = lengths.astype(np.int64)
    n = len(lengths)
    ids = np.empty(n, np.int64)
    cum = np.cumsum(lengths)
    nxt, _ = _next_starts(lengths, size)
    j = int(np.searchsorted(cum, size - fill, side="left"))
    if j >= n:
        ids[:] = base
        return ids
    content = fill > 0 or j > 0
    start = j if content and fill + int(cum[j]) > 2 * size else j + 1
    ids[:start] = base
    while start < n:
        base += 1
        end = int(nxt[start])
        ids[start:end] = base
        start = end
    return ids
