"""Periodic runs of words in instructions, found by internal pattern matching."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gaitworks.llm.common import text_rows


class SuffixOrder:
    """Suffix array of many word sequences laid end to end, with the classes of all prefixes of dyadic length.

    ``level[k][i]`` is the first place in suffix order whose suffix begins with the same 2**k words as suffix i; suffixes
    of different documents, and ends of documents, never agree. Levels stop where every class holds one suffix.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = len(words)
        self.n = n
        ends = np.searchsorted(doc, doc, "right")  # first place after the document of each word
        key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(key, kind="stable")
        rank = self._classes(key[self.order])
        first = np.empty(n, np.int64)
        first[self.order] = rank
        self.level = [first]
        width = 1
        while True:
            rank = self.level[-1]
            count = np.bincount(rank, minlength=n + 1)
            open_ = np.flatnonzero(count[rank[self.order]] > 1)  # places in suffix order whose class is shared
            if not len(open_):
                break
            at = self.order[open_]
            ahead = at + width
            # the rank of the suffix ``width`` words on; behind the end of the document, less than all and no two alike
            nxt = np.where(ahead < ends[at], rank[np.minimum(ahead, n - 1)] + n, n - 1 - at)
            group = rank[at]
            by = np.lexsort((nxt, group))
            at, group, nxt = at[by], group[by], nxt[by]
            self.order[open_] = at
            new = np.ones(len(at), bool)
            new[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
            fine = rank.copy()
            fine[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            self.level.append(fine)
            width *= 2

    @staticmethod
    def _classes(ordered: np.ndarray) -> np.ndarray:
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))

    def class_end(self, k: int) -> np.ndarray:
        """For each place that begins a class of level k, the place after its last suffix."""
        return np.arange(self.n + 1) + np.bincount(self.level[k], minlength=self.n + 1)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes i < j have in common at their beginning."""
        i, j = i.copy(), j.copy()
        start = j.copy()
        for k in range(len(self.level) - 1, -1, -1):
            lv = self.level[k]
            same = (j < self.n) & (lv[np.minimum(i, self.n - 1)] == lv[np.minimum(j, self.n - 1)])
            i, j = i + (same << k), j + (same << k)
        return j - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before the places i < j, read backwards."""
        i, j = i.copy(), j.copy()
        start = j.copy()
        for k in range(len(self.level) - 1, -1, -1):
            lv, w = self.level[k], 1 << k
            same = (i >= w) & (lv[np.maximum(i - w, 0)] == lv[np.maximum(j - w, 0)])
            i, j = i - (same << k), j - (same << k)
        return start - j


class WaveletTree:
    """Bits of a sequence of numbers from the highest down, each level stably parted by its bit, with counts of zeros."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros, self.parted = [], []
        v = values
        for b in range(self.bits - 1, -1, -1):
            low = (v >> b & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]))
            self.parted.append(int(self.zeros[-1][-1]))
            v = np.concatenate([v[low], v[~low]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of at least x among places lo to hi - 1; -1 where there is none."""
        below = np.zeros(len(lo), np.int64)
        a, b = lo, hi
        for d in range(self.bits):
            bit = x >> (self.bits - 1 - d) & 1
            za, zb = self.zeros[d][a], self.zeros[d][b]
            below = below + np.where(bit == 1, zb - za, 0)
            a = np.where(bit == 1, self.parted[d] + a - za, za)
            b = np.where(bit == 1, self.parted[d] + b - zb, zb)
        none = (below >= hi - lo) | (x >> self.bits > 0)
        rank, a, b = np.where(none, 0, below), lo, hi
        value = np.zeros(len(lo), np.int64)
        for d in range(self.bits):
            za, zb = self.zeros[d][a], self.zeros[d][b]
            one = rank >= zb - za
            rank = np.where(one, rank - (zb - za), rank)
            a = np.where(one, self.parted[d] + a - za, za)
            b = np.where(one, self.parted[d] + b - zb, zb)
            value = value * 2 + one
        return np.where(none, -1, value)


def runs(words: np.ndarray, doc: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the maximal runs of numbered words, in order; places are counted through all documents.

    A run of period q in L .. 2L - 1 (L a power of two; periods below four go with L = 2) that is four periods long holds
    a block of L words at a multiple of L which comes again q words later. So each block asks for its occurrences in the
    2L places after it: it is an interval of the suffix array, and a wavelet tree over that array gives the next
    occurrence. Occurrences no further apart than L / 2 are a progression, as far as the text keeps their distance p as
    period. In the progression that holds the block itself p is the candidate; of any other it is the distance between
    the ends of the two stretches of period p. An occurrence by itself is a candidate at its distance. Candidates are
    extended both ways by comparing classes of dyadic length; of the periods of one stretch the smallest stays.
    """
    found = []
    if len(words) >= least:
        sa = SuffixOrder(words, doc)
        tree = None
        for k in range(1, len(sa.level)):
            size = 1 << k
            first = np.searchsorted(doc, doc)  # first place of each document
            at = np.flatnonzero(((np.arange(sa.n) - first) & (size - 1)) == 0)
            lv, stop = sa.level[k], sa.class_end(k)
            at = at[stop[lv[at]] - lv[at] > 1]  # blocks that occur elsewhere
            if not len(at):
                continue
            tree = tree or WaveletTree(sa.order)
            lo, hi, limit = lv[at], stop[lv[at]], at + 2 * size
            near = tree.successor(lo, hi, at + 1)
            while True:
                live = (near >= 0) & (near < limit)
                at, lo, hi, limit, near = (v[live] for v in (at, lo, hi, limit, near))
                if not len(at):
                    break
                then = tree.successor(lo, hi, near + 1)
                own = near - at <= size // 2
                step = np.where(own, near - at, np.where(then >= 0, then - near, size))
                row = step <= size // 2  # a progression
                p = np.where(row, step, 1)
                start = np.where(own, at, near)
                end = np.where(row, start + p + sa.ahead(start, np.minimum(start + p, sa.n)), 0)
                other = row & ~own
                mine = at[other] + p[other] + sa.ahead(at[other], at[other] + p[other])
                q = near - at
                q[other] = end[other] - mine
                found.append((at[q > 0], q[q > 0]))
                last = start + (end - size - start) // p * p
                near = np.where(row, tree.successor(lo, hi, np.where(row, last, 0) + 1), then)
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    at, q = (np.concatenate(c) for c in zip(*found))
    at, q = np.unique(np.stack([at, q]), axis=1)
    inside = at + q < sa.n
    at, q = at[inside], q[inside]
    start, end = at - sa.behind(at, at + q), at + q + sa.ahead(at, at + q)
    ok = end - start >= np.maximum(least, times * q)
    start, end, q = start[ok], end[ok], q[ok]
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    new = np.ones(len(q), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    by = np.lexsort((q, start))
    return start[by], end[by], q[by]


def periodic_runs(episodes: DataFrame, least: int = 6, times: int = 4, batch_bytes: int = 2 << 20) -> DataFrame:
    """Periodic runs in the words of whole instructions of ``episodes`` (episode_index, instruction).

    Words are separated by white space. A run is a stretch of words with smallest period q, at least ``least`` words and
    ``times`` periods long (``times`` of four or more), that no neighbouring word extends. Words of a run after its first
    q are dropped from the collapsed instruction.

    Returns one row per episode: episode_index, n_words, n_runs; start, length, period and exponent_milli (length in
    thousandths of the period, rounded down) of the longest run, the first of equal ones, null without runs; runs_sha256
    (of ``start,length,period`` lines of all runs), collapsed_sha256 (of the kept words joined by spaces).

    Episodes are taken in batches of ``batch_bytes`` (a longer instruction is one of its own), searched by ``runs``;
    nothing is shuffled. Time is n log n in the words of a batch, whatever repeats in them.

    Null and empty instructions have no words and no runs. Repeated rows and null indexes are rows of their own. No rows:
    no rows. Further columns are ignored.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("episode_index", "n_words", "n_runs", "start", "length", "period", "exponent_milli")]
                       + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
    if times < 4 or least < 6:
        raise ValueError("runs of fewer than four periods or six words are not found by this method")
    none = sha256(b"").hexdigest()

    def search(indexes, texts):
        words = [t.split() for t in texts]
        n = np.array([*map(len, words)], np.int64)
        flat = [w for d in words for w in d]
        ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        base = np.cumsum(n) - n
        start, end, q = runs(ids, np.repeat(np.arange(len(n)), n), least, times)
        cut = np.searchsorted(start, np.concatenate([base, [len(ids)]]))
        out = []
        for k, episode in enumerate(indexes):
            lo, hi = int(cut[k]), int(cut[k + 1])
            if lo == hi:
                out.append((episode, int(n[k]), 0, None, None, None, None, none, sha256(b" ".join(words[k])).hexdigest()))
                continue
            s, e, p = start[lo:hi] - base[k], end[lo:hi] - base[k], q[lo:hi]
            best = np.lexsort((p, s, s - e))[0]
            # words after the first period of any run
            edge = np.zeros(n[k] + 1, np.int64)
            np.add.at(edge, s + p, 1)
            np.add.at(edge, e, -1)
            kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
            told = "".join(f"{a},{b - a},{c}\n" for a, b, c in zip(s.tolist(), e.tolist(), p.tolist()))
            length, period = int(e[best] - s[best]), int(p[best])
            out.append((episode, int(n[k]), hi - lo, int(s[best]), length, period, 1000 * length // period,
                        sha256(told.encode()).hexdigest(), sha256(b" ".join([words[k][i] for i in kept])).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def scan(tables):
        indexes, texts, held = [], [], 0
        for t in tables:
            size = pc.fill_null(pc.binary_length(t.column(1)), 0).to_pylist()
            for k, (episode, b) in enumerate(zip(t.column(0).to_pylist(), size)):
                indexes.append(episode)
                texts.append(t.column(1)[k].as_buffer().to_pybytes() if b else b"")
                held += b + 64
                if held >= batch_bytes:
                    yield search(indexes, texts)
                    indexes, texts, held = [], [], 0
        if indexes:
            yield search(indexes, texts)

    texts = text_rows(episodes, ("episode_index", "long", "episode_index"), ("instruction", "string", "instruction"))
    return texts.mapInArrow(scan, ", ".join(f"`{f.name}` {'string' if f.type == pa.string() else 'long'}" for f in schema))
