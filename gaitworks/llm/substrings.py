"""Repeated passages: MinHash banding of content-chosen paragraphs, confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import components, stored, text_rows
from gaitworks.llm.neardup import _MUL, _WORDS, _links
from gaitworks.llm.tokens import slices

WIDTH = 5  # words of a shingle
REACH = 7  # shingles on either side that a cut must undercut
BITS = 42  # of a band that are kept; chance meetings cost a comparison only
MEMBERS = 4096  # paragraphs of a group that are compared in one task
_FACTORS = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def choose_bands(similarity: float, miss: float = 0.05, rows: int = 2) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` coordinates that miss a pair at ``similarity`` less often than ``miss``."""
    bands = 1
    while (1 - similarity**rows) ** bands > miss:
        bands += 1
    return bands, rows


def packed_bands(bands: list[np.ndarray]) -> list[np.ndarray]:
    """The upper ``BITS`` of each band, one after the other in as few 64-bit words as hold them."""
    words = [np.zeros(len(bands[0]), np.uint64) for _ in range(-(-BITS * len(bands) // 64))]
    for b, h in enumerate(bands):
        k, off = divmod(BITS * b, 64)
        h = h >> np.uint64(64 - BITS)
        words[k] |= h << np.uint64(off)
        if off + BITS > 64:
            words[k + 1] |= h >> np.uint64(64 - off)
    return words


def band_of(words: list[str], b: int) -> Column:
    """Band ``b`` of the columns ``words`` that hold ``packed_bands``."""
    k, off = divmod(BITS * b, 64)
    h = F.shiftrightunsigned(words[k], off)
    if off + BITS > 64:
        h = h.bitwiseOR(F.shiftleft(words[k + 1], 64 - off))
    return h.bitwiseAND(F.lit((1 << BITS) - 1))


def _mixed(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> np.uint64(32))
    v *= _MUL
    return v ^ (v >> np.uint64(29))


class Paragraphs:
    """Content-chosen paragraphs of a batch of texts.

    Line breaks are white space like any other. A paragraph begins at a word whose 5-word shingle hashes lower than those
    of the ``REACH`` words on either side, so that the same words are cut alike wherever they stand; the first begins with
    the text. They have about 15 words. Those of fewer than ``WIDTH`` words have no shingle and are left out.

    Arrays with an entry per paragraph: doc, number (in its text), start and end (code points), n (shingles); ``shingles``
    is the hash of each word's shingle, ``first`` and ``last`` border a paragraph's in it.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)  # a space ends each text
        lower = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
        white = _WHITE[raw]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(raw) and not white[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[::2], edge[1::2]
        text_end = np.cumsum([len(t) + 1 for t in texts])
        n_words = np.diff(np.searchsorted(starts, text_end), prepend=0)
        base = np.cumsum(n_words) - n_words
        doc_of = np.repeat(np.arange(len(texts)), n_words)
        self.shingles = v = self._hashes(lower, starts, ends)
        n = len(v)
        left = n_words[doc_of] - (np.arange(n) - base[doc_of])  # words to the end of the text
        at = np.arange(n) - base[doc_of]
        low_before, low_behind = np.full(n, ~np.uint64(0)), np.full(n, ~np.uint64(0))
        for k in range(1, REACH + 1):
            low_before[k:] = np.minimum(low_before[k:], v[:-k])
            low_behind[:-k] = np.minimum(low_behind[:-k], v[k:])
        cut = (at >= REACH) & (left >= REACH + WIDTH) & (v < low_before) & (v <= low_behind)
        cut[base[n_words > 0]] = True
        first = np.flatnonzero(cut)
        stop = np.append(first[1:], n)
        doc = doc_of[first]
        number = np.arange(len(first)) - np.searchsorted(doc, doc)
        ok = stop - first >= WIDTH
        self.first, stop, self.doc, self.number = first[ok], stop[ok], doc[ok], number[ok]
        self.last = stop - (WIDTH - 1)
        self.n = self.last - self.first
        point = np.cumsum((raw & 0xC0) != 0x80)
        begin = np.concatenate([[0], point[text_end - 1]])[self.doc]  # code points before the text
        self.start = point[starts[self.first]] - 1 - begin
        self.end = point[ends[stop - 1] - 1] - begin

    @staticmethod
    def _hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.uint64)
        bounds = np.append(np.stack([starts, ends], 1).ravel(), len(lower)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(lower))])
        coded = parts.take(pa.array(np.arange(0, len(bounds) - 1, 2))).dictionary_encode()
        words = coded.dictionary.to_pylist()
        h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))[coded.indices.to_numpy()]
        v = np.full(len(h), WIDTH, np.uint64)
        for i in range(WIDTH):
            v[:len(h) - i] = (v[:len(h) - i] ^ (v[:len(h) - i] >> np.uint64(31))) * _MUL + h[i:]
        return _mixed(v)

    def _fold(self, values: np.ndarray, by: np.ufunc) -> np.ndarray:
        if not len(self.first):
            return np.empty(0, np.uint64)
        between = np.stack([self.first, self.last], 1).ravel()
        return by.reduceat(np.append(values, values[:1]), between)[::2]

    def keys(self) -> np.ndarray:
        """A hash of each paragraph's shingles, in whatever order."""
        return self._fold(_mixed(self.shingles * np.uint64(0x9E3779B97F4A7C15)), np.add)

    def bands(self, bands: int, rows: int) -> list[np.ndarray]:
        out = []
        for b in range(bands):
            h = np.full(len(self.first), b, np.uint64)
            for r in range(rows):
                h = (h ^ (h >> np.uint64(29))) * _MUL + self._fold(self.shingles * _FACTORS[b * rows + r], np.minimum)
            out.append(h)
        return out

    def set_of(self, k: int) -> np.ndarray:
        return np.unique(self.shingles[self.first[k]:self.last[k]])


def _links_of_groups(percent: int):
    """Links inside many small groups of one frame (hub, row_no, sig, shingles)."""
    one_by_one = _links(percent, 0)

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["hub", "row_no"], kind="stable")
        no, border = rows["row_no"].to_numpy(np.int64), np.flatnonzero(np.diff(rows["hub"].to_numpy(), prepend=-1, append=-1))
        sets = [np.frombuffer(x, "<u8") for x in rows["shingles"]]
        a, b, more = [], [], []
        for lo, hi in zip(border.tolist(), border[1:].tolist()):
            if hi - lo > 8:
                more.append(one_by_one(rows.iloc[lo:hi].assign(side=0, first=False)))
                continue
            for i in range(lo, hi):
                for j in range(i + 1, hi):
                    x, y = sets[i], sets[j]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = np.sort(np.concatenate([x, y]))
                    both = int((both[1:] == both[:-1]).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        a.append(no[i])
                        b.append(no[j])
        return pd.concat([pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")}), *more])

    return link


def repeated_passages(episodes: DataFrame, percent: int = 80, batch_bytes: int = 2 << 20) -> DataFrame:
    """Paragraphs of instructions (episode_index, instruction) that occur again, in the same or another episode.

    ``Paragraphs`` cuts whole texts into paragraphs of about 15 words at places that the words themselves choose, whatever
    the line breaks, so that a passage inside different longer texts gives the same paragraphs. Two are linked when the
    Jaccard of their 5-word shingle sets is ``percent`` or more. Paragraphs of equal shingles, which is what a repeated
    passage leaves, are one class from the start, folded map-side, so copies are never compared. One of each class is
    posted under its bands of MinHash coordinates (``choose_bands``); classes that collide in a band meet in a group named
    by the smallest, and full sets confirm the links. Groups above ``MEMBERS`` are cut into blocks that are compared pair by pair, smaller ones go
    many to a frame; links
    that change no component are left out. Components of the links are the clusters: the first paragraph (by
    episode_index, then place) stays.

    Returns a row for each paragraph that shares its cluster: episode_index, paragraph (number in its text, from 0),
    start, end (code points, end exclusive), component_index and component_paragraph (the one that stays), kept. What is
    not kept is what a removal would cut. The ends of a passage, up to the first and from the last cut inside it, belong
    to paragraphs that go on beyond it and are not returned.

    Null text and texts of fewer than five words have no paragraphs; a null index sorts last. Repeated rows repeat their
    paragraphs. Very long texts are cut whole, a batch of their own. No rows: no rows. Further columns are ignored.
    """
    bands, width = choose_bands(percent / 100)
    names = [f"bits{k}" for k in range(-(-BITS * bands // 64))]
    schema = pa.schema([("episode_index", pa.int64()), ("paragraph", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                        ("key", pa.int64()), *[(b, pa.int64()) for b in names]])

    def batches(tables):
        """(other columns as lists, texts) of about ``batch_bytes``."""
        held, texts, size = [], [], 0
        for t in tables:
            long = pc.fill_null(pc.binary_length(t.column(1)), 0).to_pylist()
            others = list(zip(*[t.column(c).to_pylist() for c in range(t.num_columns) if c != 1]))
            for k, b in enumerate(long):
                if not b:
                    continue
                held.append(others[k])
                texts.append(t.column(1)[k].as_buffer().to_pybytes())
                size += b
                if size >= batch_bytes:
                    yield held, texts
                    held, texts, size = [], [], 0
        if texts:
            yield held, texts

    def sign(tables):
        for held, texts in batches(tables):
            p = Paragraphs(texts)
            index = pa.array([h[0] for h in held], pa.int64()).take(pa.array(p.doc))
            made = [p.number, p.start, p.end, p.keys().view(np.int64), *[w.view(np.int64) for w in packed_bands(p.bands(bands, width))]]
            if len(p.doc):
                yield pa.RecordBatch.from_arrays([index, *[pa.array(c, f.type) for c, f in zip(made, list(schema)[1:])]], schema=schema)

    texts = text_rows(episodes, ("episode_index", "long", "episode_index"), ("instruction", "string", "instruction"))
    spec = "episode_index long, paragraph int, start long, `end` long, key long, " + ", ".join(f"{b} long" for b in names)
    found = stored(texts.mapInArrow(sign, spec).withColumn("row_no", F.monotonically_increasing_id()), "passages", "zstd")

    # classes of equal shingles, told by 128 bits: the key and the first word of bands; their first row stands for them
    same = ["key", names[0]]
    classes = stored(found.groupBy(*same).agg(
        *[F.first(b).alias(b) for b in names[1:]], F.min("row_no").alias("rep"), F.count(F.lit(1)).alias("copies")), "passage-classes", "zstd")
    posted = classes.select(F.col("rep").alias("row_no"), F.explode(F.array(*[band_of(names, b) for b in range(bands)])).alias("post")).repartition("post")
    hubs = posted.groupBy("post").agg(F.min("row_no").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("post", "hub")
    members = stored(posted.join(hubs, "post").select("hub", "row_no").distinct(), "passage-members")
    blocks = members.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    members = members.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("row_no"), "blocks").cast("int"))

    candidates = stored(
        found.select("row_no", "episode_index", "paragraph", *same).join(members.select("row_no").distinct(), "row_no"), "passage-candidates")
    wanted = candidates.groupBy(F.col("episode_index").alias("e")).agg(F.collect_list(F.struct("row_no", "paragraph", "key")).alias("w"))
    set_schema = pa.schema([("row_no", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary())])

    zip_schema = pa.schema([("episode_index", pa.int64()), ("size", pa.int64()), ("zipped", pa.binary())])

    def zipped(tables):
        """Texts with words to look for, each compressed by itself: shuffled, they take less than whole."""
        codec = pa.Codec("zstd")
        for t in tables:
            for part in slices(t, 1, batch_bytes):
                rows = [(e, x.as_buffer()) for e, x in zip(part.column(0).to_pylist(), part.column(1)) if x.is_valid]
                rows = [(e, b.size, codec.compress(b, asbytes=True)) for e, b in rows if b.size]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), zip_schema)], schema=zip_schema)

    def unzipped(tables):
        codec = pa.Codec("zstd")
        for t in tables:
            for part in slices(t, 1, batch_bytes // 4):
                whole = [codec.decompress(z.as_buffer(), n, asbytes=True) for z, n in zip(part.column(1), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole, pa.binary())], names=["w", "text"])

    def full(tables):
        """Shingle sets of the wanted paragraphs; of texts with one index, those that have the paragraph where it was."""
        for held, texts in batches(unzipped(tables)):
            p = Paragraphs(texts)
            keys, at = p.keys().view(np.int64).tolist(), {pair: k for k, pair in enumerate(zip(p.doc.tolist(), p.number.tolist()))}
            out = [{"row_no": x["row_no"], "sig": b"", "shingles": p.set_of(k).astype("<u8").tobytes()} for d, h in enumerate(held) for x in h[0]
                   if (k := at.get((d, x["paragraph"]))) is not None and keys[k] == x["key"]]
            if out:
                yield pa.RecordBatch.from_pylist(out, set_schema)

    sets = texts.mapInArrow(zipped, "episode_index long, size long, zipped binary").join(wanted, F.col("episode_index").eqNullSafe(F.col("e")))
    sets = sets.select("w", "zipped", "size").mapInArrow(full, "row_no long, sig binary, shingles binary")
    sets = stored(sets, "passage-sets").dropDuplicates(["row_no"])
    # groups of one block go many to a frame; of others every pair of blocks, the smaller number on side 0
    frames = max(1, members.count() // 20_000)
    few = members.where("blocks = 1").select(F.pmod(F.xxhash64("hub"), F.lit(frames)).alias("frame"), "hub", "row_no").join(sets, "row_no")
    few = few.groupBy("frame").applyInPandas(_links_of_groups(percent), "a long, b long")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    tasks = members.where("blocks > 1").select("hub", "row_no", "block", other).select(
        "hub", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), "row_no",
        F.when(F.col("block") <= F.col("o"), 0).otherwise(1).alias("side"), F.lit(False).alias("first"))
    links = tasks.join(sets, "row_no").groupBy("hub", "a", "b").applyInPandas(_links(percent, 0), "a long, b long")
    joined = components(few.unionByName(links), "passage-components")
    # a class is in a cluster if it is linked, or if it has copies; the links know the first, and only the second are looked up
    linked = joined.join(candidates, joined["node"] == candidates["row_no"]).select(*same, "component")
    copied = classes.where("copies > 1").join(joined.select(F.col("node").alias("rep")), "rep", "left_anti")
    placed = linked.unionByName(copied.select(*same, F.col("rep").alias("component")))
    members = stored(found.select(*same, "episode_index", "paragraph", "start", "end", "row_no").join(placed, same).drop(*same), "passage-clusters")
    order = F.struct(F.col("episode_index").isNull().alias("x"), "episode_index", "paragraph", "row_no")
    first = members.groupBy("component").agg(F.min(order).alias("f"))
    return members.join(first, "component").select(
        "episode_index", "paragraph", "start", "end", F.col("f.episode_index").alias("component_index"),
        F.col("f.paragraph").alias("component_paragraph"), (F.col("row_no") == F.col("f.row_no")).alias("kept"))
