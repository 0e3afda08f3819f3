"""Tokens of two tokenizers aligned byte by byte, and how often their ids end together in the corpus."""

from __future__ import annotations

import os
from array import array
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import stored, text_rows
from gaitworks.llm.tokens import _byte_letters, encoder

LANE = 512  # tokens of A that one lane of the merge walks


class PieceEncoder:
    """Ids by a sentencepiece model, which puts a space before each text, and the bytes of its pieces.

    Where no piece has a space after another character and texts are not normalised, a text's ids are those of its parts
    that begin with a run of spaces: no merge reaches over the border. Each distinct part is then encoded once and kept,
    up to ``limit`` parts; otherwise texts are encoded whole.
    """

    def __init__(self, path: str, limit: int = 800_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        plain = "ﬁ  ① é éＡ a 　"
        same = b"".join(self.pieces[i] for i in self.model.encode(plain)) == b" " + plain.encode()
        self.by_part = same and not any("▁" in n.lstrip("▁") for n in names)
        # a last single space: the model gives an empty text no tokens, not even the space it adds
        self.limit, self.lone = limit, array("I", [self.model.piece_to_id("▁")]).tobytes()
        self.known: dict[bytes, bytes] = {}

    def _ids(self, part: bytes) -> bytes:
        got = self.known.get(part)
        if got is None:
            if len(self.known) >= self.limit:
                for old in list(islice(self.known, self.limit // 2)):
                    del self.known[old]
            got = self.known[part] = self.lone if part == b" " else array("I", self.model.encode(part[1:].decode())).tobytes()
        return got

    def column(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of space + text, for texts given with that space, and the border of each text's ids."""
        if not self.by_part:
            each = [array("I", self.model.encode(t[1:].decode())).tobytes() for t in texts]
            return np.frombuffer(b"".join(each), np.uint32), np.cumsum([0, *[len(x) // 4 for x in each]])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([0, *map(len, texts)])
        border = np.zeros(len(raw) + 1, bool)
        space = raw == 32
        border[1:-1] = space[1:] & ~space[:-1]
        border[ends] = True
        bounds = np.flatnonzero(border).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        ids = [self._ids(p) for p in parts.dictionary.to_pylist()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
        which = parts.indices.to_numpy()
        n = size[which]
        done = np.cumsum(n)
        out = flat[np.repeat(first[which] - (done - n), n) + np.arange(done[-1])]
        return out, np.concatenate([[0], done])[np.searchsorted(bounds, ends)]


def byte_level_pieces(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    tokenizer = encoder(path).tokenizer
    back = {c: b for b, c in _byte_letters().items()}
    out = [b""] * tokenizer.get_vocab_size()
    for entry, i in tokenizer.get_vocab().items():
        out[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
    return out


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_doc: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) that end at the same byte, in order.

    ``a_end`` and ``b_end`` are the ends of all tokens of a batch, counted through; ``a_doc`` and ``b_doc`` border the
    documents' tokens. Documents are walked in lanes of ``LANE`` tokens of A, all at once: one vector of states holds a
    pointer into A and one into B for each lane. Each step compares the two ends of every lane, emits a link and a cut
    where they agree, and advances the pointer of the smaller end, or both. Lanes that have run out are compacted away.
    """
    counts = -(-np.diff(a_doc) // LANE)
    doc = np.repeat(np.arange(len(counts)), counts)
    lane = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    pa_ = a_doc[doc] + lane * LANE
    a_stop = np.minimum(pa_ + LANE, a_doc[doc + 1])
    # tokens of B that end behind the last end of the lane before belong to this lane
    before = np.where(lane > 0, a_end[np.maximum(pa_ - 1, 0)] if len(pa_) else 0, -1)
    pb = np.where(lane > 0, np.searchsorted(b_end, before, "right"), b_doc[doc])
    b_stop = b_doc[doc + 1]
    found_a, found_b = [], []
    while True:
        live = (pa_ < a_stop) & (pb < b_stop)
        if not live.all():  # compact
            pa_, pb, a_stop, b_stop = pa_[live], pb[live], a_stop[live], b_stop[live]
        if not len(pa_):
            break
        ea, eb = a_end[pa_], b_end[pb]
        same = ea == eb
        found_a.append(pa_[same])
        found_b.append(pb[same])
        pa_ = pa_ + (ea <= eb)
        pb = pb + (eb <= ea)
    at = np.concatenate(found_a) if found_a else np.empty(0, np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], (np.concatenate(found_b) if found_b else np.empty(0, np.int64))[order]


def group_text(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, names: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3`` of one document's ids; ``ca`` and ``cb`` are the last tokens of its groups."""
    words = np.empty(len(a) + len(b), np.int64)
    na, nb = np.diff(ca, prepend=-1), np.diff(cb, prepend=-1)
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[ca], mark_b[cb] = 1, 2
    words[np.arange(len(a)) + np.repeat(np.cumsum(nb) - nb, na)] = a * 3 + mark_a
    words[np.arange(len(b)) + np.repeat(np.cumsum(na), nb)] = b * 3 + mark_b
    return "".join(names[words].tolist())[:-1]


def align_tokens(episodes: DataFrame, byte_level: str, pieces: str, block_bytes: int = 2 << 20) -> DataFrame:
    """Align the tokens of two tokenizers over whole instructions of ``episodes`` (episode_index, instruction).

    A is the byte-level vocabulary file ``byte_level`` over space + instruction, B the sentencepiece model ``pieces``,
    which adds that space. Byte offsets where tokens of both end cut the tokens into groups; the two tokens that end at
    a cut are a link. The count of an (A id, B id) pair is the number of links of all episodes that hold it.

    Returns one row per episode: episode_index, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of
    their B id), count_sum (counts of all links), groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).

    Texts are read in blocks of ``block_bytes``; a block is merged in lockstep (``lockstep``). It leaves a row per
    episode with its links as numbers into the block's list of distinct pairs, and that list with counts. Lists are
    summed per pair and per B id, and each comes back to its block once, so that what is shuffled are the distinct pairs
    of blocks, not links; a pair that stands everywhere is one row a block. A block is bounded by ``block_bytes`` and its
    last text.

    Null and empty instructions, and those that a tokenizer does not give back byte by byte, have no tokens: zeros, and
    an empty string for the hash. Repeated rows and null indexes are rows of their own and count. No rows: no rows.
    Further columns are ignored.
    """
    bare = b" "
    row = pa.schema([("block", pa.int64()), ("episode_index", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()),
                     ("groups_sha256", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def merge(tables):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        enc, sp = encoder(byte_level), PieceEncoder(pieces)
        a_bytes, b_bytes = byte_level_pieces(byte_level), sp.pieces
        a_size, b_size = np.array([*map(len, a_bytes)]), np.array([*map(len, b_bytes)])
        names = np.array([f"{i}{c}" for i in range(max(len(a_bytes), len(b_bytes))) for c in ",|;"], object)
        part, no = TaskContext.get().partitionId(), 0

        def whole(indexes, texts):
            nonlocal no
            block, no = (part << 32) + no, no + 1
            spaced = [bare + t for t in texts]
            a_ids, a_doc = enc.column(pa.array(spaced, pa.binary()).cast(pa.string()))
            b_ids, b_doc = sp.column(spaced)
            size = np.array([*map(len, spaced)])
            a_sum, b_sum = np.concatenate([[0], np.cumsum(a_size[a_ids])]), np.concatenate([[0], np.cumsum(b_size[b_ids])])
            ok = (a_sum[a_doc[1:]] - a_sum[a_doc[:-1]] == size) & (b_sum[b_doc[1:]] - b_sum[b_doc[:-1]] == size)
            a_list, b_list = a_ids.tolist(), b_ids.tolist()
            back = lambda ids, table, lo, hi: b"".join([table[i] for i in ids[lo:hi]])
            raw = b"".join(spaced)
            if not (ok.all() and back(a_list, a_bytes, 0, None) == raw == back(b_list, b_bytes, 0, None)):
                for k in np.flatnonzero(ok).tolist():
                    ok[k] = back(a_list, a_bytes, a_doc[k], a_doc[k + 1]) == spaced[k] == back(b_list, b_bytes, b_doc[k], b_doc[k + 1])
            at = np.cumsum(size) - size  # ends counted through the block
            n_a, n_b = np.diff(a_doc), np.diff(b_doc)
            keep_a, keep_b = np.repeat(ok, n_a), np.repeat(ok, n_b)
            a_end = (a_sum[1:] - np.repeat(a_sum[a_doc[:-1]] - at, n_a))[keep_a]
            b_end = (b_sum[1:] - np.repeat(b_sum[b_doc[:-1]] - at, n_b))[keep_b]
            a_ids, b_ids = a_ids[keep_a].astype(np.int64), b_ids[keep_b].astype(np.int64)
            n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
            a_doc, b_doc = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
            ca, cb = lockstep(a_end, b_end, a_doc, b_doc)
            pairs, which, n = np.unique(a_ids[ca] << 32 | b_ids[cb], return_inverse=True, return_counts=True)
            which = which.astype("<u4")
            cuts = np.searchsorted(ca, a_doc)
            out, held = [], 0
            for k, episode in enumerate(indexes):
                lo, hi = cuts[k], cuts[k + 1]
                text = ""
                if ok[k]:
                    a, b = a_ids[a_doc[k]:a_doc[k + 1]], b_ids[b_doc[k]:b_doc[k + 1]]
                    text = sha256(group_text(a, b, ca[lo:hi] - a_doc[k], cb[lo:hi] - b_doc[k], names).encode()).hexdigest()
                out.append((block, episode, int(n_a[k]), int(n_b[k]), int(hi - lo), text, which[lo:hi].tobytes(), None, None))
                held += hi - lo
                if held > 2 << 20:
                    yield rows(out)
                    out, held = [], 0
            out.append((block, None, None, None, None, None, None, pairs, n))
            yield rows(out)

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), row)], schema=row)

        def alone(indexes):
            block = (part << 32) + (1 << 31)
            return rows([(block, e, 0, 0, 0, "", b"", None, None) for e in indexes])

        indexes, texts, held = [], [], 0
        for t in tables:
            filled = pc.fill_null(pc.binary_length(t.column(1)), 0).to_numpy(zero_copy_only=False) > 0
            given = t.column(0).to_pylist()
            if not filled.all():
                yield alone([e for e, f in zip(given, filled) if not f])
            for k in np.flatnonzero(filled).tolist():
                texts.append(t.column(1)[k].as_buffer().to_pybytes())
                indexes.append(given[k])
                held += len(texts[-1])
                if held >= block_bytes:
                    yield from whole(indexes, texts)
                    indexes, texts, held = [], [], 0
        if texts:
            yield from whole(indexes, texts)

    texts = text_rows(episodes, ("episode_index", "long", "episode_index"), ("instruction", "string", "instruction"))
    spec = "block long, episode_index long, n_a long, n_b long, n_links long, groups_sha256 string, links binary, pairs array<long>, counts array<long>"
    done = stored(texts.mapInArrow(merge, spec), "token-links", "zstd")

    listed = done.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    listed = listed.select("block", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = stored(listed.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pair-counts")
    best = totals.groupBy("b").agg(F.max("count").alias("most"))
    totals = totals.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = listed.select(F.col("block").alias("of_block"), "pair").join(totals, "pair")

    def settle(key, left, right):
        """Counts of the block's pairs, in their order in the block's list, summed over each episode's links."""
        order = np.argsort(right.column("pair").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order]
        which = [np.frombuffer(x.as_buffer(), "<u4") for x in left.column("links")]
        return pa.table({
            **{c: left.column(c) for c in ("episode_index", "n_a", "n_b", "n_links")},
            "n_best": pa.array([int(best[w].sum()) for w in which], pa.int64()),
            "count_sum": pa.array([int(count[w].sum()) for w in which], pa.int64()), "groups_sha256": left.column("groups_sha256")})

    rows = done.where("pairs is null")
    spec = "episode_index long, n_a long, n_b long, n_links long, n_best long, count_sum long, groups_sha256 string"
    linked = rows.where("n_links > 0").groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(settle, spec)
    empty = rows.where("n_links = 0").selectExpr("episode_index", "n_a", "n_b", "n_links", "0L as n_best", "0L as count_sum", "groups_sha256")
    return linked.unionByName(empty).select("episode_index", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
