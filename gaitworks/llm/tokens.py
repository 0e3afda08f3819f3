"""Token ids of texts by the tokenizers library, for use inside Spark tasks."""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# What a byte of UTF-8 says about its character: white space; ASCII letter; other ASCII; certainly no white space
_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)
_SIGN = (_BYTES < 128) & ~_LETTER & ~_SPACE
# lead bytes of characters some of which are white space: U+0085, U+00A0, U+1680, U+2000 and on, U+3000
_INK = (_LETTER | _SIGN | (_BYTES >= 0xC3)) & ~np.isin(_BYTES, [0xE1, 0xE2, 0xE3])
_ONE_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where, beside the ends, UTF-8 text may be cut without changing what a byte-level pre-tokenizer makes of it.

    Before a white space that a character follows which is none: the last of a run of white space is never joined to
    those before it. And between a letter (ASCII or U+00C0 to U+00FF) and an ASCII character that is neither letter nor
    white space. Where the bytes leave it open, there is no cut.
    """
    if len(raw) < 2:
        return np.empty(0, np.int64)
    at = np.zeros(len(raw) - 1, bool)  # at[i]: a cut between bytes i and i + 1
    at[:-1] = _SPACE[raw[1:-1]] & _INK[raw[2:]]
    latin = np.zeros(len(raw) - 1, bool)
    latin[1:] = (raw[:-2] == 0xC3) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7)
    at |= (_LETTER[raw[:-1]] | latin) & _SIGN[raw[1:]]
    return np.flatnonzero(at) + 1


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Known(dict):
    """Ids of each piece met. Beyond ``limit`` pieces the older half goes."""

    def __init__(self, tokenizer, code: str, limit: int):
        super().__init__()
        self.encode, self.model, self.code, self.limit, self.letters = tokenizer.encode, tokenizer.model, code, limit, _byte_letters()

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.limit:
            for old in list(islice(self, self.limit // 2)):
                del self[old]
        if _ONE_WORD.fullmatch(piece):  # one word to the pre-tokenizer: straight to the merges
            ids = [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]
        else:
            ids = self.encode(piece.decode("utf-8"), add_special_tokens=False).ids
        out = self[piece] = array(self.code, ids).tobytes()
        return out


class Encoder:
    """Ids of whole texts, in the narrowest of 16 and 32 bits that holds the vocabulary.

    A byte-level tokenizer with its standard pre-tokenizer looks at nothing before a split, so a text's ids are those of
    its pieces between ``cuts`` in order. Each distinct piece of a segment of ``segment`` bytes is looked up once; new ones
    are encoded by the library and kept, up to ``limit``. Any other tokenizer gets each text whole. Strings of special
    tokens are ordinary text.
    """

    def __init__(self, path: str, limit: int = 800_000, segment: int = 8 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.segment = Tokenizer.from_file(path), segment
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and spec.get("post_processor") is None and (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._known = _Known(self.tokenizer, self._code, limit)

    def _pieces(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a segment, and how many end before each of ``ends`` (piece borders)."""
        border = np.zeros(len(raw) + 1, bool)
        border[cuts(raw)] = True
        border[ends[_SPACE[raw[ends - 1]] & (ends > 0)] - 1] = False  # white space at a row's end has no word after it
        border[0] = border[ends] = True
        bounds = np.flatnonzero(border).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        _, at, data = pieces.dictionary.buffers()
        at, data = np.frombuffer(at, np.int32)[:len(pieces.dictionary) + 1].tolist(), data.to_pybytes()
        ids = [self._known[data[a:b]] for a, b in zip(at, at[1:])]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat, first = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(size) - size
        which = pieces.indices.to_numpy()
        n = size[which]
        done = np.cumsum(n)
        out = flat[np.repeat(first[which] - (done - n), n) + np.arange(done[-1])]
        return out, np.concatenate([[0], done])[np.searchsorted(bounds, ends)]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column of strings, and the border of each row's ids in them. Null is the empty text."""
        if not self.by_piece:
            each = [array(self._code, self.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(x.tobytes() for x in each), self.dtype), np.cumsum([0, *map(len, each)])
        texts = texts.cast(pa.large_string()).fill_null("")
        _, at, data = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.empty(0, np.uint8)
        out, borders, lo, made, row = [], [np.zeros(1, np.int64)], int(at[0]), 0, 1
        while lo < at[-1]:
            width = self.segment
            while True:  # a segment ends at a row's end or, in a long row, at a cut
                hi = min(lo + width, int(at[-1]))
                stop = int(np.searchsorted(at, hi, "right"))
                end = int(at[stop - 1])
                if end <= lo:
                    inside = cuts(raw[lo:min(hi + 4, int(at[stop]))])
                    inside = inside[inside <= hi - lo]
                    end = lo + int(inside[-1]) if len(inside) else int(at[stop]) if hi >= at[stop] else lo
                if end > lo:
                    break
                width *= 2
            rows = at[row:stop] - lo if stop > row else np.empty(0, np.int64)
            ids, border = self._pieces(raw[lo:end], np.concatenate([rows, [end - lo]]))
            borders.append(made + border[:len(rows)])
            out.append(ids)
            made, lo, row = made + len(ids), end, max(row, stop)
        borders.append(np.full(len(at) - sum(map(len, borders)), made))
        return np.concatenate(out) if out else np.empty(0, self.dtype), np.concatenate(borders)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.column(pa.array([text], pa.string()))[0]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, **sizes: int) -> Encoder:
    """One encoder per Python worker, vocabulary file and sizes."""
    key = (path, *sorted(sizes.items()))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, **sizes)
    return _ENCODERS[key]


def wide(ids: bytes, dtype: np.dtype) -> bytes:
    """Stored ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, dtype).astype("<u4").tobytes()


def slices(t: pa.RecordBatch, column: int, most: int):
    """``t`` in runs of rows with at most ``most`` bytes of text in ``column``; a longer text is a run of its own."""
    done = np.cumsum(pc.fill_null(pc.binary_length(t.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < t.num_rows:
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + most, "right")))
        yield t.slice(lo, hi - lo)
        lo = hi


def batches(rows, schema: pa.Schema, most: int = 16 << 20):
    """Record batches of (row tuple, bytes) pairs, each of about ``most`` bytes at the most."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
