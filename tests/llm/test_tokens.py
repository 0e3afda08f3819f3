import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gaitworks.llm import packing, token_files
from gaitworks.llm.common import scratch
from gaitworks.llm.tokens import Encoder


@functools.cache
def tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def whole(vocabulary, text):
    return tokenizer(vocabulary).encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(vocabulary):
    rnd = random.Random(3)
    alphabet = ["a", "b", "é", "ß", "×", "1", "²", "'s", "'", " ", "  ", "\n", "\t", "\u3000", "\x85", "\x1c", ".", "!!", "東", "か", "\U0001f600", "<|endoftext|>", "don't", "Œ"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(4000)] + [None, "", " ", "a"]
    want = [whole(vocabulary, t) for t in texts]
    for segment in (1, 300, 1 << 22):
        enc = Encoder(vocabulary, limit=2000, segment=segment)
        ids, border = enc.column(pa.array(["skipped", *texts])[1:])
        assert [ids[a:b].tolist() for a, b in zip(border, border[1:])] == want
    long = " ".join(t or "" for t in texts)
    assert Encoder(vocabulary, segment=500)(long).tolist() == whole(vocabulary, long)
    assert len(Encoder(vocabulary).column(pa.array([], pa.string()))[0]) == 0


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    enc = Encoder(path)
    assert not enc.by_piece and enc("A tall  robot.").tolist() == whole(path, "A tall  robot.")


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        assert (token_files.from_planes(token_files.to_planes(ids, bits), n) == ids).all()


@pytest.mark.parametrize("planes,block", [("byte", 64), ("bit", 1000)])
def test_token_files_round_trip(spark, odd, vocabulary, planes, block):
    path = scratch(spark, "tf")
    index = token_files.write_token_files(odd, path, vocabulary, block=block, planes=planes)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    given = sorted(((r.episode_index, r.instruction) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (i, text) in zip(rows, given, strict=True):
        ids = whole(vocabulary, text) + [0]
        assert (r.episode_index, r.start, r.n_tokens) == (i, at, len(ids))
        assert np.frombuffer(r.input_ids, "<u4").tolist() == ids
        at += len(ids)
    assert index.agg({"n_ids": "sum"}).first()[0] == at


def test_token_files_of_nothing(spark, none, vocabulary):
    path = scratch(spark, "tf")
    token_files.write_token_files(none, path, vocabulary)
    assert token_files.read_token_files(spark, path).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_and_moves_one_step(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_packing_holds_every_id_once(spark, odd, vocabulary):
    rows = packing.pack_along_curve(odd, vocabulary, length=64).collect()
    ids = {}
    total = 0
    for r in odd.collect():
        ids.setdefault(r.episode_index, []).append(whole(vocabulary, r.instruction) + [1])
        total += len(ids[r.episode_index][-1])
    filled = {}
    found = {}
    for r in rows:
        piece = np.frombuffer(r.input_ids, "<u4").tolist()
        assert len(piece) == r.length and any(x[r.start:r.start + r.length] == piece and len(x) == r.episode_tokens for x in ids[r.episode_index])
        filled.setdefault(r.sequence_index, []).append((r.offset, r.length))
        found[r.episode_index] = found.get(r.episode_index, 0) + r.length
    assert found == {k: sum(map(len, v)) for k, v in ids.items()}
    assert len(filled) == -(-total // 64)
    for k, v in filled.items():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == 64 or k == max(filled)
    order = sorted(rows, key=lambda r: (r.sequence_index, r.offset))
    assert [r.curve_key for r in order] == sorted(r.curve_key for r in rows)


def test_neighbours_on_the_curve_are_alike(spark, vocabulary):
    a, b = "lift the blue block from the table " * 9, "rotate valve wheel clockwise until pressure falls " * 9
    df = spark.createDataFrame([(i, (a if i % 2 else b) + f" {i}") for i in range(40)], "episode_index long, instruction string")
    order = [r.episode_index % 2 for r in sorted(packing.pack_along_curve(df, vocabulary).collect(), key=lambda r: (r.sequence_index, r.offset)) if r.start == 0]
    assert sum(x != y for x, y in zip(order, order[1:])) <= 6


def test_packing_of_nothing(spark, none, vocabulary):
    assert packing.pack_along_curve(none, vocabulary).count() == 0


def test_crc_of_wide_ids():
    from gaitworks.llm.tokens import wide

    assert zlib.crc32(wide(np.array([1, 2], "<u2").tobytes(), np.dtype("<u2"))) == zlib.crc32(np.array([1, 2], "<u4").tobytes())


def test_workers_that_write_files_keep_fewer_pieces(vocabulary):
    from gaitworks.llm import token_files
    from gaitworks.llm.tokens import encoder

    small = encoder(vocabulary, **token_files.ENCODER)
    assert small is encoder(vocabulary, **token_files.ENCODER) and small is not encoder(vocabulary)
    assert small._known.limit <= 250_000 and small.segment <= 4 << 20
    assert small("a few words").tolist() == encoder(vocabulary)("a few words").tolist()


def test_packing_workers_hold_few_pieces_and_short_runs_of_rows(vocabulary):
    from gaitworks.llm.tokens import encoder, slices

    small = encoder(vocabulary, **packing.ENCODER)
    assert small._known.limit <= 250_000 and small.segment <= 4 << 20
    t = pa.record_batch([pa.array(range(7)), pa.array(["a" * 10, None, "b" * 3, "c" * 30, "", "d" * 9, "e" * 3])], names=["i", "s"])
    assert [x.column(0).to_pylist() for x in slices(t, 1, 12)] == [[0, 1], [2], [3], [4, 5, 6]]
    assert [x.column(0).to_pylist() for x in slices(t.slice(2), 1, 12)] == [[2], [3], [4, 5, 6]]
    assert list(slices(t.slice(0, 0), 1, 12)) == []
    flat, border = small.column(t.column(1))
    parts = [small.column(x.column(1)) for x in slices(t, 1, 12)]
    assert np.concatenate([f for f, _ in parts]).tolist() == flat.tolist()
    assert np.concatenate([np.diff(b) for _, b in parts]).tolist() == np.diff(border).tolist()
