"""Token alignment against plain loops over both libraries."""

import base64
import hashlib
import random
from collections import Counter

import pytest

from gaitworks.llm import alignment, queries


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    a = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return a, {i: b for b, i in ranks.items()}, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def brute(rows, libraries):
    enc, table, sp = libraries
    docs = []
    for index, text in rows:
        if not text:
            docs.append((index, [], [], []))
            continue
        a, b = enc.encode_ordinary(" " + text), sp.encode(text)
        ab = [table[i] for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            docs.append((index, [], [], []))
            continue
        groups, i, j, na, nb, ga, gb = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if j == len(b) or (i < len(a) and na <= nb):
                na += len(ab[i])
                ga.append(a[i])
                i += 1
            else:
                nb += len(bb[j])
                gb.append(b[j])
                j += 1
            if na == nb:
                groups.append((ga, gb))
                ga, gb = [], []
        docs.append((index, a, b, groups))
    count = Counter((g[0][-1], g[1][-1]) for *_, gs in docs for g in gs)
    most = {}
    for (x, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for index, a, b, gs in docs:
        links = [(g[0][-1], g[1][-1]) for g in gs]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((index, len(a), len(b), len(gs), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(told.encode()).hexdigest() if gs else ""))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda t: tuple((x is None, x) for x in t))


def test_against_loops(spark, libraries):
    rnd = random.Random(3)
    parts = ["the", "a", " ", "  ", "   ", "\n", "\t", "é", "東京", "😀", "ﬁ", "▁", "<s>", "<|endoftext|>", "grasp", "the cup", "1234", "...", "'s", "　", " ", "<0x41>", "Ünïcode", "ı", "\r\n", "-" * 9]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))) for i in range(500)]
    rows += [(500, " ".join(rnd.choice(parts) for _ in range(9000))), (501, "x" * 20_000), (502, " " * 5000), (None, "a cup"), (3, "a cup"), (3, "a cup"), (504, None), (505, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "episode_index long, instruction string, pair string, block int")
    got = alignment.align_tokens(df, queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model"), block_bytes=20_000)
    assert ordered(got.collect()) == ordered(brute(rows, libraries))


def test_whole_table(spark, libraries):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_lockstep_alignment"](spark, d)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(got.collect()) == ordered(brute(rows, libraries))


def test_odd_rows(spark, odd, none, libraries):
    voc = queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model")
    assert alignment.align_tokens(none, *voc).count() == 0
    rows = [tuple(r) for r in odd.select("episode_index", "instruction").collect()]
    assert ordered(alignment.align_tokens(odd, *voc).collect()) == ordered(brute(rows, libraries))


def test_texts_encoded_whole_give_the_same_ids(libraries):
    enc = alignment.PieceEncoder(queries.vocabulary("piece_bpe_32k.model"))
    assert enc.by_part
    texts = [" a  b c", "  x ", " " + "word two  three" * 30, "     ", " end "]
    flat, at = enc.column([t.encode() for t in texts])
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [libraries[2].encode(t[1:]) for t in texts]
    enc.by_part = False
    again, at2 = enc.column([t.encode() for t in texts])
    assert again.tolist() == flat.tolist() and at2.tolist() == at.tolist()
