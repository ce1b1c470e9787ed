import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from quillstack.llm import common, packing, queries, token_files
from quillstack.llm.common import Pieces

from .conftest import DOCS, edge_rows, prose

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def key(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_are_the_tokenizer(path):
    encode, pieces, rng = plain(path), Pieces(path, limit=50), random.Random(1)
    alphabet = ["a", "B", "'s", "'re", " ", "  ", "\n", "\n\n", "\t", "1", "23", "!", "é", "é", "́", "\x1c", "\x85", " ", " ", "日本", "Σ", "<|endoftext|>", "ß", "　", "İ", "\r\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [r[1] or "" for r in edge_rows()]
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        for t, got in zip(part, pieces.encode(part)):
            assert np.frombuffer(got, "<u4").tolist() == encode(t), repr(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=80), st.integers(7, 12))
def test_code_lengths(counts, limit):
    lengths = token_files.code_lengths(np.array(counts), limit)
    used = np.array(counts) > 0
    assert (lengths[~used] == 0).all() and (lengths <= limit).all()
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_blocks(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 60000).astype(np.uint32)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=60001))
    codes, symbols, sizes, width = token_files.canonical(lengths)
    block = token_files.encode_block(ids, [3, None], np.array([n // 3, n - n // 3]), 77, codes, lengths)
    start, docs, counts, got = token_files.decode_block(block, symbols, sizes, width)
    assert (start, docs, counts.tolist()) == (77, [3, None], [n // 3, n - n // 3]) and (got == ids).all()


def test_token_files(spark, edge):
    encode, at, want = plain(BYTE), 0, []
    for r in sorted(edge_rows(), key=key):
        ids = [*encode(r[1]), 0]
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    got = [tuple(r) for r in token_files.token_files(edge, BYTE, 0).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.token_files(spark.createDataFrame([], DOCS), BYTE, 0).count() == 0


def check_packed(rows, docs, size=2048):
    encode = plain(WORD)
    whole = {}
    for r in sorted(docs, key=key):
        whole.setdefault(r[0], []).append([*encode(r[1]), 1])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(whole)
    for doc, texts in whole.items():
        assert sum(r["length"] for r in by_doc[doc]) == sum(map(len, texts))
        for r in by_doc[doc]:
            assert any(len(ids) == r["doc_tokens"] and crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for ids in texts)
    pad = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
        pad += packing.padding(at, size)
    return pad / sum(len(i) for t in whole.values() for i in t)


def test_packing(spark, edge):
    check_packed(packing.pack(edge, WORD).collect(), edge_rows())
    rng = random.Random(3)
    docs = [(k, prose(rng, rng.choice([5, 50, 700, 4000])), "en", "s", 1) for k in range(150)]
    rows = packing.pack(spark.createDataFrame(docs, DOCS), WORD).collect()
    assert check_packed(rows, docs) < 0.02
    assert packing.pack(spark.createDataFrame([], DOCS), WORD).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0.0, 3.0, 9.0])), min_size=1, max_size=25))
def test_best_cuts(steps):
    """Against the plain quadratic recurrence."""
    size = 16
    where, cost = np.cumsum([s for s, _ in steps]), np.array([c for _, c in steps])
    pos, pen = [0, *where.tolist()], [0, *cost.tolist()]
    best = [0.0] + [float("inf")] * len(where)
    exact = {1 << k for k in range(5) if 2 <= 1 << k}
    for j in range(1, len(pos)):
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= size:
                best[j] = min(best[j], best[i] + (0 if n in exact else size - n) + pen[j])
    cuts = packing.best_cuts(where, cost, size)
    total = sum((0 if b - a in exact else size - (b - a)) + pen[pos.index(b)] for a, b in zip([0, *cuts], cuts))
    assert total == best[-1] and cuts[-1] == pos[-1]


SPECIAL = ["a <|endoftext|> b", "  x \n<|startoftext|><|endoftext|>\t\ty ", "<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "e<|endoftext|>\u0301 İ  <|startoftext|>'s"]


def untouched(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_added_tokens_are_the_tokenizers(path):
    encode, pieces, rng = untouched(path), Pieces(path, limit=50, added=True), random.Random(5)
    alphabet = ["a", "B", "'s", " ", "  ", "\n", "\t", "1", "!", "é", "\u0301", "\x85", "日本", "İ", "<|endoftext|>", "<|startoftext|>", "<|", "|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(1500)] + SPECIAL + [r[1] or "" for r in edge_rows()]
    for t, got in zip(texts, pieces.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == encode(t), repr(t)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_repeated_pieces_are_looked_up_once(path):
    """op1's time went to a lookup for each word of each text, also for those that the batch repeats."""
    looked = []

    class Counted(Pieces):
        def __getitem__(self, piece):
            looked.append(piece)
            return super().__getitem__(piece)

    rng = random.Random(2)
    texts = [" ".join(rng.choices(["one", "two", "Öl", "3rd"], k=50)) for _ in range(100)]
    encode = untouched(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in Counted(path, added=True).encode(texts)] == [encode(t) for t in texts]
    assert len(looked) == len(set(looked)) <= 8


@pytest.mark.parametrize("added", [False, True])
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_of_columns(path, added, monkeypatch):
    """Texts side by side in one buffer, nulls, slices, marks, white space at the ends of texts, groups of few bytes."""
    monkeypatch.setattr(common, "_GROUP", 40)
    encode, pieces, rng = (untouched if added else plain)(path), Pieces(path, limit=50, added=added), random.Random(9)
    alphabet = ["a", "é", "ß", "×", "÷", "\u0301", "\u0338", "\u0345", "日本", "\u2019", "\u00a9", " ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x00", "7", "'s", "'", *"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\x7f"]
    rare = ["\x85", "\xa0", "\u1680", "\u2000", "\u200a", "\u200b", "\u2028", "\u202f", "\u205f", "\u3000", "<|endoftext|>"]
    texts = ["".join(rng.choice(rare if rng.random() < 0.01 else alphabet) for _ in range(rng.choice([0, 1, 2, 5, 12, 60]))) for _ in range(3000)]
    texts = [None if rng.random() < 0.02 else t for t in texts]
    for kind in (pa.string(), pa.large_string()):
        for column in (pa.array(texts, kind), pa.array(texts, kind).slice(11, 500), pa.array(texts[:0], kind), pa.array(["", None, ""], kind)):
            for t, got in zip(column.to_pylist(), pieces.encode(column), strict=True):
                assert np.frombuffer(got, "<u4").tolist() == encode(t), repr(t)


def test_queries_keep_added_tokens(spark, tmp_path):
    """The registered queries and the pipeline's last stage against an untouched Tokenizer."""
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(SPECIAL)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at, want = 0, []
    for k, t in enumerate(SPECIAL):
        ids = [*untouched(BYTE)(t), 0]
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op1_token_files(spark, str(tmp_path)).collect()) == want
    whole = [[*untouched(WORD)(t), 1] for t in SPECIAL]
    for found in (queries.op2_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        for r in found.collect():
            ids = whole[r["doc_id"]]
            assert r["doc_tokens"] == len(ids) and crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
