"""Byte-level BPE against the public library that it must agree with, and exact round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

import public_tokenizers as P
from pathmill.llm.byte_bpe import Scanner, Vocabulary, decode_documents, encode_documents, merged
from pathmill.llm.queries import op13_byte_bpe

ODD = "ab's t'rvelmd  \n\t1２٣é中—!?'’　\x1c\x85_字ⅷ'll'RE\U0001f600"


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary.load("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=4000, seed=3):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return texts + ["", " ", "\n", "'", "'s", " 's", "''s", "'s's", "a'", "x 'll", "'l", "'v", "a" * 5000, " " * 5000, "ab" * 3000, "'" * 700, "<|endoftext|>"]


def test_ids_agree_with_the_library(vocab, library):
    texts = odd_texts()
    for text, ids in zip(texts, vocab.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)


def test_boundaries_agree_with_the_pattern(vocab):
    import regex

    pattern = regex.compile(P.PATTERN)
    for text in odd_texts(2000, 8):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points) + 1, bool)
        first[[0, -1]] = True
        assert np.flatnonzero(vocab.scanner.boundaries(points, first)).tolist() == [m.start() for m in pattern.finditer(text)], repr(text)


def test_scan_does_not_depend_on_rows_or_neighbours(vocab):
    texts = odd_texts(300, 11)
    alone = [vocab.encode([t])[0].tolist() for t in texts]
    narrow = Scanner()
    narrow.ROW = 3  # many levels
    wide, vocab.scanner = vocab.scanner, narrow
    try:
        assert [x.tolist() for x in vocab.encode(texts)] == alone
    finally:
        vocab.scanner = wide


def test_merging_a_long_piece_and_one_that_is_a_token(vocab, library):
    for piece in (" the", "aaaaaaaaa", "zq" * 400, "é" * 300):
        assert merged(piece.encode(), vocab.ranks) == library._encode_single_piece(piece)


def test_offsets_decode_any_span(vocab):
    rng = random.Random(1)
    for text, ids in zip(odd_texts(200, 5), vocab.encode(odd_texts(200, 5))):
        ends, raw = vocab.offsets(ids), text.encode()
        assert vocab.decode(ids, ends) == raw
        a, b = sorted((rng.randint(0, len(raw)), rng.randint(0, len(raw) + 3)))
        assert vocab.decode(ids, ends, a, b) == raw[a:b]


def test_cache_of_two_generations_gives_the_same_ids(vocab):
    texts = odd_texts(500, 2)
    wanted = [x.tolist() for x in vocab.encode(texts)]
    kept, vocab.merges.KEPT = vocab.merges.KEPT, 3
    try:
        assert [x.tolist() for x in vocab.encode(texts)] == wanted
    finally:
        vocab.merges.KEPT = kept


def test_rows_nulls_repeats_and_clashing_names(spark, library):
    rows = [(1, "Don't  stop.\n", 5, b"x"), (1, "Don't  stop.\n", 5, b"x"), (None, None, 6, None), (2, "", 7, b""), (3, "x " * 30_000, 8, b"y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, ids binary")
    found = decode_documents(encode_documents(docs)).collect()
    assert sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in found), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
    assert all(np.frombuffer(bytes(r["ids"]), "<u4").tolist() == library.encode_ordinary(bytes(r["decoded"]).decode()) for r in found)
    part = {r["doc_id"]: bytes(r["decoded"]) for r in decode_documents(encode_documents(docs), start=4, stop=9).collect()}
    assert part[1] == b"t  st" and part[2] == b"" and part[None] == b""
    assert encode_documents(docs.limit(0)).count() == 0


def test_query_on_a_whole_table(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
