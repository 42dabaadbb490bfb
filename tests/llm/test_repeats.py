"""Repeated passages against brute force: words through the compressed index, bytes through the grouped suffix array."""

import dataclasses
import random
import re

import numpy as np
import pytest

from pathmill.llm import fm_index, repeats, suffix_groups
from pathmill.llm.repeats import Rule, erase_repeats

SCHEMA = "bundle int, doc_id long, text string, kept string"


def plain(docs, width, symbols, join):
    """doc number -> (n, removed, spans, kept) by looking at every window."""
    least = {}
    tokens = [symbols(t or "") for _, t in docs]
    big = float("inf")
    for (d, _), x in zip(docs, tokens, strict=True):
        for k in range(len(x) - width + 1):
            w = tuple(x[k : k + width])
            least[w] = min(least.get(w, big), big if d is None else d)
    out = []
    for (d, _), x in zip(docs, tokens, strict=True):
        gone = [False] * len(x)
        for k in range(len(x) - width + 1):
            if least[tuple(x[k : k + width])] < (big if d is None else d):
                gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(x), sum(gone), spans, join([s for s, g in zip(x, gone, strict=True) if not g])))
    return sorted(out, key=str)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def random_docs(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "bé", "c", "dd", "e e", "ß"]
    shared = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 40))) for _ in range(5)]
    docs = []
    for d in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choices(vocabulary + [f"w{d}"], k=rng.randint(0, 20))) for _ in range(rng.randint(0, 4))]
        docs.append((d, rng.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(100, None), (101, ""), (102, "  \n"), (None, shared[0]), (3, shared[1]), (3, shared[1]), (200, "a " * 3000)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(0, d, t, "x") for d, t in docs], SCHEMA).repartition(3)


@pytest.mark.parametrize("hot", [0, 2000])
def test_words(spark, hot):
    docs = random_docs(1)
    rule = Rule("words", 13, 6, fm_index.smallest_owners, bundle_bytes=1500, hot_bundles=hot)
    got = sorted([(r["doc_id"], r["n"], r["removed"], len(r["spans"]) // 2, bytes(r["kept"]).decode()) for r in erase_repeats(frame(spark, docs), rule).collect()], key=str)
    assert got == plain(docs, 13, words_of, " ".join)


@pytest.mark.parametrize("hot", [0, 2000])
def test_bytes(spark, hot):
    docs = random_docs(2)
    rule = Rule("bytes", 50, 20, suffix_groups.smallest_owners, bundle_bytes=1500, hot_bundles=hot)
    got = sorted([(r["doc_id"], r["n"], r["removed"], len(r["spans"]) // 2, bytes(r["kept"])) for r in erase_repeats(frame(spark, docs), rule).collect()], key=str)
    assert got == plain(docs, 50, lambda t: list(t.encode()), bytes)


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fm_index.erase_repeated_words(empty).collect() == []
    assert suffix_groups.erase_repeated_bytes(empty).collect() == []


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(500):
        text = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_groups.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_wavelet_rank():
    rng = np.random.default_rng(4)
    for symbols in (rng.integers(0, 37, 500), np.sort(rng.integers(0, 37, 3000))):
        tree = fm_index.WaveletTree(symbols, 6)
        ask, at = rng.integers(0, 37, 200), rng.integers(0, len(symbols) + 1, 200)
        assert tree.rank(ask, at).tolist() == [int((symbols[:i] == s).sum()) for s, i in zip(ask, at, strict=True)]


def test_matching_statistics():
    """Of foreign patterns too: the longest match from each place on, and an interval with its occurrences."""
    rng = random.Random(9)
    for _ in range(60):
        text = [rng.randint(1, 3) for _ in range(rng.randint(1, 60))] + [0]
        depth = rng.choice([1, 3, 5, 13])
        owners = np.array([rng.randint(0, 9) for _ in text])
        index = fm_index.FMIndex(np.array(text), depth, owners)
        patterns = [[rng.randint(1, 4) for _ in range(rng.randint(1, 20))] for _ in range(5)]
        length, place = index.matching_statistics(np.concatenate(patterns), np.cumsum([len(p) for p in patterns]))
        want, least, k = [], [], 0
        for p in patterns:
            for i in range(len(p)):
                n = max(n for n in range(min(depth, len(p) - i) + 1) if any(text[j : j + n] == p[i : i + n] for j in range(len(text))))
                want.append(n)
                if n == depth:
                    assert index.least_owner(place[k : k + 1])[0] == min(owners[j] for j in range(len(text)) if text[j : j + n] == p[i : i + n])
                k += 1
        assert length.tolist() == want


def test_index_is_smaller_than_its_text():
    """Over text with repeats the index, without text and order, takes less than both."""
    rng = np.random.default_rng(3)
    passage = rng.integers(1, 5000, 400)
    text = np.concatenate([x for _ in range(100) for x in (passage, rng.integers(1, 5000, 40), [0])])
    assert fm_index.FMIndex(text, 13, np.zeros(len(text), np.uint32)).nbytes() < 0.5 * 2 * 8 * len(text)


def test_nothing_is_removed_without_the_index(spark):
    """What the index does not report stays: with an index that reports nobody, no word goes."""
    docs = random_docs(1)
    nobody = lambda segments, ids, width: [np.full(len(s.split(b" ")) - width + 1, np.iinfo(np.int64).max) for s in segments]
    got = erase_repeats(frame(spark, docs), Rule("words", 13, 6, nobody, bundle_bytes=1500)).collect()
    assert sum(r["removed"] for r in got) == 0
    assert sum(r["removed"] for r in erase_repeats(frame(spark, docs), Rule("words", 13, 6, fm_index.smallest_owners, bundle_bytes=1500)).collect()) > 0


def test_gram_hashes_by_value():
    values = np.arange(50, dtype=np.uint64) % np.uint64(7)
    for size in (1, 2, 5, 6, 13, 20):
        got = repeats.gram_hashes(values, size)
        assert len(got) == 51 - size
        assert len(set(got.tolist())) == min(7, 51 - size)
    assert dataclasses.is_dataclass(Rule)
