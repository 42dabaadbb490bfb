"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from pathmill.llm import spelling
from pathmill.llm.spelling import bucketed, near_words, spelling_variants, words_of


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute(words, factor=10):
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= factor * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()), key=str)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def frame(spark, words):
    return spark.createDataFrame(sorted(words.items()), "word string, n long")


def random_words(n, alphabet, longest, seed):
    rng = random.Random(seed)
    return {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))): 10 ** rng.randint(0, 5) * rng.randint(1, 3) for _ in range(n)}


@pytest.mark.parametrize(("alphabet", "longest", "most"), [("ab", 9, 500), ("abc", 7, 5), ("aé中\U0001f600", 5, 20), ("abcdefgh", 4, 2)])
def test_rows_equal_brute_force(spark, alphabet, longest, most):
    words = random_words(250, alphabet, longest, most)
    assert found(near_words(frame(spark, words), most=most)) == brute(words)


def test_tiles_and_diagonals_agree(spark, monkeypatch):
    words = random_words(300, "abc", 7, 4)
    source = frame(spark, words)
    monkeypatch.setattr(spelling, "SMALL", 0)
    monkeypatch.setattr(spelling, "SIDE", 7)
    # tasks fork from this process's code, not from its changed values, so the tiles are met here
    tiles = {(i, j) for longer in (6,) for i, j in _all_pairs(words, longer)}
    monkeypatch.setattr(spelling, "SMALL", 10_000)
    assert tiles == {(i, j) for i, j in _all_pairs(words, 6)} and tiles
    assert found(near_words(source)) == brute(words)


def _all_pairs(words, longer):
    import numpy as np

    own = sorted(w for w in words if len(w) in (longer, longer - 1))
    zero = np.zeros(len(own), np.int64)
    pairs = {(int(a), int(b)) for i, j in spelling.Tiles(own, longer, zero, zero + longer, zero).pairs() for a, b in zip(i, j)}
    wanted = {(a, b) for a in range(len(own)) for b in range(a + 1, len(own)) if one_edit(own[a], own[b]) and longer in (len(own[a]), len(own[b]))}
    assert {tuple(sorted(p)) for p in pairs} == wanted and len(pairs) == len(wanted)
    return pairs


def test_a_hot_prefix_is_split_until_buckets_are_small(spark):
    words = {"prefix" + a + b + c + "suffix": 2 for a in "abcdef" for b in "abcdef" for c in "abcdef"}
    rows = bucketed(frame(spark, words), 20)
    assert rows.groupBy(*spelling.BUCKET).count().agg({"count": "max"}).first()[0] <= 20
    assert found(near_words(frame(spark, words), most=20)) == brute(words)


def test_each_near_pair_meets_in_one_bucket_only(spark):
    words = random_words(120, "ab", 8, 9)
    rows = near_words(frame(spark, words), most=3).collect()
    assert sum(r["n_near"] for r in rows) == sum(one_edit(a, b) for a in words for b in words if a != b)


def test_roots_follow_chains(spark):
    words = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10_000, "aabbbbb": 100_000, "abbbbbb": 999_999, "zzzz": 3}
    rows = {r["word"]: (r["form"], r["root"], r["form_n"]) for r in near_words(frame(spark, words)).collect()}
    assert rows["aaaaaaa"] == ("aaaaaab", "aabbbbb", 10) and rows["aabbbbb"] == (None, "aabbbbb", None) and rows["zzzz"] == (None, "zzzz", None)


def test_long_words(spark):
    long = "ab" * 700
    words = {long: 100, long[:-1]: 5, long[:500] + "c" + long[501:]: 9, long[:300] + "xx" + long[302:]: 7}
    assert found(near_words(frame(spark, words))) == brute(words)


def plain_words(docs, damage=31):
    count = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % damage == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def test_words_of_odd_texts(spark):
    rng = random.Random(0)
    pool = ["Straßenbahn", "ÉCOLIERE", "müller×÷ab", "abcdefg", "abcdef", "Nation1Nation", "naïveté́s", "Ābcdefghi", "internationalisation", "counterrevolutionary"]
    docs = [(k, " ".join(rng.choice(pool) for _ in range(80))) for k in range(60)] + [(None, "abcdefgh abcdefgh"), (1, None), (2, ""), (3, "abcdefgh," * 20_000), (3, "abcdefgh")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "'y' AS id")
    words = {r["word"]: r["n"] for r in words_of(df.repartition(3)).collect()}
    assert words == plain_words(docs) and any(len(w) == 10 for w in words)
    assert found(spelling_variants(df)) == brute(words)
    assert spelling_variants(df.limit(0)).count() == 0
