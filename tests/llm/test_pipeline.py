"""The pipeline against a plain run of its decisions."""

import importlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pathmill.llm import language_id, mixing, packing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    parts = {"aa": ["th", "ing", "er", "on"], "bb": ["eau", "oui", "é", "tre"]}
    rows = []
    for k in range(160):
        lang = rng.choice(["aa", "bb"])
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(40, 90)))
        rows.append((k, text, lang, f"s{k % 4}", len(text)))
    rows += [(200 + k, rows[k][1], rows[k][2], "s1", 0) for k in range(10)]
    for k in range(10):
        words = rows[20 + k][1].split()
        words[5] = "changed"
        rows.append((300 + k, " ".join(words), rows[20 + k][2], "s2", 0))
    rows += [(400, None, "aa", "s1", 0), (401, "12 34 $$", None, None, 0), (402, rows[3][1] + " " + rows[4][1], None, None, 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_run(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language_id.fit(docs)
    names, scores = language_id.classify([r[1] for r in rows], model)
    left = [r for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= corpus_pipeline.MIN_LANGUAGE_SHARE]
    first = {}
    for r in sorted(left, key=lambda r: r[0]):
        first.setdefault(r[1], r)
    left = list(first.values())
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    sets = [grams(r[1]) for r in left]
    label = list(range(len(left)))
    for _ in range(len(left)):
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[j] < label[i] and len(a & b) >= 0.8 * len(a | b):
                    label[i], changed = label[j], True
        if not changed:
            break
    left = [r for k, r in enumerate(left) if label[k] == k]
    assert {r[0] for r in left} & {200, 300, 400, 401} == set() and len(left) >= 155
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix_sources(spark.createDataFrame(left, SCHEMA)).collect()}
    encode, want = packing.encoder().ids, Counter()
    for d, text, *_ in left:
        ids = encode(text) + np.uint32(2).tobytes()
        assert len(ids) <= 4 * 1024
        want[d, zlib.crc32(ids)] += int(taken[d] + 0.5)
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == +want


def test_stages(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language id", "exact dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).collect() == []
    assert importlib.util.find_spec("corpus_pipeline")


def test_null_and_repeated_ids(spark, corpus):
    """Rows without an id of their own are decided one by one and come back once."""
    path, rows = corpus
    words = rows[2][1].split()
    words[5] = "changed"
    lone = [(None, rows[k][1], rows[k][2], f"s{k % 4}", 0) for k in range(40)]
    odd = lone + lone[:8] + [(None, " ".join(words), rows[2][2], "s1", 0), (None, "12 34 $$", None, None, 0)]
    odd += [(7000, rows[50][1], rows[50][2], "s1", 0)] * 30 + [(7001, rows[51][1], "aa", "s1", 0), (7001, rows[52][1], "bb", "s2", 0), (None, rows[52][1], "bb", "s2", 0)]
    docs = spark.createDataFrame(odd, SCHEMA).repartition(3)
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    whole = texts(docs)
    languages = texts(corpus_pipeline.keep_languages(spark, spark.createDataFrame(rows + odd, SCHEMA), path))
    assert languages[None, "12 34 $$"] == 0 and languages[7000, rows[50][1]] == 30 and languages[None, rows[0][1]] == whole[None, rows[0][1]] == 2
    exact = texts(corpus_pipeline.drop_exact_copies(spark, docs, path))
    assert Counter(t for _, t in exact.elements()) == Counter({r[1]: 1 for r in odd}) and exact[7001, rows[52][1]] == 1
    near = texts(corpus_pipeline.drop_near_copies(spark, docs, path))
    assert near[None, rows[2][1]] + near[None, " ".join(words)] == 1 and set(near.values()) == {1} and sum(near.values()) == len({r[1] for r in odd}) - 1
    size = lambda t: len(t.split())
    mixed = texts(corpus_pipeline.mix(spark, docs, path))
    assert all(n <= 3 * whole[key] for key, n in mixed.items())
    want = sum(int(r["taken"] / r["size"] + 0.5) * r["size"] for r in mixing.mix_sources(docs).collect())
    assert sum(n * size(t) for (_, t), n in mixed.items()) == want


def test_odd_rows_in_each_stage(spark, corpus):
    """Clashing names, nulls in any column, empty and very long texts, ties: every stage runs and returns documents."""
    path, rows = corpus
    odd = rows[:30] + [(None, None, None, None, None), (1, None, None, "s1", None), (2, "", "aa", None, 0), (3, rows[3][1] + " " + "thing er " * 60_000, "aa", "s0", 1), (3, rows[3][1], "aa", "s0", 1), (3, rows[3][1], "aa", "s0", 1), (8000, rows[4][1], rows[4][2], None, None)]
    extra = "_id string, row int, id string, digest string, keep_id int, copies int, _copy int, least string, piece int, start int, source_size int, target int, seconds int, class_id int, hash int, size int"
    clashing = spark.createDataFrame([(*x, *["x" if "string" in c else 1 for c in extra.split(", ")]) for x in odd], f"{SCHEMA}, {extra}").repartition(3)
    plain = clashing.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, clashing, path), stage(spark, plain, path)
        found = Counter(map(tuple, got.collect()))
        assert got.columns == corpus_pipeline.COLUMNS and found == Counter(map(tuple, want.collect())), name
        assert {x[:2] for x in found} <= {x[:2] for x in odd}
    packed = corpus_pipeline.pack(spark, clashing, path).collect()
    encode = packing.encoder().ids
    assert sum(r["length"] for r in packed) == sum(len(encode(x[1] or "")) // 4 + 1 for x in odd)
    assert corpus_pipeline.pack(spark, clashing.limit(0), path).collect() == []


def test_mix_against_plain_rounding(spark, tmp_path):
    """Without the operator: two sources of equal documents, targets 1 and 2 thirds; each row as often as due, to a block."""
    docs = [(k, f"w{k} " * 64, "aa", "ab"[k % 2], 0) for k in range(400)]
    got = Counter(r["source"] for r in corpus_pipeline.mix(spark, spark.createDataFrame(docs, SCHEMA), str(tmp_path)).collect())
    # 400 documents of equal size: a third for a, two thirds for b
    assert abs(got["a"] - 400 / 3) <= 16 and abs(got["b"] - 800 / 3) <= 16
