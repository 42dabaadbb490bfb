"""The join against all pairs of exact shingle sets."""

import itertools
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathmill.llm import ngram_join
from pathmill.llm import ngram_join as J
from pathmill.llm.components import components

SCHEMA = "node string, doc_id long, text string"


def plain(docs, n=5, similarity=0.8):
    def grams(t):
        w = (t or "").split()
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}

    sets = [grams(t) for _, t in docs]
    linked = [[i != j and ((docs[i][1] or "") == (docs[j][1] or "") or bool(a & b) and len(a & b) >= similarity * len(a | b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i, row in enumerate(linked):
            for j, x in enumerate(row):
                if x and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[label[i]] = min(d, least.get(label[i], d))
    return sorted(((d, least.get(label[i]), sum(linked[i])) for i, (d, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("block", [256, 4])
def test_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(7)
    docs = []
    for family in range(6):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(text)))
    docs += [(500, docs[0][1]), (501, docs[0][1]), (502, "a b c"), (503, "a  b\nc"), (504, None), (505, ""), (506, "zz " * 4000), (None, docs[0][1]), (None, "lone words that stand for themselves here"), (3, docs[3][1])]
    frame = spark.createDataFrame([("x", *d) for d in docs], SCHEMA).repartition(3)
    got = ngram_join.near_duplicates(frame).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == plain(docs)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_no_rows(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shorten():
    """Small crowds are opened at once; in crowded trees prefixes are long, elsewhere short."""
    shortest = ngram_join.DEPTHS[-1]
    each = [(t, d) for t in range(ngram_join.TREES) for d in ngram_join.DEPTHS]
    tree, depth = np.array([t for t, _ in each]), np.array([d for _, d in each])
    opened = lambda texts: ngram_join.shorten(tree, depth, np.array(texts), np.zeros(len(each), int), 0.8, 0.999)
    assert set(depth[opened([2] * len(each))]) == {shortest}
    crowded = opened([(50_000 if d < 12 else 3) if t < 8 else 2 for t, d in each])
    assert set(depth[crowded & (tree >= 8)]) == {shortest} and set(depth[crowded & (tree < 8)]) <= {12}
    everywhere = opened([1_000_000] * len(each))
    assert everywhere.any()  # nothing is cut, however large the crowd
    miss = np.prod([1 - 0.8 ** int(depth[everywhere & (tree == t)].min()) for t in range(ngram_join.TREES)])
    assert miss <= 0.001


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_longest_matches(size):
    rng = random.Random(1)
    rows = sorted((rng.randint(0, 2), rng.choice([5, 6]), rng.choice([0, 1, 1 << 20, 1 << 59, 7 << 40]), k) for k in range(60))
    rows += [(9, 1, 1, 100)]
    value = lambda r: [(r[1] >> (10 * k)) & 1023 for k in range(5, -1, -1)] + [(r[2] >> (10 * k)) & 1023 for k in range(5, -1, -1)]

    def shared(a, b):
        n = next((k for k, (x, y) in enumerate(zip(value(a), value(b), strict=True)) if x != y), 12) if a[0] == b[0] else 0
        return max([d for d in ngram_join.DEPTHS if d <= n], default=0)

    frames = [pd.DataFrame(rows[a : a + size], columns=["tree", "high", "low", "node"]) for a in range(0, len(rows), size)]
    got = {int(r.node): int(r.longest) for f in ngram_join._longest_matches(iter(frames)) for r in f.itertuples()}
    for k in range(1, len(rows) - 1):
        want = max(shared(rows[k], rows[k - 1]), shared(rows[k], rows[k + 1]))
        assert got.get(rows[k][3], 0) == want
    assert got[100] == 12


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_recall_on_given_texts(spark):
    """Copies of given texts planted at similarities just over the threshold: nearly all links of all pairs are found."""
    rng = random.Random(4)
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 1500 and text is not null").collect()]
    docs = list(given)
    for d, t in rng.sample([x for x in given if len(x[1].split()) >= 120], 500):
        words = t.split()
        # c separate changes alter 5c of n shingles: similarity (n - 5c) / (n + 5c)
        n = len(words) - 4
        c = int(n / 9 / 5)
        for at in rng.sample(range(2, len(words) - 2, 5), min(c, len(range(2, len(words) - 2, 5)))):
            words[at] = f"x{rng.random()}"
        docs.append((100_000 + d, " ".join(words)))
    grams = [{hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    holders = defaultdict(list)
    for k, g in enumerate(grams):
        for x in g:
            holders[x].append(k)
    both = Counter(p for h in holders.values() if 1 < len(h) for p in itertools.combinations(h, 2))
    true = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(grams[a]) + len(grams[b]) - n)]
    near = sum(both[p] < 0.85 * (len(grams[p[0]]) + len(grams[p[1]]) - both[p]) for p in true)
    found = {r["doc_id"]: r["class_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    recall = sum(found[docs[a][0]] == found[docs[b][0]] for a, b in true) / len(true)
    print("recall", recall, "of", len(true), "links,", near, "of them under 0.85")
    assert near >= 300 and recall >= 0.99


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 102), (102, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == got[102] == 100


@pytest.mark.parametrize("common", [100, 140])
def test_a_common_template_makes_no_family(spark, common):
    """Texts of 200 words that share half or more, every pair at a Jaccard similarity of 0.32 or 0.53: no link."""
    rng = np.random.default_rng(common)
    template = [f"t{k}" for k in range(common)]
    rows = [(k, " ".join([*template, *(f"w{x}" for x in rng.integers(0, 1 << 40, 200 - common))])) for k in range(1500)]
    rows += [(5000 + k, rows[k][1] + " more") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    signed = docs.selectExpr("doc_id AS id", "md5(cast(text AS binary)) AS digest", "text AS body").mapInPandas(J._sign(5), "id long, digest string, shingles long, paths array<long>, sketch binary")
    families = J.candidate_families(signed.withColumn("node", F.col("id")), 0.8, 0.999)
    assert families.count() <= 50 and families.groupBy("root").count().agg({"count": "max"}).first()[0] <= 4
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.near_duplicates(docs).collect()}
    assert {k: v for k, v in found.items() if v != (k, 0)} == {k: (k % 5000, 1) for k in [*range(20), *range(5000, 5020)]} | {k: (k, 1) for k in range(20)}


def test_large_crowds_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, sketches = [], rng.integers(0, 256, (6, J.SKETCH)).astype(np.uint8)
    for k in range(40):
        s = sketches[k % 6].copy()
        s[rng.integers(0, J.SKETCH, 10)] = 7
        rows.append((k, bytes(s)))
    monkeypatch.setattr(J, "CROWD", 5)
    texts = spark.createDataFrame(rows, "node long, sketch binary")
    members = texts.select(F.lit(1).cast("long").alias("key"), "node").unionByName(texts.select(F.lit(2).cast("long").alias("key"), "node"))
    roots = {r["node"]: r["root"] for r in J.components(J.probable_links(members, texts, 0.8)).collect()}
    assert roots == {k: k % 6 for k in range(40)}


def test_sketches_of_linked_texts_agree():
    rng = np.random.default_rng(5)
    least = J.agreement(0.8)
    for _ in range(30):
        a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
        b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100).astype(np.uint64)])  # 800 of 1,000
        x, y = J.signatures(np.concatenate([a, b]), np.array([900, 900])).astype(np.uint8)
        assert (x == y).sum() >= least
