"""Hybrid search against scoring every pair, and the index under it."""

import math

import numpy as np
import pytest

from pathmill.operators import retrieval, scoring, vectors
from pathmill.operators.retrieval import hybrid_search, term_pairs
from pathmill.operators.vectors import InvertedFile


def clustered(n, dims=12, groups=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    return [[float(x) for x in centres[k % groups] + 0.35 * rng.standard_normal(dims)] for k in range(n)]


def terms(n, seed=1):
    rng = np.random.default_rng(seed)
    return [sorted({"the", "a"} | {f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(1, 12)) if x < 400}) if k % 7 else [f"only{k}"] for k in range(n)]


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def every_pair(rows, asked, weight=0.3, least=0.2, k=100):
    out = []
    for q, vq, tq in asked:
        scored = []
        for d, vd, td in rows:
            a, b = set(tq or []), set(td or [])
            score = weight * cosine(vq, vd) + (1 - weight) * (len(a & b) / len(a | b) if a | b else 0)
            if score >= least:
                scored.append((-score, d))
        out += [(q, d, round(-s, 9), place + 1) for place, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["doc_id"], round(r["score"], 9), r["place"]) for r in df.collect())


def frames(spark, rows, asked):
    return spark.createDataFrame(asked, "query_id long, vector array<double>, terms array<string>"), spark.createDataFrame(rows, "doc_id long, vector array<double>, terms array<string>")


@pytest.mark.parametrize("split", [0.6, 0.3, 1.0])
def test_hits_are_those_of_every_pair(spark, split):
    rows = [(k, v, t) for k, (v, t) in enumerate(zip(clustered(240), terms(240)))]
    asked = [r for r in rows if r[0] % 12 == 0]
    q, d = frames(spark, rows, asked)
    wanted = every_pair(rows, asked)
    assert found(hybrid_search(q, d, split=split)) == wanted
    assert any(not set(rows[w[0]][2]) & set(rows[w[1]][2]) for w in wanted)
    assert found(hybrid_search(q, d, split=split, k=2)) == every_pair(rows, asked, k=2)


def test_equal_vectors_without_a_common_term_are_hits(spark):
    q, d = frames(spark, [(1, [1.0, 0.0], ["x"]), (2, [0.9, 0.1], None), (3, None, ["y"]), (4, [0.0, 0.0], ["z"])], [(7, [1.0, 0.0], ["y"])])
    assert [(r["doc_id"], round(r["score"], 3)) for r in hybrid_search(q, d).orderBy("place").collect()] == [(3, 0.7), (1, 0.3), (2, 0.298)]


def test_odd_rows_are_scored_as_stated(spark):
    rows = [(k, v, t) for k, (v, t) in enumerate(zip(clustered(60), terms(60)))] + [(100, None, ["the"]), (101, [], ["the", "a"]), (102, [1.0, 2.0], ["a"]), (103, [0.0] * 12, []), (104, [1.0] * 12, None)]
    asked = [r for r in rows if r[0] % 5 == 0 or r[0] >= 100]
    q, d = frames(spark, rows, asked)
    assert found(hybrid_search(q, d)) == every_pair(rows, asked)
    assert found(hybrid_search(q.limit(0), d)) == [] and found(hybrid_search(q, d.limit(0))) == []


def test_index_finds_all_pairs_and_probes_few_lists(spark):
    rows = [(k, v) for k, v in enumerate(clustered(300, groups=10))]
    docs = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    index = InvertedFile.build(docs)
    assert index.size.sum() == 300 and index.lists.count() == 300
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    got = sorted((r[0], r[1]) for r in index.pairs(asked, 0.8).select("query_id", "doc_id").collect())
    assert got == sorted((a, b) for a, x in rows if a % 20 == 0 for b, y in rows if cosine(x, y) >= 0.8)
    angles = vectors._angles(vectors._unit([np.array(v) for k, v in rows if k % 20 == 0], 12), index.centroids)
    probed = (angles - index.radius[None, :] <= math.acos(0.8)).sum()
    assert probed < 0.6 * angles.size  # lists that can hold no pair are left out


def test_frequent_terms_are_not_joined_on(spark):
    rows = [(k, ["the", "of", "and", f"w{k // 2}", f"x{k}"]) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    asked = docs.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    assert term_pairs(asked, docs, 0.61).count() == 40  # itself and the one that shares w
    assert term_pairs(asked, docs, 0.3).where("query_id = 0").count() == 200  # three of seven: every pair reaches it


def test_pages_tiles_and_counts_in_parts_give_the_same_hits(spark, monkeypatch):
    rows = [(k, v, t) for k, (v, t) in enumerate(zip(clustered(150), terms(150)))] + [(k, None, ["the", "a", "same"]) for k in range(200, 260)]
    asked = [r for r in rows if r[0] % 5 == 0]
    q, d = frames(spark, rows, asked)
    monkeypatch.setattr(retrieval, "PAGE_QUERIES", 7)
    page = scoring.Page.of(q.toArrow(), 0.3, 0.2, 3)
    for name, value in (("TILE", 11), ("COUNTED", 5), ("HELD", 20)):
        monkeypatch.setattr(scoring, name, value)
    wanted = every_pair(rows, asked, k=3)
    hits = list(page.search(d.toArrow().to_batches(max_chunksize=40)))
    assert sorted((b["query_id"][i].as_py(), b["doc_id"][i].as_py()) for b in hits for i in range(b.num_rows)) == sorted(w[:2] for w in wanted)
    assert found(hybrid_search(q, d, k=3)) == wanted


def test_no_row_is_made_of_a_pair_that_is_no_hit(spark):
    rows = [(k, None, ["the", "of", "and", *(f"x{k}-{i}" for i in range(27))]) for k in range(300)]  # 3 of 57 terms
    q, d = frames(spark, rows, rows[::10])
    hits = hybrid_search(q, d)
    assert found(hits) == [(k, k, 0.7, 1) for k in range(0, 300, 10)]
    assert "JOIN" not in hits._jdf.queryExecution().optimizedPlan().toString().upper()  # what is read is hits alone
    assert sum(spark.read.parquet(f).count() for f in hits.inputFiles()) == 30


def test_vectors_that_are_no_vectors_have_no_cosine(spark):
    nan = float("nan")
    q, d = frames(spark, [(1, [1.0, nan], ["x"]), (2, [1.0, None], ["y"]), (3, [float("inf"), 0.0], ["z"]), (4, [1.0, 0.0, 0.0], ["v"])], [(7, [1.0, 0.0], ["x"]), (8, [nan, nan], ["y", "w"])])
    assert found(hybrid_search(q, d)) == [(7, 1, 0.7, 1), (8, 2, 0.35, 1)]
