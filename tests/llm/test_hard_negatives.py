"""Hard negatives against brute force over integers, and the bounds that filter them."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pathmill.llm import hard_negatives as H
from pathmill.llm.hard_negatives import Asked, Best, Codes, hard_negatives, rotation


def brute(rows, n=5, m=5):
    valid = [(i, lab, [min(max(math.floor(256 * float(x)), -(1 << 24)), 1 << 24) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, v in sorted({(i, lab, tuple(v)) for i, lab, v in valid if i % 100 == 0}):
        scored = sorted((-dot(v, w), j, other) for j, other, w in valid if j != i)
        for s, j, _ in [x for x in scored if x[2] == lab][:n]:
            fits = [x for x in scored if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s][:m]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def mine(df, **more):
    return sorted(map(tuple, hard_negatives(df, anchor=F.col("vec_id") % 100 == 0, **more).collect()))


def vectors(n, dims=16, labels=4, seed=0, step=10):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, dims))
    label = rng.integers(0, labels, n)
    v = (0.5 * centres[label] + rng.standard_normal((n, dims))).astype(np.float32)
    return [(k * step, int(label[k]), [float(x) for x in v[k] / np.linalg.norm(v[k])]) for k in range(n)]


def test_rows_equal_brute_force(spark):
    rows = vectors(400)
    found = mine(frame(spark, rows).repartition(3))
    assert found == brute(rows) and len(found) > 100


def test_pages_and_codes_of_one_bit_a_dimension_change_nothing(spark):
    rows = vectors(300, seed=2)
    assert mine(frame(spark, rows), page=7, bits_per_dim=1, seed=3) == brute(rows)


def test_tiles_and_batches_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.floor(80 * rng.standard_normal((500, 16))).astype(np.int64)
    label, ids = rng.integers(0, 3, 500), np.arange(500)
    codes = Codes.of(x.astype(float), rotation(16, 64, 5))
    rows = pd.DataFrame({"id": ids, "label": label, "vector": [v.astype("<i4").tobytes() for v in x], "code": [w.tobytes() for w in codes.words], "length": codes.length, "align": codes.align, "shrink": codes.shrink})
    asked = H.Page(ids[:40], label[:40], x[:40], 64, 5, 5, 80, 100)
    whole = next(asked.search(iter([rows])))
    exact = x[:40] @ x.T
    for a in range(40):
        mine_ = sorted((-exact[a, j], j) for j in range(500) if j != a and label[j] == label[a])[:5]
        assert whole[whole["slot"] == a][["score", "id"]].values.tolist() == [[-s, j] for s, j in mine_]
    monkeypatch.setattr(H, "TILE", (3, 16))
    assert next(asked.search(iter([rows[:7], rows[7:300], rows[300:]]))).equals(whole)


def test_bounds_hold_the_inner_product_and_leave_pairs_out():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((600, 32)) / 6)
    y = np.vstack([x[:20], np.zeros((1, 32)), 1000 * x[3:4], np.eye(32)[:2]])
    for bits in (64, 256):
        turn = rotation(32, bits, 9)
        low, high = Asked(y, turn).bounds(np.arange(len(y)), Codes.of(np.vstack([x, np.zeros((1, 32))]), turn))
        exact = y @ np.vstack([x, np.zeros((1, 32))]).T
        assert (low <= exact).all() and (exact <= high).all()
        width = (high - low)[:20, 20:600].mean()
        if bits == 64:
            first = width
    assert width < 0.7 * first  # more bits, closer bounds
    threshold = np.sort(exact[:20], axis=1)[:, -6][:, None]
    assert (high[:20] >= threshold).mean() < 0.6


def test_ties_go_by_id_and_equal_vectors_fill_all_places(spark):
    same = [0.5, 0.25, -0.5]
    rows = [(k, k % 2, same) for k in range(0, 500, 7)] + [(100, 0, same), (200, 1, same)]
    assert mine(frame(spark, rows).repartition(4)) == brute(rows)


def test_best_keeps_the_first_of_each_slot():
    best = Best(2, 2)
    best.add(np.array([1, 1, 1]), np.array([5, 7, 7]), np.array([1, 9, 3]))
    best.add(np.array([1, 0]), np.array([7, -4]), np.array([4, 8]))
    assert best.rows().values.tolist() == [[0, 8, -4], [1, 3, 7], [1, 4, 7]]


def test_odd_rows(spark):
    rows = vectors(60, dims=4, labels=3, seed=5, step=50)
    odd = [(100, None, [1.0, 0.0, 0.0, 0.0]), (None, 1, [1.0, 0.0, 0.0, 0.0]), (7, 1, None), (8, 1, [1.0, None, 0.0, 0.0]), (9, 1, [float("nan"), 0.0, 0.0, 0.0]), (11, 1, [float("inf"), 0.0, 0.0, 0.0]),
           (12, 1, []), (300, 2, []), (13, 2, [0.5]), (14, 0, [1e38, 0.0, 0.0, 0.0]), (200, 5, [0.1, 0.1, 0.1, 0.1]), (200, 5, [0.1, 0.1, 0.1, 0.1]), (15, 5, [0.2, 0.1, 0.1, 0.1]), (15, 5, [0.2, 0.1, 0.1, 0.1])]
    df = frame(spark, rows + odd).withColumn("id", F.lit("x")).withColumn("score", F.lit(None).cast("int"))
    assert mine(df) == brute(rows + odd)
    assert mine(frame(spark, rows).limit(0)) == []
    assert mine(frame(spark, [r for r in rows if r[0] % 100])) == []
