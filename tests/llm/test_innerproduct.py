import math
import random

import numpy as np
import pytest

from parley.llm import innerproduct

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    have = {}
    for key, x, _ in rows:
        if key is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        v = [math.floor(256 * float(np.float32(c))) for c in x]
        if key not in have or sum(c * c for c in v) > sum(c * c for c in have[key]):
            have[key] = v
    out = []
    for q in have:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(have[q], v)), i) for i, v in have.items() if i != q)
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def random_rows(n=400, width=9, spread=3.0):
    rng = random.Random(2)
    return [(i, [rng.gauss(0, 1) * math.exp(spread * rng.random()) for _ in range(width)], 0) for i in range(n)]


@pytest.mark.parametrize("block, query_block", [(4096, 2048), (37, 3)])
def test_against_brute_force(spark, block, query_block):
    rows = random_rows()
    rows += [(k, rows[3][1], 1) for k in range(400, 460)]  # ties
    got = innerproduct.top_k(spark.createDataFrame(rows, VECTORS).repartition(4), lambda c: c % 50 == 0, block=block, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [], 1)]
    rows += [(6, [1.0, 2.0, 3.0], None), (None, [9.0, 9.0], 1), (-50, [0.0, -1.0], 1), (7, [1.0, 1.0], 1), (7, [1.0, 1.0], 1), (8, [0.5, 0.5], 1), (8, [1.5, 1.5], 1)]
    got = innerproduct.embeddings_query(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_large_values_stay_exact(spark):
    rows = [(i, [float(2**22 + 3 * i), float(-(2**22) + i)], 0) for i in range(120)]
    got = innerproduct.embeddings_query(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_or_no_rows(spark):
    assert innerproduct.embeddings_query(spark.createDataFrame([], VECTORS)).collect() == []
    assert innerproduct.embeddings_query(spark.createDataFrame([(1, [1.0], 0)], VECTORS)).collect() == []
    assert innerproduct.embeddings_query(spark.createDataFrame([(0, [1.0], 0)], VECTORS)).collect() == []
    two = spark.createDataFrame([(0, [1.0], 0, "x"), (1, [2.0], 0, "x")], VECTORS + ", v string")
    assert [tuple(r) for r in innerproduct.embeddings_query(two).collect()] == [(0, 1, 1, 256 * 512)]


def test_bounds_prune():
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(3000, 8)) * np.exp(2 * rng.random((3000, 1))) * 100).astype(np.int64)
    v = v[np.argsort(-(v.astype(float) ** 2).sum(1))]
    turn = np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1]
    side = innerproduct.Side(np.arange(3000, dtype="<i8").tobytes(), [x.astype("<i8").tobytes() for x in v], 8, turn, 2)
    score, _, done = innerproduct.best(side, side, np.int64(innerproduct.LOWEST))
    every = (v @ v.T).astype(np.int64)
    np.fill_diagonal(every, -(1 << 60))
    assert (score == -np.sort(-every, 1)[:, :5]).all() and done < every.size / 2
