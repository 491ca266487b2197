import hashlib
import math
import random

import numpy as np
import pytest

from parley.llm import centroids as C

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, k=8, rounds=10, width=64):
    """Plain rounds over Python integers."""
    have = []
    for key, x, *_ in rows:
        if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x):
            have.append((key, [C.integer(float(v), 1024) for v in x]))
    if not have:
        return []
    mark = lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    means = [v for _, v in sorted(have, key=lambda r: (mark(r), r[1]))[:k]]

    def assign():
        out = []
        for _, v in have:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(means)):
            mine = [v for (_, v), (_, w) in zip(have, at) if w == c]
            if mine:
                means[c] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign()
    inertia = [sum(d for d, w in at if w == c) for c in range(len(means))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    held = lambda x: x if x < 1 << 63 else None
    return [(key, c, held(d), held(inertia[c]), held(sum(inertia)), sha[c]) for (key, _), (d, c) in zip(have, at)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


def blobs(n, rng, scale=1.0):
    middles = [[rng.gauss(0, scale) for _ in range(64)] for _ in range(5)]
    return [(i, [m + rng.gauss(0, scale / 3) for m in middles[i % 5]], 0) for i in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = blobs(300, rng)
    rows += [(1000 + i, rows[7][1], 1) for i in range(80)]  # a frequent vector
    rows += [(7, rows[7][1], 0), (7, rows[8][1], 0), (None, rows[9][1], 0), (None, rows[9][1], 0)]
    rows += [(2000, None, 0), (2001, [1.0] * 63, 0), (2002, [1.0] * 65, 0), (2003, [None] + [1.0] * 63, 0), (2004, [], 0)]
    rows += [(2005, [float("nan")] * 64, 0), (2006, [float("-inf")] + [0.0] * 63, 0), (2007, [-0.0] * 64, None)]
    got = C.embeddings_query(spark.createDataFrame(rows, VECTORS).repartition(7))
    assert ordered(got.collect()) == ordered(brute(rows))


@pytest.mark.parametrize("huge", [[2.0**17], [1e15], [1e30, -1e30], [1.7e308]])
def test_large_values_stay_exact(spark, huge):
    """A distance beyond 64 bits is null; the clusters are still those of exact integers."""
    rng = random.Random(8)
    rows = blobs(30, rng, 50.0) + [(100 + i, [x] + [0.5] * 62 + [-x], 0) for i, x in enumerate(huge)]
    got = C.embeddings_query(spark.createDataFrame(rows, VECTORS))
    assert ordered(got.collect()) == ordered(brute(rows))


def test_few_or_no_rows(spark):
    assert C.embeddings_query(spark.createDataFrame([], VECTORS)).collect() == []
    assert C.embeddings_query(spark.createDataFrame([(1, None, 0), (2, [1.0], 0)], VECTORS)).collect() == []
    rows = blobs(3, random.Random(1))
    clash = [(*r, "x", "x", "x") for r in rows]
    got = C.embeddings_query(spark.createDataFrame(clash, VECTORS + ", key string, v string, cluster string"))
    assert ordered(got.collect()) == ordered(brute(rows))


@pytest.mark.parametrize("leaf", [1, 2, 5])
@pytest.mark.parametrize("spread", [2, 30, 10_000])
def test_tree_finds_the_nearest(leaf, spread):
    """Small integers make many ties; equal centroids too."""
    rng = np.random.default_rng(spread + leaf)
    middles = rng.integers(-spread, spread + 1, (41, 3))
    middles[20] = middles[4]
    rows = rng.integers(-spread - 3, spread + 4, (3000, 3))
    every = ((rows[:, None, :] - middles[None]) ** 2).sum(2)
    who, best, visits = C.Tree(middles, leaf).nearest(rows)
    assert (who == every.argmin(1)).all() and (best == every.min(1)).all()
    big = C.Tree(middles.astype(object) * 10**12, leaf)
    who, best, _ = big.nearest(rows[:200].astype(object) * 10**12)
    assert (who == every[:200].argmin(1)).all() and list(best) == [int(d) * 10**24 for d in every[:200].min(1)]


def test_bounds_prune():
    rng = np.random.default_rng(2)
    middles = rng.integers(-100_000, 100_000, (256, 2))
    rows = middles[rng.integers(0, 256, 5000)] + rng.integers(-300, 300, (5000, 2))
    tree = C.Tree(middles)
    who, _, visits = tree.nearest(rows)
    assert (who == ((rows[:, None, :] - middles[None]) ** 2).sum(2).argmin(1)).all()
    assert visits < 5000 * len(tree.nodes) / 4
