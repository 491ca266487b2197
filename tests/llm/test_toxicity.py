import math
import random
import zlib

import numpy as np
import pytest

from parley.llm import toxicity

BAD = ["idiot", "scum", "IDIOT", "méchant"]


def corpus(n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = [f"{rng.choice('abcdefg')}{rng.choice(['ing', 'tion', 'er'])}" for _ in range(rng.randrange(5, 60))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def tables(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = {r["doc_id"]: r for r in toxicity.documents_query(*tables(spark, rows, labels)).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in got.items() if r["held_out"]} == set(held)
    right = sum(got[k]["predicted"] == int(k % 4 == 0) for k in held)
    assert right / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(200)
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, q, t in labels]
    a, b = (toxicity.documents_query(*tables(spark, rows, x)).toPandas().set_index("doc_id")["score"] for x in (labels, flipped))
    assert np.allclose(a.sort_index(), b.sort_index())


def test_odd_rows(spark, clashing, no_docs):
    rows, labels = corpus(120)
    _, known = tables(spark, rows, [*labels, (None, 1, 1), (3, None, None), (5, 1, 7)])
    docs, _ = tables(spark, [*rows, (None, "idiot"), (900, None), (901, ""), (902, "idiot " * 40_000)], labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.documents_query(docs, known).collect()}
    assert len(got) == 124 and got[900] == got[901] and got[902] > 0.5
    model = toxicity.fit(docs, known)
    assert toxicity.scored(clashing, model, score="__s").columns == [*clashing.columns, "__s"]
    assert toxicity.documents_query(no_docs, known).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1), (3, 1, 1)]])
def test_one_class_or_none(spark, labels):
    docs, known = tables(spark, corpus(20)[0], labels)
    scores = {r["score"] for r in toxicity.documents_query(docs, known).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 1


def test_sample_bound(spark):
    docs, known = tables(spark, *corpus(400))
    assert toxicity.training_rows(docs, known, "doc_id", "text", "toxic", (4, 2), 50).count() < 100


def test_grams_are_those_of_each_text():
    texts = ["Ab  c", "", "É\tx", "abc"]
    got = [set() for _ in texts]
    owner, bucket = toxicity.present([t.encode() for t in texts], orders=(3, 4))
    for o, b in zip(owner, bucket):
        got[o].add(b)
    for text, found in zip(texts, got):
        low = b" " + " ".join(text.lower().replace("\t", " ").split(" ")).encode() + b" "
        while b"  " in low:
            low = low.replace(b"  ", b" ")
        alone, same = toxicity.present([low.strip(b" ")], orders=(3, 4))
        assert found == set(same)
        assert len(found) == len({low[i : i + n] for n in (3, 4) for i in range(len(low) - n + 1)})


def plain_grams(text):
    """Buckets of one text, n-gram by n-gram."""
    b = bytearray(b" " + text + b" ")
    for i, x in enumerate(b):
        b[i] = 32 if 9 <= x <= 13 else x + 32 if 65 <= x <= 90 else x
    for i in range(1, len(b)):
        if 0x80 <= b[i] <= 0x9E and b[i - 1] == 0xC3 and b[i] != 0x97:
            b[i] += 32
    while b"  " in b:
        b = bytearray(bytes(b).replace(b"  ", b" "))
    out = set()
    for n in toxicity.ORDERS:
        for i in range(len(b) - n + 1):
            h = 0
            for x in b[i : i + n]:
                h = (h * 0x100000001B3 + x + 1) % (1 << 64)
            out.add((h + n) * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - toxicity.BUCKET_BITS))
    return out


NULS = [b"good \0 day", b"\0", b"\0\0 a\0", b"", b"plain", "É\0è".encode(), b" \t A\0 \n", b"idiot\0idiot"]


def test_grams_against_brute_force():
    owner, bucket = toxicity.present(NULS)
    for k, text in enumerate(NULS):
        assert set(bucket[owner == k].tolist()) == plain_grams(text), text


def test_fit_and_scores_against_brute_force(spark):
    """Ratios from plain counts, the fit at its optimum, scores as plain sums; NULs in training and scored rows."""
    rows, labels = corpus(200)
    rows = [(k, t + ("\0 x\0" if k % 7 == 0 else "")) for k, t in rows]
    docs, known = tables(spark, rows, labels)
    model = toxicity.fit(docs, known)
    train = [(t.encode(), y) for (k, t), (_, _, y) in zip(rows, labels) if zlib.crc32(str(k).encode()) % 4 != 2]
    sets = [plain_grams(t) for t, _ in train]
    used = np.flatnonzero(model.weights)
    assert len(used) > 100
    count = {y: np.ones(1 << toxicity.BUCKET_BITS) for y in (0, 1)}
    for s, (_, y) in zip(sets, train):
        count[y][list(s)] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    w = model.weights[used] / ratio[used]
    x = np.array([[ratio[b] * (b in s) for b in used] for s in sets])
    y = np.array([y for _, y in train], float)
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert np.abs(x.T @ (p - y) + 0.3 * w).max() / len(y) < 0.02 and abs((p - y).mean()) < 0.02
    got = {r["doc_id"]: r["score"] for r in toxicity.documents_query(docs, known).collect()}
    for k, t in rows:
        z = model.intercept + sum(model.weights[b] for b in plain_grams(t.encode()))
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-9
