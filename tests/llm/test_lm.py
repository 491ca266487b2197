import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parley.llm import attention, lm


def brute(rows):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 10 == 0
    seen = Counter(w for k, t in rows if not held(k) for w in split(t))
    total = sum(seen.values())
    out = []
    for k, t in rows:
        words = split(t)
        base = sum(math.log10((seen[w] + 0.1) / (total + 0.1 * (len(seen) + 1))) for w in words)
        out.append((k, held(k), len(words), sum(seen[w] > 0 for w in words), total, round(base, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [1, 64, 1 << 17])
def test_base_against_brute_force(edge_docs, vocab, heavy):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = lm.scored(edge_docs.repartition(4), vocab, heavy=heavy, rates=(0.02,)).collect()
    names = "key held_out n_tokens n_known train_tokens".split()
    assert sorted([(*(r[c] for c in names), round(r["base_score"], 6)) for r in got], key=str) == brute(rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_no_training_text_and_clashing(spark, clashing, no_docs, vocab):
    assert lm.documents_query(no_docs, vocab).count() == 0
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    got = lm.documents_query(spark.createDataFrame([(k, "a b") for k in held], "doc_id long, text string"), vocab).collect()
    assert {(r["train_tokens"], r["n_known"], r["n_tokens"]) for r in got} == {(0, 0, 3)}
    assert lm.documents_query(clashing, vocab).count() == clashing.count()


def numbers(n, width, vocabulary):
    rng = np.random.default_rng(0)
    return vocabulary.number[rng.choice([5, 9, 2000, 77, 49407], (n, width))].astype(np.int64)


def small():
    counts = np.zeros(49408, np.int64)
    counts[[5, 9, 77, 49407]] = [50, 20, 9, 7]
    vocabulary = attention.Vocabulary(counts, 49407)
    return attention.initial(vocabulary), vocabulary


def test_gradients():
    weights, vocabulary = small()
    weights = {k: v.astype(np.float64) for k, v in weights.items()}
    some = numbers(3, attention.SPAN + 1, vocabulary)
    _, grad = attention.gradients(weights, some[:, :-1], some[:, 1:])
    for name, w in weights.items():
        at = np.unravel_index(np.abs(grad[name]).argmax(), w.shape)
        losses = []
        for step in (1e-4, -2e-4):
            w[at] += step
            losses.append(attention.gradients(weights, some[:, :-1], some[:, 1:])[0])
        w[at] += 1e-4
        assert abs((losses[0] - losses[1]) / 2e-4 - grad[name][at]) < 1e-2 * abs(grad[name][at]) + 1e-4


def test_every_token_is_scored_once_with_its_window():
    weights, vocabulary = small()
    rng = np.random.default_rng(2)
    texts = [rng.choice([5, 9, 2000, 77], n).astype(np.int32) for n in (0, 1, 15, 16, 17, 70)]
    got = attention.Scorer(weights, vocabulary)(texts)
    for text, total in zip(texts, got):
        ids = np.append(text, 49407)
        want, inputs = 0.0, np.append(vocabulary.start, vocabulary.number[ids[:-1]])
        for k, i in enumerate(ids):
            block = k // attention.FRESH * attention.FRESH
            lo = max(block - (attention.SPAN - attention.FRESH), 0)
            want += one(weights, vocabulary, inputs[lo : k + 1], i)
        assert abs(want - total) < 1e-3 * abs(want) + 1e-4


def one(w, vocabulary, inputs, target):
    """Log probability of one id, a step at a time."""
    e = w["emb"][inputs].astype(float)
    q, k = e[-1] @ w["wq"] / attention.DIM**0.5, e @ w["wk"]
    s = k @ q + w["near"][np.arange(len(inputs))[::-1]]
    p = np.exp(s - s.max())
    z = e[-1] + (p / p.sum()) @ (e @ w["wv"])
    h = z + np.maximum(z @ w["w1"] + w["b1"], 0) @ w["w2"]
    norm = lambda x: x - np.log(np.exp(x).sum())
    number = vocabulary.number[target]
    cluster = number // attention.SIZE
    value = norm(h @ w["top"] + w["top0"])[cluster] + vocabulary.log_share[target]
    if cluster < attention.CLUSTERS:
        value += norm(h @ w["in"][cluster] + w["in0"][cluster])[number % attention.SIZE]
    return value


def test_probabilities_add_up():
    weights, vocabulary = small()
    scorer = attention.Scorer(weights, vocabulary)
    first = [scorer([np.array([i], np.int32)])[0] for i in (5, 9)]
    assert all(x < 0 for x in first)
    inputs = np.array([vocabulary.start])
    assert abs(sum(math.exp(one(weights, vocabulary, inputs, i)) for i in range(49408)) - 1) < 1e-3


def test_model_learns_order(spark, vocab):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the cat sat", "on a mat"]) for _ in range(40))) for k in range(400)]
    got = lm.documents_query(spark.createDataFrame(rows, "doc_id long, text string"), vocab).filter("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_training_sees_every_token(spark, vocab, edge_docs):
    from parley.llm import wordbpe

    bpe, held = wordbpe.load(vocab), lambda k: zlib.crc32(str("" if k is None else k).encode()) % 10 == 0
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    want = Counter()
    for ids in bpe.encode([lm.lowered((t or "").encode()) for k, t in rows if not held(k)]):
        want.update([*map(int, ids), lm.END_ID])
    docs = edge_docs.repartition(3)
    got = lm.gather(docs.select("doc_id", "text"), vocab, 16, key="doc_id").collect()
    counts = sum(np.frombuffer(zlib.decompress(r["data"]), "<i8") for r in got if r["range"] == lm.IDS)
    assert {k: int(n) for k, n in enumerate(counts) if n} == dict(want)
    blobs = [r for r in got if r["range"] is None]
    targets = Counter(int(i) for r in blobs for i in lm._windows_of(r["data"])[:, 1:].ravel())
    assert not want - targets
    assert sum(targets.values()) <= sum(want.values()) + attention.SPAN * len({r["task"] for r in blobs})


def test_a_pass_takes_all_blocks():
    weights, vocabulary = small()
    blocks = [numbers(n, attention.SPAN + 1, vocabulary) for n in (40, 7, 100)]
    assert sum(map(len, attention.in_parts(blocks, most=50))) == 147
    assert attention.train(weights, iter(blocks), 0.01)[1] == 147
    assert attention.train(weights, iter([]), 0.01)[1] == 0


class Caught:
    """Stands for a data frame; gives back the function that tasks would run."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def gathered(batch, vocab, monkeypatch):
    from pyspark.sql import types as T

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(lm, "TaskContext", Task)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("text", T.StringType())])
    return lm.gather(Caught(schema), vocab, 16)(iter([batch]))


def test_memory_of_a_task_does_not_follow_its_batches(vocab, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    for _ in gathered(pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a"])], names=["key", "text"]), vocab, monkeypatch):
        pass  # loads the vocabulary
    text, peak = "the cat sat on a mat and went to sleep again " * 100, []
    for n in (1000, 5000):
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([text] * n)], names=["key", "text"])
        tracemalloc.start()
        for _ in gathered(batch, vocab, monkeypatch):
            pass
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] - peak[0] < len(text) * 1000


def test_kept_rows_hold_all_ids_and_words(vocab, monkeypatch):
    import pyarrow as pa

    from parley.llm import wordbpe
    from parley.llm.shingles import word_hashes

    monkeypatch.setattr(lm.text_chunks, "__defaults__", (60,))
    rng = random.Random(4)
    texts = [rng.choice([None, "", "a", "The cat sat", "x y " * rng.randrange(30), "d'été 日本 <b>"]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["key", "text"])
    bpe, got = wordbpe.load(vocab), {}
    for out in gathered(batch, vocab, monkeypatch):
        for r in out.to_pylist():
            if r["keys"] is None:
                continue
            ids = np.frombuffer(r["data"], "<u2")[r["skip"] :].tolist() + np.frombuffer(r["rest"], "<u2").tolist()
            u, n_words = np.frombuffer(r["distinct"], "<u8"), np.frombuffer(r["n_words"], "<i4")
            words = u[np.frombuffer(r["words"], "<u2")].tolist()
            for place, (k, n, m) in enumerate(zip(r["keys"], np.frombuffer(r["n_ids"], "<i4"), n_words)):
                assert (place >= r["known"]) == (zlib.crc32(str(k).encode()) % 10 == 0)
                got[k], ids, words = (ids[:n], words[:m]), ids[n:], words[m:]
            assert not ids and not words
    for k, t in enumerate(texts):
        t = lm.lowered((t or "").encode())
        assert got[k] == ([*bpe.encode([t])[0].tolist(), lm.END_ID], [*word_hashes([t])[0].tolist(), lm.END_WORD])


def test_arrays_used_again_hold_nothing_of_the_step_before():
    weights, vocabulary = small()
    room = attention.Room()
    for n in (40, 3, 17, 60):
        some = numbers(n, attention.SPAN + 1, vocabulary)
        got, want = (attention.gradients(weights, some[:, :-1], some[:, 1:], r) for r in (room, None))
        assert got[0] == want[0]
        assert all((got[1][k] == want[1][k]).all() for k in weights)


def test_gradients_of_extreme_weights():
    weights, vocabulary = small()
    large = {k: v * np.float32(6) for k, v in weights.items()}
    some = numbers(5, attention.SPAN + 1, vocabulary)
    _, grad = attention.gradients(large, some[:, :-1], some[:, 1:])
    _, exact = attention.gradients({k: v.astype(np.float64) for k, v in large.items()}, some[:, :-1], some[:, 1:])
    most = max(np.abs(v).max() for v in exact.values())
    assert max(np.abs(grad[k] - exact[k]).max() for k in weights) < 1e-4 * most
