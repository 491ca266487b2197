import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from parley.llm import graph, jaccard, shingles


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(rows):
    """Counter of (key, size, component) by comparing everything with everything."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = Counter()
    for group in members.values():
        keys = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[rows[i][0], len(sets[i]), min(keys, default=None)] += 1
    return out


def shown(df):
    return Counter((r["key"], r["n_shingles"], r["component_id"]) for r in df.collect())


def families(n=12, size=14):
    """Chains of near copies in which neighbours link and distant members do not, on shared passages."""
    rng = random.Random(9)
    passage = [f"common{k}" for k in range(25)]
    rows, key = [], 1000
    for f in range(n):
        words = [f"f{f}w{rng.randrange(400)}" for _ in range(70)] + passage
        for _ in range(size):
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(70)] = f"n{rng.randrange(10**6)}"
            rows.append((key, " ".join(words)))
            key += rng.randrange(1, 5)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [1, 4, 20_000])
def test_families_against_brute_force(spark, hot):
    rows = families(6, 10)
    rows += [(5, rows[0][1]), (7, rows[0][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert shown(jaccard.grouped(docs, hot=hot, bits=12)) == brute(rows)


def test_edges_against_brute_force(edge_docs, clashing):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert shown(jaccard.grouped(edge_docs, bits=12)) == brute(rows)
    got = jaccard.documents_query(clashing)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == len(rows)


def test_a_group_of_near_copies_needs_few_pairs(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(300):
        words = list(base)
        words[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    described, counts = jaccard.described(docs, "doc_id", "text", bits=12)
    raw = jaccard.class_rows(docs, "text", counts, bits=12)
    from pyspark.sql import functions as F

    postings = raw.select("fp", "n", F.posexplode("prefix").alias("pos", "shingle"))
    pairs = jaccard.star(postings).filter("a is not null").select("a", "b").distinct().count()
    assert pairs < 3 * 300
    assert {r["component_id"] for r in jaccard.grouped(docs, bits=12).collect()} == {0}


def test_representatives(clashing):
    kept = jaccard.representatives(clashing, bits=12)
    assert kept.columns == clashing.columns
    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    found = {k: c for k, _, c in brute(rows)}
    want = {k for k, c in found.items() if k == c}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_representatives_of_rows_with_null_and_shared_keys(spark):
    words = [f"w{k}" for k in range(60)]
    near = lambda n: " ".join([*words, f"x{n}"])
    other = lambda n: " ".join(f"{n}v{k}" for k in range(60))
    rows = [(None, near(1), "a"), (5, near(2), "b"), (7, near(3), "c"), (None, other(1), "d"), (None, None, "e")]
    rows += [(9, other(2), "f"), (9, other(2) + " y", "g"), (None, other(3), "h"), (None, other(3) + " z", "i"), (11, other(4), "j"), (11, other(4), "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __lost string")
    kept = sorted(r["__lost"] for r in jaccard.representatives(df.repartition(3), bits=12).collect())
    assert [k for k in kept if k not in "fghi"] == ["b", "d", "e", "j", "k"]
    assert len([k for k in kept if k in "fg"]) == 1 and len([k for k in kept if k in "hi"]) == 1


def test_empty_table(no_docs):
    assert jaccard.documents_query(no_docs).count() == 0
    assert jaccard.representatives(no_docs).count() == 0


def test_bounds():
    for a in range(1, 60):
        assert jaccard.prefix_length(a) == a - -(-75 * a // 100) + 1
        for b in range(1, 60):
            need = next((i for i in range(min(a, b) + 1) if 100 * i >= 75 * (a + b - i)), None)
            if need is not None:
                assert jaccard.least_overlap(a, b) == need
    assert jaccard.may_link(np.array([10]), np.array([0]), np.array([10]), np.array([0]))[0]
    assert not jaccard.may_link(np.array([10]), np.array([0]), np.array([7]), np.array([0]))[0]


def test_shingle_hashes_stand_for_shingles():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a B c DD e é".split()) for _ in range(rng.randrange(12))) for _ in range(300)]
    texts += ["", " \t", "A b\x0bc\rd\fe", "a  b c d e", "x" * 5000]
    sets = shingles.all_sets([t.encode() for t in texts])
    names = {}
    for t, s in zip(texts, sets):
        want = shingle_set(t)
        assert len(s) == len(want)
        names.setdefault(want, shingles.fingerprint(s))
        assert names[want] == shingles.fingerprint(s)
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "chain": [(k, k + 1) for k in range(60)],
        "star": [(500, k) for k in range(80)],
        "random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(7, 7)],
        "none": [],
    }[shape]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got.get(node, node) == min(seen)


@pytest.mark.parametrize("size", [1 << 20, 90, 8])
def test_components_take_few_steps(spark, size, monkeypatch):
    rng = random.Random(5)
    chains = [(1000 * k + j, 1000 * k + j + 1) for k in range(4) for j in range(60)]
    edges = chains + [(9000, 9000 + k) for k in range(1, 60)]
    rng.shuffle(edges)
    steps, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: steps.append(name) or write(df, name))
    found = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5), size)
    got = sorted((r["node"], r["root"]) for r in found.collect())
    assert got == sorted((b, b // 1000 * 1000) for _, b in edges)
    if size == 1 << 20:  # one step of the tasks, one that joins what they leave
        assert steps == ["edges", "edges"]


@pytest.mark.parametrize("block", [3, 512])
def test_all_links_against_brute_force(spark, block):
    rows = families(3, 10)
    rows += [(5, rows[0][1]), (7, rows[0][1].upper()), (8, ""), (9, None)]
    base = [f"w{k}" for k in range(120)]
    rows += [(100 + k, " ".join([*base[: 5 * k], f"x{k}", *base[5 * k + 1 :]])) for k in range(20)]
    sets = {k: shingle_set(t) for k, t in rows}
    link = lambda a, b: len(a & b) > 0 and 100 * len(a & b) >= 75 * len(a | b)
    least = {}
    for k in sorted(sets):
        least.setdefault(sets[k], k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {(a, b) for x, a in least.items() for y, b in least.items() if a < b and link(x, y)}
    pairs = [tuple(sorted((r["a"], r["b"]))) for r in jaccard.link_pairs(docs, bits=12, block=block).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    got = {r["key"]: r["n_links"] for r in jaccard.grouped(docs, bits=12, block=block).collect()}
    assert got == {k: sum(k != j and link(sets[k], sets[j]) for j in sets) for k in sets}
    assert len(want) > len(least)
