import math
import random
import re
from itertools import permutations

import pytest

from parley.llm import filteraudit as A
from tests.llm.conftest import edge_rows

LABELS = "doc_id long, quality int, toxic int"
FIELDS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text, key, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": key is not None and first is not None and key > first,
    }


def brute(docs, labels):
    good, toxic = ({k for k, *v in labels if k is not None and v[i] == 1} for i in (0, 1))
    first = {}
    for key, text, *_ in docs:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    parts = {}
    for key, text, _, source, _ in docs:
        text = text or ""
        parts.setdefault(source or "", []).append((key, fails(text, key, first.get(text))))
    out = {}
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                go = [r for r in left if r[1][f]]
                stay = [r for r in left if not r[1][f]]
                bad = [r for r in rows if r[1][f]]
                out[part, "".join(order), step] = [
                    len(stay),
                    len(go),
                    len(bad) - len(go),
                    sum(sum(r[1].values()) == 1 for r in bad),
                    sum(r[0] in good for r in go),
                    sum(r[0] in toxic for r in go),
                ]
                left = stay
    sums = {}
    for (part, order, step), v in out.items():
        at = part, order[step - 1]
        sums[at] = sums.get(at, 0) + v[1]
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in FIELDS) for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        n = rng.choice([10, 49, 50, 80])
        words = [rng.choice(["a", "Bb", "CDE", "f%", "g", "h"]) + str(rng.randrange(rng.choice([3, 500]))) for _ in range(n)]
        texts.append(" ".join(w.lower() if rng.random() < 0.7 else w for w in words))
    docs = [(k, texts[min(int(rng.expovariate(0.05)), 59)], "en", rng.choice(["x", "y", "", None]), 1) for k in range(600)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 700, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found(A.documents_query(df, spark.createDataFrame(labels, LABELS))) == brute(docs, labels)


def test_odd_rows(spark, edge_docs, clashing, no_docs):
    labels = [(1, 1, 0), (13, 0, 1), (13, 1, 0), (None, 1, 1), (3, None, None), (6, 1, 1), (999, 1, 1)]
    known = spark.createDataFrame(labels, LABELS)
    got = found(A.documents_query(edge_docs, known))
    assert got == brute(edge_rows(), labels)
    assert found(A.documents_query(clashing, known)) == got
    assert found(A.documents_query(edge_docs, known.limit(0))) == brute(edge_rows(), [])
    assert A.documents_query(no_docs, known).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_paths_through_the_lattice(n):
    edges = A.lattice(n)
    assert len(edges) == n << (n - 1)
    for f in range(n):
        assert sum(w for _, g, w in edges if g == f) == math.factorial(n)
    for s, _, w in edges:
        done = s.bit_count()
        assert w == math.factorial(done) * math.factorial(n - done - 1)


def test_other_numbers_of_filters(spark):
    masks = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 0, 1), ("p", 3, 1, 1, 0), ("q", 1, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = found(A.audit(masks, "XY"))
    assert got["p", "XY", 1] == (5, 3, 0, 0, 1, 1, 3) and got["p", "XY", 2] == (5, 0, 3, 0, 0, 0, 3)
    assert got["q", "YX", 1] == (4, 0, 0, 0, 0, 0, 0) and got["q", "YX", 2] == (0, 4, 0, 4, 0, 0, 8)
    assert len(got) == 8
