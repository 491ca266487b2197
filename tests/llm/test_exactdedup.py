from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from parley.llm import exactdedup


def brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[sha256((text or "").encode()).hexdigest()].append(key)
    out = Counter()
    for digest, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        first = True
        for k in sorted(keys, key=lambda k: (k != keep, str(k))):
            out[k, keep, len(keys), first, digest] += 1
            first = False
    return out


def shown(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


@pytest.mark.parametrize("counters", [1, 3, 2048])
def test_query_against_brute_force(edge_docs, counters):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert shown(exactdedup.documents_query(edge_docs, counters)) == brute(rows)


def test_hot_digest(spark):
    rows = [(k, "hot" if k % 3 else str(k)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert shown(exactdedup.documents_query(docs, 4)) == brute(rows)
    heavy = exactdedup.verified(exactdedup.with_digest(docs), 4).collect()
    assert [(r["keep_id"], r["group_size"]) for r in heavy] == [(2999, 2000)]


def test_misra_gries_bound():
    held = exactdedup.misra_gries(({x: 1} for x in "aababcaadaaeafaa"), 2)
    assert len(held) <= 2 and "a" in held


@pytest.mark.parametrize("counters", [1, 2048])
def test_rows_that_stay(clashing, counters):
    kept = exactdedup.deduplicated(clashing, counters=counters)
    assert kept.columns == clashing.columns
    want = Counter((k, d) for (k, _, _, stays, d), n in brute([(r["doc_id"], r["text"]) for r in clashing.collect()]).items() if stays for _ in range(n))
    got = Counter((r["doc_id"], sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect())
    assert got == want


def test_empty(no_docs):
    assert exactdedup.documents_query(no_docs).count() == 0
    assert exactdedup.deduplicated(no_docs).count() == 0


def test_columns_of_the_operators_own_names(spark):
    rows = [(1, "a", "x", 1, 1), (2, "a", "y", 2, 2), (3, "b", "z", 3, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __digest string, __keep long, __size long")
    got = exactdedup.deduplicated(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[1], rows[2]]
