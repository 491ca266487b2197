import math
import zlib
from collections import Counter
from hashlib import md5

from parley.llm import sharding


def brute(key, weights):
    def score(k, w):
        u = (int(md5(f"{'' if key is None else key}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -w / math.log(u)

    return max((k for k, w in enumerate(weights) if w), key=lambda k: (score(k, weights[k]), -k))


def test_query_against_brute_force(edge_docs):
    got = sharding.documents_query(edge_docs).collect()
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in edge_docs.collect()]
    want = Counter((k, len(t) + 1, zlib.crc32(t), brute(k, [1] * 8), brute(k, [1] * 9)) for k, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    assert {r["law"] for r in got} == {"key"}
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_growth_moves_rows_only_into_the_new_shard(spark):
    rows = sharding.documents_query(spark.range(4000).selectExpr("id as doc_id", "'x' as text")).collect()
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 8 for r in moved)
    assert 0.08 < len(moved) / 4000 < 0.15


def test_weights_set_the_shares(spark):
    rows = sharding.assign(spark.range(8000), "id", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 8000 for r in rows}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.03


def test_many_equal_rows_get_slots_of_their_own(spark):
    rows = spark.range(9000).selectExpr("7L as doc_id", "'same' as text")
    slots = [r["slot"] for r in sharding.documents_query(rows).collect()]
    assert sorted(slots) == list(range(9000))


def test_empty_and_clashing(no_docs, clashing, edge_docs):
    assert sharding.documents_query(no_docs).count() == 0
    assert sorted(map(str, sharding.documents_query(clashing).collect())) == sorted(map(str, sharding.documents_query(edge_docs).collect()))
