import zlib
from collections import Counter

import corpus_pipeline
from parley.llm.common import materialise
from test_jaccard import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    clean = materialise(stages["toxicity"](spark, docs, SF), "t")
    assert clean.columns == columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()}
    assert gone & toxic and docs.count() - clean.count() == len(gone) < docs.count() / 4

    unique = materialise(stages["exact_dedup"](spark, clean, SF), "t")
    last = {}
    for r in clean.collect():
        last[r["text"] or ""] = max(r["doc_id"], last.get(r["text"] or "", -1))
    assert unique.columns == columns and Counter(r["doc_id"] for r in unique.collect()) == Counter(last.values())

    apart = materialise(stages["ngram_jaccard"](spark, unique, SF), "t")
    want = [k for k, _, c in components([(r["doc_id"], r["text"]) for r in unique.collect()]) if k == c]
    assert apart.columns == columns and sorted(r["doc_id"] for r in apart.collect()) == sorted(want)

    packed = stages["packing"](spark, apart, SF).collect()
    assert {r["doc_id"] for r in packed} == set(want)
    assert max(Counter(r["sequence_id"] for r in packed for _ in range(r["length"])).values()) <= 4096

    rows = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, rows)) == Counter(map(key, packed))


def test_stages_take_clashing_columns(spark, clashing):
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.columns == clashing.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    assert zlib.crc32(b"") == 0


def test_stage_rejects_what_op6_predicts(spark):
    from parley.llm import toxicity

    where = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{where}/{name}.parquet") for name in ("documents", "labels"))
    found = toxicity.documents_query(docs, labels).collect()
    assert any(0.3 <= r["score"] < 0.5 for r in found)
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, where)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in found if not r["predicted"])
