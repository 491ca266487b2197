"""What has to hold on tables of any size: plans, task sizes, files."""

import random

from checks import load
from parley.operators import alignment as A
from parley.operators import spans as P
from parley.sources import readers


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_broadcast(spark):
    """The sides look tiny before they are cut into cells."""
    utts = spark.createDataFrame([(1, 0, 5, 9_000_000_000), (1, 1, 20, 30)], "conv_id long, utt_idx long, start_ms long, end_ms long")
    spans = spark.createDataFrame([(1, -5, 10**13), (1, 0, 10)], "conv_id long, span_start long, span_end long")
    out = P.utterances_in_span(utts, spans)
    assert "BroadcastHashJoin" not in plan_of(out)
    assert sorted((r.span_start, r.utt_idx) for r in out.collect()) == [(-5, 0), (-5, 1), (0, 0)]


def test_sentences_of_characters(spark):
    rng = random.Random(5)
    spans = [(g, k, a, a + rng.randrange(-3, 200)) for g in range(3) for k, a in enumerate(rng.choices(range(-100, 400), k=40))]
    spans += [(0, 99, None, 5), (1, 98, 5, None), (2, None, 0, 400)]
    chars = [(g, i, "x") for g in (0, 1, 2, 7) for i in range(-10, 420)]
    df = A.chars_in_sentences(
        spark.createDataFrame(chars, "g long, char_idx long, char string"),
        spark.createDataFrame(spans, "g long, span_idx long, span_start long, span_end long"),
        ["g"],
    )
    assert "BroadcastHashJoin" not in plan_of(df)
    whole = [s for s in spans if None not in s]
    want = [(g, i, "x", max((k for h, k, a, b in whole if h == g and min(a, b) <= i <= max(a, b)), default=None)) for g, i, _ in chars]
    assert df.columns == ["g", "char_idx", "char", "span_idx"]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_files_are_read_once(spark, tmp_path):
    """What numbers, counts and filters lines scans a table, not the files again and again."""
    (tmp_path / "a.jsonl").write_text('{"text": "a"}\n[0]\n')
    path = str(tmp_path)
    for lines in (readers.read_lines(spark, path), readers.read_lines(spark, path, footer=True), readers.record_texts(spark, path)):
        assert "FileScan text" not in plan_of(lines) and lines.count() in (1, 2)
    assert "FileScan json" not in plan_of(readers.read_segments_jsonl(spark, path, "*.none"))


def test_label_files_hold_many_ids(spark):
    labels = load()[0]["src_7_read_labels"](spark, "/root/testdata/sf0.01")
    assert len(labels.inputFiles()) <= 8
