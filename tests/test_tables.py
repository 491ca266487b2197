"""Labelling, alignment and evaluation tables on small cases."""

import pytest
from pyspark.sql import functions as F

from parley.operators import alignment as A
from parley.operators import chunks as C
from parley.operators import evaluation as E
from parley.operators import labelling as L
from parley.operators import records as R


def test_labels_merge_only_on_equal_text(spark):
    utts = spark.createDataFrame(
        [(1, " はい", None), (2, "うん", None), (3, "え", None)], "id long, text string, bc_label string"
    )
    labels = spark.createDataFrame([(1, "はい ", "continuer"), (2, "ううん", "assessment")], "id long, text string, label string")
    got = {r.id: (r.bc_label, r.label_mismatch) for r in L.merge_labels(utts, labels).collect()}
    assert got == {1: ("continuer", False), 2: ("non_backchannel", True), 3: ("non_backchannel", False)}


def test_dedup_keeps_the_first_in_rank_order(spark):
    rows = [(1, 1, 0, "b"), (1, 0, 9, "a"), (2, 3, 1, "d"), (2, 3, 0, "c")]
    df = spark.createDataFrame(rows, "id long, rank long, pos long, label string")
    assert {r.id: r.label for r in L.dedup_first(df).collect()} == {1: "a", 2: "c"}


def test_classifier_batches_and_order(spark):
    def load():
        return lambda prompts: [f"{'assessment' if len(prompts) <= 2 else 'continuer'}" for p in prompts]

    df = spark.range(7).coalesce(1).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("utt_idx"), F.lit("はい").alias("text")
    )
    out = L.classify(df, load, batch_size=3).orderBy("utt_idx").collect()
    assert [r.label for r in out] == ["continuer"] * 6 + ["assessment"]


def test_split_keeps_conversations_whole_and_share(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("conv_id"))
    out = L.train_test_split(df)
    per = out.groupBy("conv_id").agg(F.count_distinct("split").alias("n"))
    assert per.where("n > 1").count() == 0
    share = out.where("split = 'train'").count() / 20000
    assert 0.76 < share < 0.84


def test_record_span_takes_last_interval_not_latest_end(spark):
    rows = [(1, 0, "A", 0, 9000), (1, 0, "A", 100, 200), (1, 0, "B", 50, 700)]
    df = spark.createDataFrame(rows, "conv_id long, win_id long, speaker string, start_ms long, end_ms long")
    r = R.record_span(df).collect()[0]
    assert (r.span_start, r.span_end, r.n_speakers) == (0, 700, 2)


def test_clip_plan_clamps(spark):
    segs = spark.createDataFrame(
        [("p", -5, 100), ("p", 900, 5000), ("p", 2000, 3000), ("p", 300, 300)],
        "path string, start_ms long, end_ms long",
    )
    man = spark.createDataFrame([("p", 1000)], "path string, duration_ms long")
    got = [(r.start_sample, r.end_sample) for r in A.clip_plan(segs, man, 16000).collect()]
    assert sorted(got) == [(0, 1600), (4800, 4801), (14400, 16000), (32000, 16000)]


def test_fill_times_nearest_then_edges(spark):
    vals = [None, 10, None, None, 40, None, None, 70, None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "g long, idx long, start_ms long")
    got = [r.start_ms for r in A.fill_times(df, ["g"], ["start_ms"]).orderBy("idx").collect()]
    assert got == [10, 10, 10, 40, 40, 40, 70, 70, 70]
    tie = spark.createDataFrame([(1, 0, 1), (1, 1, None), (1, 2, 3)], df.schema)
    assert A.fill_times(tie, ["g"], ["start_ms"]).where("idx = 1").collect()[0].start_ms == 1
    none = spark.createDataFrame([(1, 0, None)], df.schema)
    assert A.fill_times(none, ["g"], ["start_ms"]).collect()[0].start_ms is None


def test_word_index_and_rollup(spark):
    rows = [(1, i, c, None if c == "b" else i * 10, i * 10 + 5, 0.5) for i, c in enumerate("ab  cd")]
    df = spark.createDataFrame(rows, "g long, char_idx long, char string, start_ms long, end_ms long, score double")
    words = A.word_index(df, ["g"])
    got = A.rollup_words(words, ["g"]).orderBy("word_idx").collect()
    assert [(r.word, r.start_ms, r.end_ms) for r in got] == [("ab", 0, 15), ("cd", 40, 55)]
    ja = A.word_index(df, ["g"], "ja").orderBy("char_idx").collect()
    assert [r.word_idx for r in ja] == list(range(6))


def test_shared_border_goes_to_the_later_sentence(spark):
    chars = spark.createDataFrame([(1, i) for i in range(6)], "g long, char_idx long")
    spans = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 4)], "g long, span_idx long, span_start long, span_end long")
    got = A.chars_in_sentences(chars, spans, ["g"]).orderBy("char_idx").collect()
    assert [r.span_idx for r in got] == [0, 0, 1, 1, 1, None]


def test_runs_and_words(spark):
    path = [(1, t, k, s) for t, (k, s) in enumerate([(0, 1.0), (0, 0.5), (1, 0.2), (2, 0.4), (2, 0.8), (2, 0.6)])]
    runs = A.collapse_runs(spark.createDataFrame(path, "g long, time_index long, token_index long, score double"), ["g"])
    got = runs.orderBy("run_idx").collect()
    assert [(r.token_index, r.start, r.end, round(r.score, 3)) for r in got] == [(0, 0, 2, 0.75), (1, 2, 3, 0.2), (2, 3, 6, 0.6)]
    seg = [(1, 1, "a", 0, 2, 1.0), (1, 2, "b", 2, 3, 0.4), (1, 3, "|", 3, 4, 0.0), (1, 4, "|", 4, 5, 0.0), (1, 5, "c", 5, 6, 0.9)]
    df = spark.createDataFrame(seg, "g long, run_idx long, label string, start long, end long, score double")
    words = A.merge_words(df, ["g"]).orderBy("start").collect()
    assert [(w.word, w.start, w.end, round(w.score, 6)) for w in words] == [("ab", 0, 3, 0.8), ("c", 5, 6, 0.9)]


def test_equal_spans_with_null_times(spark):
    rows = [(1, 0, "a", ["x"], 1, 2), (1, 1, "b", ["y"], 1, 2), (1, 2, "c", ["z"], None, None)]
    df = spark.createDataFrame(rows, "g long, idx long, text string, words array<string>, start_ms long, end_ms long")
    got = {r.text: r.words for r in A.merge_equal_spans(df, ["g"], "en").collect()}
    assert got == {"a b": ["x", "y"], "c": ["z"]}


def test_chunk_plan_stops_with_the_shorter_channel(spark):
    df = spark.createDataFrame([("x", 5200, 3500), ("y", 2000, 9000), ("z", 0, 5)], "base string, a_duration_ms long, b_duration_ms long")
    got = C.chunk_plan(df, 3000, 1000).orderBy("base", "chunk_idx").collect()
    assert [(r.base, r.start_ms, r.end_ms, r.label) for r in got] == [
        ("x", 0, 3000, "Time=0.0-3.0s"),
        ("x", 3000, 4000, "Time=3.0-4.0s"),
        ("y", 0, 2000, "Time=0.0-2.0s"),
    ]


def test_best_rendition(spark):
    names = ["a/audio_1_500.mp4", "a/audio_x_900.mp4", "a/video_9x9_z.mp4", "b/video_2x3_q.mp4", "b/video_hd.mp4", "c/audio_best.mp4", "d/note.txt"]
    got = {r.dir: (r.path, r.quality) for r in A.best_rendition(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {"a": ("a/audio_x_900.mp4", 900), "b": ("b/video_2x3_q.mp4", 6), "c": ("c/audio_best.mp4", -1)}


def test_rounds_with_nested_results(spark):
    rows = [(1, 0, [(1, "cd", "cx"), (0, "ab", "ab"), (2, "", "zz")])]
    df = spark.createDataFrame(rows, "sample_idx long, rank long, rounds array<struct<chunk_idx:int,ref:string,pred:string>>")
    flat = E.explode_rounds(df)
    r = E.round_cer(flat).collect()[0]
    assert (r.mean_round_cer, r.scored_rounds, r.sample_cer) == (0.25, 2, 0.75)


def test_context_windows(spark):
    rows = [(1, 0, 0, "A", 0, 10, "a"), (1, 0, 1, "B", 5, 4, "b"), (1, 0, 2, "A", 20, 30, "c")]
    df = spark.createDataFrame(rows, "conv_id long, win_id long, utt_idx long, speaker string, start_ms long, end_ms long, text string")
    got = R.context_windows(df, 2).orderBy("ctx_id").collect()
    assert [(r.ctx_id, r.span_start, r.span_end, [m.utt_idx for m in r.members]) for r in got] == [
        (0, 0, 4, [0, 1]),
        (1, 5, 30, [1, 2]),
    ]
    single = R.context_windows(df, 1, other_channel=False).orderBy("ctx_id").collect()
    assert [r.channel for r in single] == ["A", "B", "A"]


@pytest.mark.parametrize("k", [0, 2])
def test_summary_document(spark, k):
    rows = [(1, 0, None, "f1", "<speaker_A>a</speaker_A><ts>", "<speaker_A>ab</speaker_A><ts>"), (1, 1, 0, "f2", "", "<te>")]
    df = spark.createDataFrame(rows, "sample_id long, turn_id long, rank long, file string, pred string, ref string")
    scored = E.score(E.prepare(df))
    doc = E.summary_document(scored, k)
    assert doc.where("section = 'worst_examples'").count() == k
    cer = E.cer_summary(scored).where("scope = 'overall'").collect()[0]
    assert (cer.turns, cer.samples, cer.edits, cer.ref_chars) == (2, 1, 1, 2)
    f1 = {(r.scope, r.key): r for r in E.f1_summary(scored).collect()}
    assert (f1[("overall", "all")].tp, f1[("overall", "all")].fn) == (1, 1)
    assert set(f1) == {("overall", "all"), ("file", "f1"), ("file", "f2"), ("rank", "unknown"), ("rank", "0")}
