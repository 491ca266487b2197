import random

import pytest
from pyspark.sql import functions as F

from parley.operators import chunks as C
from parley.operators import dialogue as D
from parley.operators import records as R
from parley.operators import spans as S
from parley.operators import utterances as U
from parley.operators.scan import neighbours
from tests import model as P

CUTS = [dict(), dict(hot_rows=4, seg_rows=3)]
REC = ("conv_id", "win_id")

# A six-line sample conversation: speaker, token times, text.
SAMPLE = [
    ("A", [7304, 7324, 7345, 7365, 7386, 7406, 7426, 7447, 7467, 7488, 7508, 8793], "よろしくお願いします。"),
    ("B", [8763, 8783, 8804, 8824, 8845, 8865, 8886, 8906, 8926, 8947, 8967, 10315], "よろしくお願いします。"),
    ("A", [12693, 12714, 12735, 13223], "最近。"),
    ("A", [13624, 13645, 13665, 13686, 13707, 13727, 13748, 13769, 13789, 13810, 14762], "たお店とかあります？"),
    ("B", [16141, 16162, 16183, 16204, 16942], "最近は。"),
    ("A", [17161, 17187, 17213, 17342], "うん。"),
]


@pytest.fixture(scope="module")
def sample(spark):
    toks = [
        (1, i, j, speaker, times[j], times[j + 1], c)
        for i, (speaker, times, text) in enumerate(SAMPLE)
        for j, c in enumerate(text)
    ]
    tokens = spark.createDataFrame(toks, P.TOK_SCHEMA)
    utts = U.utterances_from_tokens(tokens, keep=["speaker"])
    return utts.withColumn("bc_label", F.lit("non_backchannel")), tokens


def test_sample_boundaries(sample):
    utts, _ = sample
    near = neighbours(utts).orderBy("utt_idx")
    rows = near.select(D.boundary(), D.two_state_boundary(), D.prev_overlap()).collect()
    assert [r[0] for r in rows] == ["ts", "silence", "pause", None, "ts", None]
    assert [r[1] for r in rows] == ["te", "te", "te", "te", "ts", "te"]
    assert [r[2] for r in rows] == [False, True, False, False, False, False]


def test_sample_interruption(sample):
    utts, tokens = sample
    events = D.event_stream(utts, tokens).where("utt_idx = 0").orderBy("seq").collect()
    assert [e.kind for e in events].count("overlap") == 1
    cut = next(e for e in events if e.kind == "overlap")
    assert (cut.start_ms, cut.end_ms, cut.token) == (8763, 8763, "。")
    assert sum(e.kind == "asr" for e in events) == 10


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("speakers", [("A", "B"), ("A", "B", "C")])
def test_flags_and_boundaries(spark, cut, speakers):
    rows = P.conversations(5, n_conv=20, speakers=speakers)
    df = spark.createDataFrame(rows, P.UTT_SCHEMA)
    near = neighbours(df, **cut).withColumn("kind", D.boundary())
    kinds = {(r.conv_id, r.utt_idx): r.kind for r in near.collect()}
    marks = {(r.conv_id, r.utt_idx): r for r in D.annotate(df, **cut).collect()}
    for (conv,), lines in P.groups(rows, "conv_id").items():
        for i, me in enumerate(lines):
            key = (conv, me["utt_idx"])
            f = P.flags(lines, i)
            assert kinds[key] == P.boundary(lines, i)
            m = marks[key]
            assert (
                m.is_back_channel,
                m.is_turn_taking,
                m.is_pause,
                m.is_silence,
                m.is_turn_ending,
            ) == (f["bc"], f["ts"], f["pause"], f["silence"], f["te"])


@pytest.mark.parametrize("cut", CUTS)
def test_event_stream(spark, cut):
    rows = P.conversations(8, n_conv=15)
    toks = P.tokens_of(rows)
    out = D.event_stream(
        spark.createDataFrame(rows, P.UTT_SCHEMA), spark.createDataFrame(toks, P.TOK_SCHEMA), **cut
    )
    got = {}
    for e in out.orderBy("conv_id", "seq").collect():
        got.setdefault(e.conv_id, []).append((e.start_ms, e.end_ms, e.speaker, e.token, e.kind))
    for (conv,), lines in P.groups(rows, "conv_id").items():
        by_idx = {k[0]: v for k, v in P.groups([t for t in toks if t["conv_id"] == conv], "utt_idx").items()}
        assert got.get(conv, []) == P.stream(lines, by_idx)


@pytest.mark.parametrize("length,overlap", [(3, False), (2, True), (1, False)])
def test_record_windows(spark, length, overlap):
    rows = P.conversations(9, n_conv=8)
    out = R.record_windows(spark.createDataFrame(rows, P.UTT_SCHEMA), length, overlap)
    got = {}
    for r in out.collect():
        got.setdefault(r.conv_id, {}).setdefault(r.win_id, []).append(r.utt_idx)
    for (conv,), lines in P.groups(rows, "conv_id").items():
        step = 1 if overlap else length
        want = [list(range(i, i + length)) for i in range(0, len(lines) - length + 1, step)]
        have = got.get(conv, {})
        assert [sorted(have[w]) for w in sorted(have)] == want


@pytest.mark.parametrize("size,inclusive", [(2000, True), (700, True), (700, False)])
def test_chunked_conversation(spark, size, inclusive):
    rows = P.conversations(21, n_conv=12)
    toks = P.tokens_of(rows)
    utts = spark.createDataFrame(rows, P.UTT_SCHEMA)
    tokens = spark.createDataFrame(toks, P.TOK_SCHEMA)
    events = R.record_events(utts, tokens, 3)
    out = C.chunked_conversation(
        events, R.record_windows(utts, 3), chunk_ms=size, query="q", strict=not inclusive
    )
    got = {}
    for r in out.orderBy(*REC, "k").collect():
        got.setdefault((r.conv_id, r.win_id), []).append(r.text)
        assert r.query == ("q" if r.k == 1 else None)
    n_checked = 0
    for (conv,), lines in P.groups(rows, "conv_id").items():
        for w in range(len(lines) // 3):
            part = lines[w * 3 : w * 3 + 3]
            ids = {p["utt_idx"] for p in part}
            mine = [t for t in toks if t["conv_id"] == conv and t["utt_idx"] in ids]
            by_idx = {k[0]: v for k, v in P.groups(mine, "utt_idx").items()}
            ends = {}
            for p in sorted(part, key=lambda p: (p["start_ms"], p["end_ms"])):
                ends[p["speaker"]] = p["end_ms"]
            lo, hi = min(p["start_ms"] for p in part), max(ends.values())
            n = max(1, -(-(hi - lo) // size))
            texts = P.chunk_texts(P.stream(part, by_idx), lo, n, size, inclusive)
            texts = [t or " ..." for t in texts]
            while texts and (
                texts[-1] == " ..."
                or not inclusive and texts[-1] == (texts[-2] if len(texts) > 1 else "")
            ):
                texts.pop()
            assert got.get((conv, w), []) == texts
            n_checked += 1
    assert n_checked > 20


def test_late_event_holds_back_the_rest(spark):
    ev = [(1, 0, 0, 100), (1, 1, 50, 5000), (1, 2, 200, 300), (1, 3, 5100, 5200), (1, 4, 5300, 9000)]
    df = spark.createDataFrame(ev, "c long, seq long, start_ms long, end_ms long")
    df = df.withColumn("offset", F.lit(0)).withColumn("n", F.lit(4))
    for cut in (dict(), dict(split=True, hot_rows=1, seg_rows=2)):
        out = C.assign_chunks(df, ["c"], 2000, n_chunks="n", **cut).orderBy("seq").collect()
        assert [(r.seq, r.k) for r in out] == [(0, 1), (1, 3), (2, 3), (3, 3)]
    strict = C.assign_chunks(
        df.where("seq = 1").withColumn("end_ms", F.lit(4000)), ["c"], 2000, inclusive=False
    )
    assert strict.collect()[0].k == 3


@pytest.mark.parametrize("cut", CUTS)
def test_group_into_utterances(spark, cut):
    toks = P.tokens_of(P.conversations(31, n_conv=10))
    out = U.group_into_utterances(spark.createDataFrame(toks, P.TOK_SCHEMA), **cut)
    got = {(r.conv_id, r.utt_idx, r.tok_idx): r.group_idx for r in out.collect()}
    for (conv,), group in P.groups(toks, "conv_id").items():
        group = sorted(group, key=lambda t: (t["start_ms"], t["utt_idx"], t["tok_idx"]))
        n = 0
        for i, t in enumerate(group):
            if i:
                p = group[i - 1]
                n += p["speaker"] != t["speaker"] or t["start_ms"] - p["end_ms"] > 1000
            assert got[(conv, t["utt_idx"], t["tok_idx"])] == n


@pytest.mark.parametrize("cut", CUTS)
def test_overlap_clusters_and_pairs(spark, cut):
    rows = [r for r in P.conversations(41, n_conv=12) if r["end_ms"] > r["start_ms"]]
    df = spark.createDataFrame(rows, P.UTT_SCHEMA)
    got = {}
    for r in S.overlap_clusters(df, **cut).collect():
        got.setdefault((r.conv_id, r.cluster_id), set()).add(r.utt_idx)
    want = []
    for (conv,), lines in P.groups(rows, "conv_id").items():
        cluster, reach = [], None
        for u in sorted(lines, key=lambda u: (u["start_ms"], u["utt_idx"])) + [None]:
            if u and reach is not None and u["start_ms"] < reach:
                cluster.append(u["utt_idx"])
                reach = max(reach, u["end_ms"])
                continue
            if len(cluster) > 1:
                want.append((conv, frozenset(cluster)))
            if u:
                cluster, reach = [u["utt_idx"]], u["end_ms"]
    assert sorted((k[0], tuple(sorted(v))) for k, v in got.items()) == sorted(
        (c, tuple(sorted(s))) for c, s in want
    )
    info = {(r.conv_id, r.cluster_id): r for r in S.cluster_info(S.overlap_clusters(df)).collect()}
    assert all(info[k].num_utts == len(v) for k, v in got.items())

    pairs = S.overlap_pairs(df, width=500).collect()
    have = sorted((p.conv_id, p.a_utt_idx, p.b_utt_idx) for p in pairs)
    need = sorted(
        (conv, a["utt_idx"], b["utt_idx"])
        for (conv,), lines in P.groups(rows, "conv_id").items()
        for a in lines
        for b in lines
        if a["utt_idx"] < b["utt_idx"] and P.crosses(a, b)
    )
    assert have == need


def test_span_join_includes_borders(spark):
    utts = spark.createDataFrame(
        [(1, 0, 0, 1000), (1, 1, 1000, 2000), (1, 2, 2001, 90000)],
        "conv_id long, utt_idx long, start_ms long, end_ms long",
    )
    spans = spark.createDataFrame(
        [(1, 1000, 2000), (1, 50000, 50000)], "conv_id long, span_start long, span_end long"
    )
    got = S.utterances_in_span(utts, spans).collect()
    assert sorted((r.span_start, r.utt_idx) for r in got) == [(1000, 0), (1000, 1), (50000, 2)]


@pytest.mark.parametrize("cut", CUTS)
def test_merge_channels_is_stable(spark, cut):
    a = [(1, i, s) for i, s in enumerate([0, 5, 5, 9])]
    b = [(1, i, s) for i, s in enumerate([5, 5, 7])]
    mk = lambda rows: spark.createDataFrame(rows, "conv_id long, src_idx long, start_ms long")
    out = U.merge_channels(mk(a), mk(b), **cut).orderBy("utt_idx").collect()
    want = sorted([("A", i, s) for _, i, s in a] + [("B", i, s) for _, i, s in b], key=lambda r: r[2])
    assert [(r.channel, r.src_idx, r.start_ms) for r in out] == want
    assert [r.utt_idx for r in out] == list(range(7))


def lines_with_long_ones(n, seed=4):
    """Short lines of one conversation, and some of hours, days and a year; empty and reversed ones, ties."""
    rnd = random.Random(seed)
    rows = [(1, k, "AB"[k % 2], at := 2000 * k - 5000, at + rnd.choice([0, 1, 500, 2500, 30_000])) for k in range(n)]
    for k, long in enumerate([3_600_000, 7_200_000, 86_400_000, 31_536_000_000, 31_536_000_000]):
        rows.append((1, n + k, "A", 1000 * k, 1000 * k + long))
    rows += [(1, n + 10, "B", 4000, 3000), (1, n + 11, "B", 4000, 4000), (2, 0, "A", 0, 31_536_000_000), (2, 1, "A", 5, 6), (2, 2, "B", None, 7)]
    return rows


LONG = "conv_id long, utt_idx long, speaker string, start_ms long, end_ms long"


@pytest.mark.parametrize("width", [700, 10_000])
def test_interval_joins_with_lines_of_any_length(spark, width):
    rows = lines_with_long_ones(300)
    df = spark.createDataFrame(rows, LONG)
    whole = [r for r in rows if r[3] is not None]
    want = {
        (a[0], a[1], b[1])
        for a in whole
        for b in whole
        if a[0] == b[0] and a[1] < b[1] and a[3] < b[4] and b[3] < a[4]
    }
    got = [(r.conv_id, r.a_utt_idx, r.b_utt_idx) for r in S.overlap_pairs(df, width=width).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    spans = [(1, 0, 0), (1, -5000, -4000), (1, 9_999, 700_000), (1, 0, 10**11), (1, 50, 40), (2, 5, 10**9), (3, 0, 5), (None, 0, 5)]
    found = S.utterances_in_span(df, spark.createDataFrame(spans, "conv_id long, span_start long, span_end long"), width=width)
    want = sorted((c, s, e, r[1]) for c, s, e in spans for r in whole if r[0] == c and r[4] >= s and r[3] <= e)
    assert sorted((r.conv_id, r.span_start, r.span_end, r.utt_idx) for r in found.collect()) == want


def test_a_long_line_spreads_over_all_tasks(spark):
    """One conversation and a year-long line that overlaps with all others: no task has four times the median."""
    n = 400_000
    lines = spark.range(n).select(F.lit(1).alias("conv_id"), (F.col("id") * 78_000).alias("x_start"))
    lines = lines.withColumn("__last", F.col("x_start") + 1500)
    year = spark.createDataFrame([(1, 0, 31_536_000_000)], "conv_id int, x_start long, __last long")
    lines = lines.unionByName(year)
    levels = S.levels_of([(lines, "x_start", "__last")], S.BUCKET_MS)[0]
    assert len(levels) == 1
    on = ["conv_id", "__level", "__cell"]
    sent = S.probes(lines, "x_start", levels, S.BUCKET_MS).select(*on)
    index = S.indexed(lines, "x_start", "__last", S.BUCKET_MS).select(*on)
    assert sent.count() == n + 1 and S.MANY_CELLS / 2 <= index.count() <= S.MANY_CELLS
    sizes = sorted(r[1] for r in sent.unionByName(index).repartition(16, *on).groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 4 * sizes[8]
    plan = S.overlap_pairs(spark.createDataFrame(lines_with_long_ones(5), LONG))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 3 and all("__cell" in line or "__b" in line for line in joins)
