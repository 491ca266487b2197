"""Joins, overlap, evaluation and alignment tables."""

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import query, same_result
from parley.operators import alignment as A
from parley.operators import dialogue as D
from parley.operators import evaluation as E
from parley.operators import spans as P
from parley.operators import utterances as U
from parley.operators.scan import positions

SCORED = S.scored_sql()
UTT_KEY = ["conv_id", "utt_idx"]


# --- joins ------------------------------------------------------------------------------------


def _pairs(t):
    return U.pair_channels(U.split_channel(t.manifest().select("name", "path", "duration_ms")))


@query(
    "jn_1_pair_channels",
    S.MAN,
    select="""
SELECT CAST(a.conv_id AS VARCHAR) AS base, a.path AS a_path, b.path AS b_path
FROM man a JOIN man b USING (conv_id) WHERE a.channel = 'A' AND b.channel = 'B'""",
)
def _(t):
    return _pairs(t)[0].select("base", "a_path", "b_path")


@query(
    "jn_1_unmatched_channels",
    S.MAN,
    select="""
SELECT CAST(conv_id AS VARCHAR) AS base, any_value(path) AS a_path FROM man
GROUP BY conv_id HAVING count(*) = 1 AND any_value(channel) = 'A'""",
)
def _(t):
    return _pairs(t)[1].select("base", "a_path")


MERGED = """
side AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY utt_idx) - 1 AS src_idx
         FROM utt),
tied AS (SELECT conv_id, speaker AS channel, src_idx, start_ms // 4000 * 4000 AS start_ms FROM side),
mrg AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, channel, src_idx) - 1
               AS utt_idx FROM tied)"""


def _merge(t, **kw):
    u = positions(t.utterances(), ["conv_id", "speaker"], ["utt_idx"], name="src_idx")
    # Rounded starts give ties between and within the channels.
    u = u.withColumn("start_ms", F.floor(F.col("start_ms") / 4000).cast("long") * 4000)
    side = lambda s: u.where(F.col("speaker") == s).select("conv_id", "src_idx", "start_ms")
    return U.merge_channels(side("A"), side("B"), **kw)


@query("jn_2_merge_channels", S.UTT, MERGED, select="SELECT * FROM mrg")
def _(t):
    return _merge(t).select("conv_id", "channel", "src_idx", "start_ms", "utt_idx")


@same_result("jn_2_hot", "jn_2_merge_channels")
def _(t):
    out = _merge(t, hot_rows=50, seg_rows=20)
    return out.select("conv_id", "channel", "src_idx", "start_ms", "utt_idx")


@query(
    "jn_2_merge_counts",
    S.UTT,
    select="""
SELECT conv_id, count(CASE WHEN speaker = 'A' THEN 1 END) AS n_a,
       count(CASE WHEN speaker = 'B' THEN 1 END) AS n_b, count(*) AS n_total
FROM utt GROUP BY 1""",
)
def _(t):
    return U.merge_counts(t.utterances().withColumnRenamed("speaker", "channel"))


@query(
    "jn_3_with_audio",
    S.MAN,
    select="SELECT conv_id, utt_idx FROM seg WHERE path IN (SELECT path FROM man)",
)
def _(t):
    return A.with_audio(t.segments(), t.manifest())[0].select("conv_id", "utt_idx")


@query(
    "jn_3_missing_audio",
    S.MAN,
    select="SELECT DISTINCT path FROM seg WHERE path NOT IN (SELECT path FROM man)",
)
def _(t):
    return A.with_audio(t.segments(), t.manifest())[1]


GRID = """
grid AS (SELECT conv_id, unnest(range(CAST(0 AS BIGINT), hi + 1, 2000)) AS span_start
         FROM (SELECT conv_id, max(end_ms) AS hi FROM utt GROUP BY 1)),
spn AS (SELECT conv_id, span_start, span_start + 2000 AS span_end FROM grid)"""


def _grid(t):
    hi = t.utterances().groupBy("conv_id").agg(F.max("end_ms").alias("hi"))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("hi"), F.lit(2000).cast("long")))
    return hi.select("conv_id", step.alias("span_start")).withColumn(
        "span_end", F.col("span_start") + 2000
    )


@query(
    "jn_5_utterances_in_span",
    S.UTT,
    GRID,
    select="""
SELECT s.conv_id, span_start, span_end, utt_idx FROM spn s JOIN utt u
  ON s.conv_id = u.conv_id AND u.end_ms >= span_start AND u.start_ms <= span_end""",
)
def _(t):
    u = t.utterances().select("conv_id", "utt_idx", "start_ms", "end_ms")
    return P.utterances_in_span(u, _grid(t)).select("conv_id", "span_start", "span_end", "utt_idx")


@query(
    "jn_5_span_text",
    S.UTT,
    GRID,
    select="""
SELECT s.conv_id, span_start, span_end, string_agg('<speaker_' || speaker || '>' || text
         || '</speaker_' || speaker || '>', '' ORDER BY utt_idx) AS text
FROM spn s JOIN utt u
  ON s.conv_id = u.conv_id AND u.end_ms >= span_start AND u.start_ms <= span_end
GROUP BY 1, 2, 3""",
)
def _(t):
    return P.span_text(t.utterances(), _grid(t))


@query(
    "jn_6_overlap_pairs",
    S.UTT,
    select="""
SELECT a.conv_id, a.utt_idx AS a_utt_idx, b.utt_idx AS b_utt_idx FROM utt a JOIN utt b
  ON a.conv_id = b.conv_id AND a.utt_idx < b.utt_idx AND a.start_ms < b.end_ms
 AND b.start_ms < a.end_ms""",
)
def _(t):
    return P.overlap_pairs(t.utterances()).select("conv_id", "a_utt_idx", "b_utt_idx")


# One line per fiftieth conversation that lasts a year, as a corrupt end time would make it.
YEAR = 31_536_000_000
LONG = f"""
utl AS (SELECT * REPLACE (CASE WHEN utt_idx = 1 AND conv_id % 50 = 0 THEN start_ms + {YEAR} ELSE end_ms END AS end_ms)
        FROM utt)"""


def _long_lines(t):
    end = F.when((F.col("utt_idx") == 1) & (F.col("conv_id") % 50 == 0), F.col("start_ms") + YEAR)
    return t.utterances().withColumn("end_ms", F.coalesce(end, F.col("end_ms")))


@query(
    "jn_5_long_interval",
    S.UTT,
    GRID,
    LONG,
    """
spl AS (SELECT * FROM spn UNION ALL SELECT DISTINCT conv_id, -5, 10000000000000 FROM spn WHERE conv_id % 70 = 0)""",
    select="""
SELECT s.conv_id, span_start, span_end, utt_idx FROM spl s JOIN utl u
  ON s.conv_id = u.conv_id AND u.end_ms >= span_start AND u.start_ms <= span_end""",
)
def _(t):
    ends = [F.lit(x).cast("long") for x in (-5, 10_000_000_000_000)]
    whole = t.utterances().where("conv_id % 70 = 0").select("conv_id").distinct()
    spans = _grid(t).select("conv_id", "span_start", "span_end").unionByName(
        whole.select("conv_id", ends[0].alias("span_start"), ends[1].alias("span_end"))
    )
    return P.utterances_in_span(_long_lines(t), spans).select("conv_id", "span_start", "span_end", "utt_idx")


@query(
    "jn_6_long_interval",
    S.UTT,
    LONG,
    select="""
SELECT a.conv_id, a.utt_idx AS a_utt_idx, b.utt_idx AS b_utt_idx FROM utl a JOIN utl b
  ON a.conv_id = b.conv_id AND a.utt_idx < b.utt_idx AND a.start_ms < b.end_ms
 AND b.start_ms < a.end_ms""",
)
def _(t):
    return P.overlap_pairs(_long_lines(t)).select("conv_id", "a_utt_idx", "b_utt_idx")


@query(
    "jn_5_span_text_events",
    S.UTT,
    S.near_sql(),
    GRID,
    select=f"""
SELECT s.conv_id, span_start, span_end, string_agg('<speaker_' || speaker || '>' || text
         || '</speaker_' || speaker || '>' || CASE WHEN is_ts THEN '<ts>' ELSE '' END
         || CASE WHEN coalesce(is_bc, false) THEN '<bc>' ELSE '' END
         || CASE WHEN is_pause THEN '<pause>' ELSE '' END
         || CASE WHEN is_silence THEN '<silence>' ELSE '' END, '' ORDER BY utt_idx) AS text
FROM spn s JOIN near u
  ON s.conv_id = u.conv_id AND u.end_ms >= span_start AND u.start_ms <= span_end
GROUP BY 1, 2, 3""",
)
def _(t):
    flags = {"ts": "is_turn_taking", "bc": "is_back_channel", "pause": "is_pause", "silence": "is_silence"}
    return P.span_text(D.annotate(t.utterances()), _grid(t), flags=flags)


# --- overlap clusters -------------------------------------------------------------------------

CLUSTERS = """
o1 AS (SELECT *, coalesce(start_ms >= max(end_ms) OVER (PARTITION BY conv_id ORDER BY start_ms, utt_idx
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens,
              row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, utt_idx) - 1 AS place FROM utt),
o2 AS (SELECT *, max(CASE WHEN opens THEN place END) OVER (PARTITION BY conv_id
              ORDER BY start_ms, utt_idx) AS cluster_id FROM o1),
o3 AS (SELECT *, count(*) OVER (PARTITION BY conv_id, cluster_id) AS size FROM o2)"""


@query(
    "wn_5_overlap_clusters",
    S.UTT,
    CLUSTERS,
    select="SELECT conv_id, utt_idx, cluster_id FROM o3 WHERE size > 1",
)
def _(t):
    return P.overlap_clusters(t.utterances()).select("conv_id", "utt_idx", "cluster_id")


@same_result("wn_5_hot", "wn_5_overlap_clusters")
def _(t):
    return P.overlap_clusters(t.utterances(), hot_rows=50, seg_rows=20).select("conv_id", "utt_idx", "cluster_id")


@query(
    "ag_6_cluster_info",
    S.UTT,
    CLUSTERS,
    select="""
SELECT conv_id, cluster_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
       max(end_ms) - min(start_ms) AS duration_ms, count(*) AS num_utts,
       string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers
FROM o3 WHERE size > 1 GROUP BY 1, 2""",
)
def _(t):
    out = P.cluster_info(P.overlap_clusters(t.utterances()))
    return out.withColumn("speakers", F.array_join("speakers", ","))


# --- evaluation -------------------------------------------------------------------------------


def _scored(t):
    return E.score(t.results())


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def scopes(body):
    """The same aggregate overall, by file and by rank."""
    parts = []
    for scope, key in (
        ("overall", "'all'"),
        ("file", "file"),
        ("rank", "coalesce(CAST(rank AS VARCHAR), 'unknown')"),
    ):
        parts.append(f"SELECT '{scope}' AS scope, {key} AS key, {body} FROM %s GROUP BY 1, 2")
    return parts


def _all_scopes(body, source="scored"):
    return " UNION ALL ".join(p % source for p in scopes(body))


R6 = lambda e: f"round({e}, 6)"
BIG = lambda c: f"CAST(sum({c}) AS BIGINT)"


@query(
    "tx_10_speaker_cer",
    S.RES,
    SCORED,
    select="""
SELECT sample_id, turn_id, CAST(edits_A AS INTEGER) AS "edits_A", CAST(edits_B AS INTEGER) AS "edits_B",
       CAST(ref_chars AS INTEGER) AS ref_chars, round(cer_A, 6) AS "cer_A",
       round(cer_B, 6) AS "cer_B", round(cer, 6) AS cer FROM scored""",
)
def _(t):
    out = E.score_cer(t.results()).select(
        "sample_id", "turn_id", "edits_A", "edits_B", "ref_chars", "cer_A", "cer_B", "cer"
    )
    return _round(out, "cer_A", "cer_B", "cer")


@query(
    "tx_12_special_token_f1",
    S.RES,
    SCORED,
    select="""
SELECT sample_id, turn_id, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp,
       CAST(fn AS INTEGER) AS fn, round("precision", 6) AS "precision", round(recall, 6) AS recall,
       round(f1, 6) AS f1 FROM scored""",
)
def _(t):
    out = E.score_special(t.results()).select(
        "sample_id", "turn_id", "tp", "fp", "fn", "precision", "recall", "f1"
    )
    return _round(out, "precision", "recall", "f1")


@query(
    "ag_2_cer_summary",
    S.RES,
    SCORED,
    select=_all_scopes(
        f"""count(*) AS turns, count(DISTINCT sample_id) AS samples,
        {BIG('edits_A')} AS "edits_A", {BIG('ref_chars_A')} AS "ref_chars_A",
        {BIG('edits_B')} AS "edits_B", {BIG('ref_chars_B')} AS "ref_chars_B",
        {R6('sum(edits_A) / greatest(sum(ref_chars_A), 1)')} AS "micro_cer_A",
        {R6('avg(cer_A)')} AS "macro_cer_A",
        {R6('sum(edits_B) / greatest(sum(ref_chars_B), 1)')} AS "micro_cer_B",
        {R6('avg(cer_B)')} AS "macro_cer_B", {BIG('edits')} AS edits,
        {BIG('ref_chars')} AS ref_chars,
        {R6('sum(edits) / greatest(sum(ref_chars), 1)')} AS micro_cer"""
    ),
)
def _(t):
    out = E.cer_summary(_scored(t))
    return _round(out, "micro_cer_A", "macro_cer_A", "micro_cer_B", "macro_cer_B", "micro_cer")


@query(
    "ag_3_f1_summary",
    S.RES,
    SCORED,
    select="SELECT scope, key, turns, tp, fp, fn, round(p, 6) AS \"precision\", round(r, 6) AS recall,"
    " round(2 * p * r / greatest(p + r, 1e-8), 6) AS f1, macro_precision, macro_recall, macro_f1"
    " FROM (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM ("
    + _all_scopes(
        f"""count(*) AS turns, {BIG('tp')} AS tp, {BIG('fp')} AS fp, {BIG('fn')} AS fn,
        {R6('avg("precision")')} AS macro_precision, {R6('avg(recall)')} AS macro_recall,
        {R6('avg(f1)')} AS macro_f1"""
    )
    + "))",
)
def _(t):
    out = E.f1_summary(_scored(t))
    return _round(
        out, "precision", "recall", "f1", "macro_precision", "macro_recall", "macro_f1"
    )


COUNTS = """
cnt AS (
  SELECT s.*, token, length(pl) - length(replace(pl, letter, '')) AS p,
         length(rl) - length(replace(rl, letter, '')) AS r
  FROM sides s, (SELECT unnest(['<ts>', '<te>', '<bc>', '<silence>', '<pause>']) AS token,
                        unnest(['s', 'e', 'b', 'l', 'p']) AS letter))"""


@query(
    "ag_4_token_counts",
    S.RES,
    SCORED,
    COUNTS,
    select="SELECT *, round(matched / greatest(pred, 1), 6) AS \"precision\","
    " round(matched / greatest(ref, 1), 6) AS recall,"
    " round(2 * (matched / greatest(pred, 1)) * (matched / greatest(ref, 1))"
    " / greatest(matched / greatest(pred, 1) + matched / greatest(ref, 1), 1e-8), 6) AS f1 FROM ("
    + _all_scopes(
        f"token, {BIG('p')} AS pred, {BIG('r')} AS ref, {BIG('least(p, r)')} AS matched", "cnt"
    ).replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3")
    + ")",
)
def _(t):
    return _round(E.token_counts(_scored(t)), "precision", "recall", "f1")


@query(
    "ag_5_cleanup_stats",
    S.RES,
    """
cleaned AS (SELECT *, length(pred) AS chars_before, length(pred) - CASE WHEN
              length(run) >= 16 THEN length(run) - 2 ELSE 0 END AS chars_after
            FROM (SELECT *, regexp_extract(pred, '((ha)+)</speaker_B>', 1) AS run FROM res))""",
    select=_all_scopes(
        f"""count(*) AS turns, count(DISTINCT sample_id) AS samples,
        {BIG('CASE WHEN chars_after <> chars_before THEN 1 ELSE 0 END')} AS changed_turns,
        {BIG('chars_before')} AS chars_before, {BIG('chars_after')} AS chars_after,
        {BIG('chars_before - chars_after')} AS chars_removed""",
        "cleaned",
    ),
)
def _(t):
    # Eight copies: no text holds them but the run at the end that the oracle looks for.
    return E.cleanup_stats(E.prepare(t.results(), min_repeats=8))


@query(
    "wn_9_worst_examples",
    S.RES,
    SCORED,
    select="""
SELECT sample_id, turn_id, round(cer, 6) AS cer, round(f1, 6) AS f1 FROM scored
ORDER BY scored.cer DESC, 1 - scored.f1 DESC, sample_id, turn_id LIMIT 10""",
)
def _(t):
    out = E.worst_examples(_scored(t), 10).select("sample_id", "turn_id", "cer", "f1")
    return _round(out, "cer", "f1")


ROUNDS = """
rnd AS (SELECT conv_id * 1000 + turn // 2 AS sample_idx, turn % 2 AS chunk_idx,
               CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS ref, replace(text, 'e', '') AS pred
        FROM conversations),
whole AS (SELECT sample_idx, string_agg(ref, '' ORDER BY chunk_idx) AS ref,
                 string_agg(pred, '' ORDER BY chunk_idx) AS pred FROM rnd GROUP BY 1)"""


@query(
    "ag_8_round_cer",
    ROUNDS,
    f"""
m AS (SELECT sample_idx, avg(CASE WHEN ref <> '' THEN {S.distance_sql("ref", "pred")} / length(ref) END) AS m,
             count(CASE WHEN ref <> '' THEN 1 END) AS scored_rounds FROM rnd GROUP BY 1)""",
    select=f"""
SELECT sample_idx, round(m, 6) AS mean_round_cer, scored_rounds,
       round({S.distance_sql("ref", "pred")} / greatest(length(ref), 1), 6) AS sample_cer
FROM m JOIN whole USING (sample_idx)""",
)
def _(t):
    return _round(E.round_cer(t.rounds()), "mean_round_cer", "sample_cer")


def _tagged_rounds(t):
    r = t.results().withColumn("sample_idx", F.col("sample_id"))
    r = r.withColumn("chunk_idx", F.col("turn_id"))
    return r.select("sample_idx", "chunk_idx", "ref", "pred")


@query(
    "ag_15_score_rounds",
    S.RES,
    SCORED,
    select="""
SELECT sample_id AS sample_idx, turn_id AS chunk_idx, round(cer, 6) AS cer, round(f1, 6) AS f1
FROM scored""",
)
def _(t):
    out = E.score_rounds(_tagged_rounds(t))[0]
    return _round(out.select("sample_idx", "chunk_idx", "cer", "f1"), "cer", "f1")


@query(
    "ag_15_score_samples",
    S.RES,
    """
joined AS (SELECT sample_id, 0 AS turn_id, string_agg(ref, '' ORDER BY turn_id) AS ref,
                  string_agg(pred, '' ORDER BY turn_id) AS pred FROM res GROUP BY 1)""",
    S.scored_sql("joined").split("lcs AS")[0].rstrip(",\n"),
    select=f"""
SELECT sample_id AS sample_idx,
       CAST({S.distance_sql("pa_", "ra_")} + {S.distance_sql("pb_", "rb_")} AS INTEGER) AS edits,
       CAST(length(ra_) + length(rb_) AS INTEGER) AS ref_chars,
       CAST(length(pl) AS INTEGER) AS n_pred, CAST(length(rl) AS INTEGER) AS n_ref FROM sides""",
)
def _(t):
    out = E.score_rounds(_tagged_rounds(t))[1]
    return out.select(
        "sample_idx",
        "edits",
        "ref_chars",
        (F.col("tp") + F.col("fp")).alias("n_pred"),
        (F.col("tp") + F.col("fn")).alias("n_ref"),
    )


# --- alignment tables -------------------------------------------------------------------------


@query(
    "prj_10_clip_plan",
    S.MAN,
    select="""
SELECT conv_id, utt_idx, CAST(round_even(lo * 22.05, 0) AS BIGINT) AS start_sample,
       CASE WHEN hi <= lo THEN least(CAST(round_even(lo * 22.05, 0) AS BIGINT) + 1,
                                     CAST(round_even(duration_ms * 22.05, 0) AS BIGINT))
            ELSE CAST(round_even(hi * 22.05, 0) AS BIGINT) END AS end_sample
FROM (SELECT s.conv_id, s.utt_idx, m.duration_ms, greatest(s.start_ms - 500, 0) AS lo,
             least(s.end_ms, m.duration_ms) AS hi FROM seg s JOIN man m USING (path))""",
)
def _(t):
    segs = t.segments().withColumn("start_ms", F.col("start_ms") - 500)
    out = A.clip_plan(segs, t.manifest(), 22050)
    return out.select("conv_id", "utt_idx", "start_sample", "end_sample")


@query(
    "prj_18_flag_alignable",
    S.MAN,
    select="""
SELECT s.conv_id, s.utt_idx, CASE WHEN s.event_id % 10 = 0 THEN 'no_text'
       WHEN s.start_ms >= m.duration_ms THEN 'past_end' ELSE 'ok' END AS alignable
FROM seg s LEFT JOIN man m USING (path)""",
)
def _(t):
    blank = F.when(F.col("event_id") % 10 == 0, "  ").otherwise(F.col("text"))
    out = A.flag_alignable(t.segments().withColumn("text", blank), t.manifest())
    return out.select("conv_id", "utt_idx", "alignable")


@query(
    "prj_19_frames_to_time",
    S.FRM,
    """
nf AS (SELECT conv_id, utt_idx, max(time_index) + 2 AS n_frames FROM frm GROUP BY 1, 2)""",
    select="""
SELECT conv_id, utt_idx, time_index, CAST(round_even(time_index * ((end_ms - start_ms) / (n_frames - 1))
         + start_ms, 0) AS BIGINT) AS time_ms
FROM frm JOIN nf USING (conv_id, utt_idx) JOIN utt USING (conv_id, utt_idx)""",
)
def _(t):
    f = t.frames()
    n = f.groupBy(*UTT_KEY).agg((F.max("time_index") + 2).alias("n_frames"))
    rows = f.join(n, UTT_KEY).join(t.utterances().select(*UTT_KEY, "start_ms", "end_ms"), UTT_KEY)
    out = A.frames_to_time(rows, "time_index")
    return out.select(*UTT_KEY, "time_index", "time_ms")


@query(
    "wn_8_fill_times",
    S.TOK,
    """
gap AS (SELECT conv_id, utt_idx, tok_idx AS idx,
               CASE WHEN (event_id + tok_idx) % 7 < 3 THEN NULL ELSE start_ms END AS v FROM tok),
near_ AS (
  SELECT a.conv_id, a.utt_idx, a.idx,
         arg_min(b.v, abs(b.idx - a.idx) * 1000 + CASE WHEN b.idx > a.idx THEN 1 ELSE 0 END) AS v
  FROM gap a LEFT JOIN gap b
    ON a.conv_id = b.conv_id AND a.utt_idx = b.utt_idx AND b.v IS NOT NULL
  GROUP BY 1, 2, 3)""",
    select="SELECT conv_id, utt_idx, idx, v AS start_ms FROM near_",
)
def _(t):
    e = F.col("event_id") + F.col("tok_idx")
    rows = t.tokens().select(
        *UTT_KEY,
        F.col("tok_idx").alias("idx"),
        F.when(e % 7 >= 3, F.col("start_ms")).alias("start_ms"),
    )
    return A.fill_times(rows, UTT_KEY, cols=["start_ms"])


CHAR_KEY = ["conv_id", "turn"]


def _words(t):
    return A.word_index(t.chars(), CHAR_KEY)


@query(
    "wn_12_word_index",
    S.CHR,
    select="SELECT conv_id, turn, char_idx, word_idx FROM wrd",
)
def _(t):
    return _words(t).select(*CHAR_KEY, "char_idx", "word_idx")


@query(
    "ag_11_rollup_words",
    S.CHR,
    select="""
SELECT * FROM (
  SELECT conv_id, turn, word_idx, trim(string_agg(char, '' ORDER BY char_idx), ' ' || chr(10)) AS word,
         min(CASE WHEN char <> ' ' THEN start_ms END) AS start_ms,
         max(CASE WHEN char <> ' ' THEN end_ms END) AS end_ms,
         round(avg(CASE WHEN char <> ' ' THEN score END), 3) AS score
  FROM wrd GROUP BY 1, 2, 3) WHERE word <> ''""",
)
def _(t):
    return A.rollup_words(_words(t), CHAR_KEY)


@query(
    "jn_9_chars_in_sentences",
    """
spn AS (SELECT conv_id, turn, n, unnest(range((n + 39) // 40)) AS span_idx
        FROM (SELECT *, length(text) AS n FROM conversations))""",
    """
chr AS (SELECT conv_id, turn, unnest(range(length(text))) AS char_idx FROM conversations)""",
    select="""
SELECT conv_id, turn, char_idx, max(span_idx) AS span_idx FROM chr LEFT JOIN spn USING (conv_id, turn)
WHERE char_idx BETWEEN span_idx * 40 AND least((span_idx + 1) * 40, n) GROUP BY 1, 2, 3""",
)
def _(t):
    n = F.length("text").cast("long")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / 40) - 1))
    spans = t.raw("conversations").select(*CHAR_KEY, n.alias("n"), k.alias("span_idx"))
    spans = spans.select(
        *CHAR_KEY,
        "span_idx",
        (F.col("span_idx") * 40).alias("span_start"),
        F.least((F.col("span_idx") + 1) * 40, F.col("n")).alias("span_end"),
    )
    chars = t.chars().select(*CHAR_KEY, "char_idx")
    return A.chars_in_sentences(chars, spans, CHAR_KEY)


@query(
    "ag_10_merge_equal_spans",
    S.TOK,
    """
snt AS (SELECT conv_id, utt_idx, tok_idx AS idx, text, tok_idx // 2 * 100 AS start_ms,
               CASE WHEN tok_idx // 2 % 3 = 2 THEN NULL ELSE tok_idx // 2 * 100 + 90 END AS end_ms
        FROM tok)""",
    select="""
SELECT conv_id, utt_idx, start_ms, end_ms, string_agg(text, '' ORDER BY idx) AS text,
       string_agg(text || '|' || text, '|' ORDER BY idx) AS words
FROM snt GROUP BY 1, 2, 3, 4""",
)
def _(t):
    half = F.floor(F.col("tok_idx") / 2).cast("long")
    rows = t.tokens().select(
        *UTT_KEY,
        F.col("tok_idx").alias("idx"),
        "text",
        F.array("text", "text").alias("words"),
        (half * 100).alias("start_ms"),
        F.when(half % 3 != 2, half * 100 + 90).alias("end_ms"),
    )
    out = A.merge_equal_spans(rows, UTT_KEY)
    return out.withColumn("words", F.array_join("words", "|"))


@query(
    "ag_12_collapse_runs",
    S.FRM,
    select="""
SELECT conv_id, utt_idx, token_index, min(time_index) AS "start", max(time_index) + 1 AS "end",
       round(avg(score), 6) AS score FROM frm GROUP BY 1, 2, 3""",
)
def _(t):
    out = A.collapse_runs(t.frames(), UTT_KEY)
    return _round(out.drop("run_idx"), "score")


MERGE_WORDS = """
run AS (SELECT conv_id, utt_idx, token_index AS run_idx, min(time_index) AS s,
               max(time_index) + 1 AS e, avg(score) AS score FROM frm GROUP BY 1, 2, 3),
lbl AS (SELECT r.*, CASE WHEN run_idx % 3 = 2 THEN '|' ELSE t.text END AS label
        FROM run r JOIN tok t ON r.conv_id = t.conv_id AND r.utt_idx = t.utt_idx
                              AND r.run_idx = t.tok_idx)"""


@query(
    "ag_13_merge_words",
    S.FRM,
    MERGE_WORDS,
    select="""
SELECT conv_id, utt_idx, run_idx // 3 AS word_idx, string_agg(label, '' ORDER BY run_idx) AS word,
       min(s) AS "start", max(e) AS "end", round(sum(score * (e - s)) / sum(e - s), 6) AS score
FROM lbl WHERE label <> '|' GROUP BY 1, 2, 3""",
)
def _(t):
    runs = A.collapse_runs(t.frames(), UTT_KEY).withColumnRenamed("token_index", "tok_idx")
    texts = t.tokens().select(*UTT_KEY, "tok_idx", "text")
    label = F.when(F.col("tok_idx") % 3 == 2, "|").otherwise(F.col("text"))
    rows = runs.join(texts, UTT_KEY + ["tok_idx"]).withColumn("label", label)
    out = A.merge_words(rows, UTT_KEY)
    return _round(out.withColumn("word_idx", F.col("word_idx").cast("long")), "score")


@query(
    "wn_10_best_rendition",
    """
pth AS (SELECT user_id, event_id, CASE
          WHEN event_id % 5 = 0 AND user_id % 3 <> 0 THEN 'audio_mp4a.40.2_' || (event_id * 37 % 90000)
          WHEN event_id % 5 = 1 AND user_id % 3 <> 0 THEN 'audio_mp4a_best'
          WHEN event_id % 5 = 2 THEN 'video_' || (event_id % 7 * 100 + 1) || 'x' || (event_id % 9 * 10 + 1) || '_avc'
          WHEN event_id % 5 = 3 THEN 'video_hd' ELSE 'cover_' || event_id END
          || '.mp4' AS name FROM events),
q AS (SELECT 'd' || user_id AS dir, 'd' || user_id || '/' || name AS path,
        CASE WHEN name LIKE 'audio%' THEN 'audio' ELSE 'video' END AS media,
        CASE WHEN name LIKE 'audio%' THEN coalesce(TRY_CAST(regexp_extract(name, '_([0-9]+).mp4$', 1) AS BIGINT), -1)
             ELSE coalesce(TRY_CAST(regexp_extract(name, '^video_([0-9]+)x', 1) AS BIGINT)
                  * TRY_CAST(regexp_extract(name, '^video_[0-9]+x([0-9]+)_', 1) AS BIGINT), -1) END AS quality
      FROM pth WHERE name NOT LIKE 'cover%')""",
    select="""
SELECT dir, media, quality, path FROM (
  SELECT *, row_number() OVER (PARTITION BY dir ORDER BY media, quality DESC, path) AS n FROM q)
WHERE n = 1""",
)
def _(t):
    e, u = F.col("event_id"), F.col("user_id")
    num = lambda c: c.cast("string")
    name = (
        F.when((e % 5 == 0) & (u % 3 != 0), F.concat(F.lit("audio_mp4a.40.2_"), num(e * 37 % 90000)))
        .when((e % 5 == 1) & (u % 3 != 0), "audio_mp4a_best")
        .when(
            e % 5 == 2,
            F.concat(
                F.lit("video_"),
                num(e % 7 * 100 + 1),
                F.lit("x"),
                num(e % 9 * 10 + 1),
                F.lit("_avc"),
            ),
        )
        .when(e % 5 == 3, "video_hd")
        .otherwise(F.concat(F.lit("cover_"), num(e)))
    )
    path = F.concat(F.lit("d"), num(u), F.lit("/"), name, F.lit(".mp4"))
    return A.best_rendition(t.raw("events").select(path.alias("path")))
