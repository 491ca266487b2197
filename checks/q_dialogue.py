"""Windows, dialogue state, records and chunks."""

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import query, same_result
from parley.functions import text as X
from parley.operators import chunks as C
from parley.operators import dialogue as D
from parley.operators import records as R
from parley.operators.scan import neighbours, positions
from parley.operators.utterances import (
    group_into_utterances,
    pair_channels,
    split_channel,
    utterances_from_tokens,
)

REC = ("conv_id", "win_id")
NEAR = S.near_sql()
WIN3 = S.windows_sql(3)
NEAR3 = S.near_sql("win", REC)


def _mate(which, *cols):
    return [F.col(f"{which}.{c}").alias(f"{which}_{c}") for c in cols]


# --- windows ----------------------------------------------------------------------------------


@query(
    "wn_1_group_into_utterances",
    S.TOK,
    """
g AS (SELECT *, coalesce(speaker <> lag(speaker) OVER w OR start_ms - lag(end_ms) OVER w > 1000,
                         false) AS fresh
      FROM tok WINDOW w AS (PARTITION BY conv_id ORDER BY start_ms, utt_idx, tok_idx)),
h AS (SELECT *, CAST(sum(CAST(fresh AS BIGINT)) OVER (PARTITION BY conv_id
               ORDER BY start_ms, utt_idx, tok_idx) AS BIGINT) AS group_idx FROM g)""",
    select="""
SELECT conv_id, group_idx, any_value(speaker) AS speaker, min(start_ms) AS start_ms,
       count(*) AS n_tokens, string_agg(text, '' ORDER BY start_ms, utt_idx, tok_idx) AS text
FROM h GROUP BY conv_id, group_idx""",
)
def _(t):
    return _grouped(t)


#: Limits that make hot keys of ordinary conversations, to be cut into segments of some twenty rows.
HOT = dict(hot_rows=50, seg_rows=20)


@same_result("wn_1_hot", "wn_1_group_into_utterances")
def _(t):
    return _grouped(t, **HOT)


def _grouped(t, **kw):
    g = group_into_utterances(t.tokens(), **kw)
    words = F.sort_array(F.collect_list(F.struct("start_ms", "utt_idx", "tok_idx", "text")))
    return g.groupBy("conv_id", "group_idx").agg(
        F.first("speaker").alias("speaker"),
        F.min("start_ms").alias("start_ms"),
        F.count(F.lit(1)).alias("n_tokens"),
        F.array_join(F.transform(words, lambda w: w["text"]), "").alias("text"),
    )


@query(
    "wn_2_next_same_speaker",
    S.UTT,
    select="""
SELECT conv_id, utt_idx, lead(utt_idx) OVER w AS next_same_utt_idx,
       lead(start_ms) OVER w AS next_same_start_ms
FROM utt WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY utt_idx)""",
)
def _(t):
    n = neighbours(t.utterances())
    return n.select("conv_id", "utt_idx", *_mate("next_same", "utt_idx", "start_ms"))


@query(
    "wn_3_next_other_speaker",
    S.UTT,
    NEAR,
    select="""
SELECT conv_id, utt_idx, other_idx AS next_other_utt_idx, other_start AS next_other_start_ms,
       other_end AS next_other_end_ms FROM near""",
)
def _(t):
    n = neighbours(t.utterances())
    return n.select("conv_id", "utt_idx", *_mate("next_other", "utt_idx", "start_ms", "end_ms"))


@query(
    "wn_4_interruption",
    S.UTT,
    NEAR,
    select="SELECT conv_id, utt_idx, cut_all, cut_ms FROM near",
)
def _(t):
    n = neighbours(t.utterances())
    out = D.with_interruption(n, parity=True)
    return out.select("conv_id", "utt_idx", D.interruption().alias("cut_all"), "cut_ms")


@query(
    "wn_6_record_windows_tumbling",
    S.UTT,
    WIN3,
    select="SELECT conv_id, win_id, utt_idx, start_ms FROM win",
)
def _(t):
    return R.record_windows(t.utterances(), 3).select("conv_id", "win_id", "utt_idx", "start_ms")


@query(
    "wn_6_record_windows_sliding",
    S.UTT,
    S.windows_sql(3, True),
    select="SELECT conv_id, win_id, utt_idx, start_ms FROM win",
)
def _(t):
    out = R.record_windows(t.utterances(), 3, overlap=True)
    return out.select("conv_id", "win_id", "utt_idx", "start_ms")


@query(
    "wn_7_context_windows",
    S.UTT,
    S.windows_sql(6),
    select="""
SELECT conv_id, win_id, ctx_id, span_start, span_end, members FROM (
  SELECT conv_id, win_id, row_number() OVER w - 1 AS ctx_id, start_ms AS span_start,
         lead(end_ms) OVER w AS span_end,
         CAST(utt_idx AS VARCHAR) || ',' || CAST(lead(utt_idx) OVER w AS VARCHAR) AS members
  FROM win WINDOW w AS (PARTITION BY conv_id, win_id ORDER BY start_ms, end_ms, utt_idx))
WHERE span_end > span_start""",
)
def _(t):
    wins = R.record_windows(t.utterances(), 6)
    return R.context_windows(wins, 2).withColumn(
        "members", F.array_join(F.col("members.utt_idx").cast("array<string>"), ",")
    )


@query(
    "wn_7_single_line_contexts",
    S.UTT,
    S.windows_sql(6),
    select="""
SELECT conv_id, win_id, speaker AS channel, start_ms AS span_start, end_ms AS span_end,
       row_number() OVER (PARTITION BY conv_id, win_id ORDER BY start_ms, end_ms, utt_idx) - 1
         AS ctx_id
FROM win""",
)
def _(t):
    wins = R.record_windows(t.utterances(), 6)
    return R.context_windows(wins, 1, other_channel=False).drop("members")


@query(
    "wn_11_previous_overlap",
    S.UTT,
    select="""
SELECT conv_id, utt_idx,
       coalesce(speaker <> lag(speaker) OVER w AND lag(start_ms) OVER w < end_ms
                AND start_ms < lag(end_ms) OVER w, false) AS is_turn_taking
FROM utt WINDOW w AS (PARTITION BY conv_id ORDER BY utt_idx)""",
)
def _(t):
    n = neighbours(t.utterances())
    return n.select("conv_id", "utt_idx", D.prev_overlap().alias("is_turn_taking"))


# --- dialogue state ---------------------------------------------------------------------------


def _flag(name, column, flag, where=""):
    @query(
        name,
        S.UTT,
        NEAR,
        select=f"SELECT conv_id, utt_idx, {flag} AS flag FROM near{where}",
    )
    def _(t):
        return neighbours(t.utterances()).select("conv_id", "utt_idx", column().alias("flag"))


_flag("ds_1_backchannel", D.backchannel, "is_bc")
_flag("ds_2_turn_switch", D.turn_switch, "is_ts")
_flag("ds_3_pause", D.pause, "is_pause")
_flag("ds_4_silence", D.silence, "is_silence")
_flag("ds_6_turn_end", D.turn_end, "is_te")


@query(
    "ds_1_backchannel_unlabelled",
    S.UTT,
    ",".join(["""
blank AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS bc_label) FROM utt)""", S.near_sql("blank")]),
    select="SELECT conv_id, utt_idx, coalesce(is_bc, false) AS flag FROM near",
)
def _(t):
    u = t.utterances().withColumn("bc_label", F.lit(None).cast("string"))
    return neighbours(u).select("conv_id", "utt_idx", D.backchannel().alias("flag"))


@query(
    "ds_5_semantic_completion",
    S.UTT,
    NEAR,
    select="SELECT conv_id, utt_idx, complete AS flag FROM near",
)
def _(t):
    return t.utterances().select("conv_id", "utt_idx", X.is_complete("text").alias("flag"))


@query(
    "ds_7_boundary_event",
    S.UTT,
    NEAR,
    select=f"SELECT conv_id, utt_idx, end_ms, {S.BOUNDARY} AS kind FROM near",
)
def _(t):
    n = neighbours(t.utterances())
    return n.select("conv_id", "utt_idx", "end_ms", D.boundary().alias("kind"))


@query(
    "ds_7_boundary_counts",
    S.UTT,
    NEAR,
    select=f"""
SELECT coalesce({S.BOUNDARY}, 'none') AS kind, count(*) AS n, CAST(sum(end_ms) AS BIGINT) AS sum_end
FROM near GROUP BY 1""",
)
def boundary_counts(t):
    n = neighbours(t.utterances()).withColumn("kind", F.coalesce(D.boundary(), F.lit("none")))
    return n.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("end_ms").alias("sum_end")
    )


EVT = S.events_sql()


@query(
    "ds_8_token_events",
    S.TOK,
    NEAR,
    EVT,
    select="""
SELECT conv_id, utt_idx, CAST(tok_idx AS BIGINT) AS tok_idx, start_ms, end_ms, speaker, token, kind
FROM evt WHERE kind IN ('asr', 'overlap')""",
)
def _(t):
    u = D.with_interruption(neighbours(t.utterances()))
    return D.token_events(u, t.tokens()).drop("is_boundary")


@query(
    "ds_9_event_stream",
    S.TOK,
    NEAR,
    EVT,
    select="SELECT conv_id, seq, start_ms, end_ms, speaker, token, kind FROM evt",
)
def _(t):
    out = D.event_stream(t.utterances(), t.tokens())
    return out.select("conv_id", "seq", "start_ms", "end_ms", "speaker", "token", "kind")


@same_result("ds_9_hot", "ds_9_event_stream")
def _(t):
    out = D.event_stream(t.utterances(), t.tokens(), **HOT)
    return out.select("conv_id", "seq", "start_ms", "end_ms", "speaker", "token", "kind")


FLAG_SQL = (
    "is_ts AS is_turn_taking, is_pause, is_silence, coalesce(is_bc, false) AS is_back_channel, "
    "is_te AS is_turn_ending"
)


@query(
    "ds_10_utterance_flags",
    S.UTT,
    NEAR,
    select=f"SELECT conv_id, utt_idx, {FLAG_SQL} FROM near",
)
def _(t):
    return D.annotate(t.utterances()).select("conv_id", "utt_idx", *D.FLAGS)


@query(
    "ds_10_four_flags",
    S.UTT,
    WIN3,
    NEAR3,
    select=f"SELECT conv_id, win_id, utt_idx, {FLAG_SQL.replace(', is_te AS is_turn_ending', '')} FROM near",
)
def _(t):
    wins = R.record_windows(t.utterances(), 3)
    out = D.annotate(wins, REC, split=False, turn_ending=False)
    return out.select(*REC, "utt_idx", *[f for f in D.FLAGS if f != "is_turn_ending"])


@query(
    "ds_11_two_state_stream",
    S.TOK,
    NEAR,
    S.two_state_sql(),
    select="SELECT conv_id, seq, start_ms, end_ms, speaker, token, kind FROM evt",
)
def _(t):
    return _two_state(t)


@same_result("ds_11_hot", "ds_11_two_state_stream")
def _(t):
    return _two_state(t, **HOT)


def _two_state(t, **kw):
    out = D.two_state_stream(t.utterances(), t.tokens(), **kw)
    return out.select("conv_id", "seq", "start_ms", "end_ms", "speaker", "token", "kind")


EVT3 = S.events_sql(REC)
REC_UTTS = """
(SELECT conv_id, win_id, string_agg(concat_ws('|', utt_idx, speaker, start_ms, end_ms, text,
   is_ts, is_pause, is_silence, coalesce(is_bc, false), is_te), ';' ORDER BY utt_idx) AS utterances
 FROM near GROUP BY 1, 2)"""
REC_STREAM = """
(SELECT conv_id, win_id, string_agg(concat_ws('|', seq, start_ms, end_ms, speaker, token, kind),
   ';' ORDER BY seq) AS stream FROM evt GROUP BY 1, 2)"""


def _flat(array):
    item = F.transform(array, lambda s: F.concat_ws("|", s["utt_idx"], s["speaker"], s["start_ms"], s["end_ms"], s["text"], *[s[f].cast("string") for f in D.FLAGS]))
    return F.array_join(item, ";")


def _flat_stream(array):
    item = F.transform(
        array,
        lambda s: F.concat_ws(
            "|", s["seq"], s["start_ms"], s["end_ms"], s["speaker"], s["token"], s["kind"]
        ),
    )
    return F.array_join(item, ";")


@query(
    "ds_12_dialogue_records",
    S.TOK,
    WIN3,
    NEAR3,
    EVT3,
    select=f"SELECT * FROM {REC_UTTS} JOIN {REC_STREAM} USING (conv_id, win_id)",
)
def _(t):
    out = R.dialogue_records(t.utterances(), t.tokens(), 3)
    return out.select(
        *REC,
        _flat(F.col("utterances")).alias("utterances"),
        _flat_stream(F.col("stream")).alias("stream"),
    )


@query(
    "ds_12_sliding_record_events",
    S.TOK,
    S.windows_sql(2, True),
    NEAR3,
    EVT3,
    select="SELECT conv_id, win_id, seq, start_ms, end_ms, speaker, token, kind FROM evt",
)
def _(t):
    out = R.record_events(t.utterances(), t.tokens(), 2, overlap=True)
    return out.select(*REC, "seq", "start_ms", "end_ms", "speaker", "token", "kind")


# --- utterances and tagged text ---------------------------------------------------------------


@query(
    "prj_2_utterances_from_tokens",
    S.TOK,
    select="""
SELECT conv_id, utt_idx, min(start_ms) AS start_ms, arg_max(end_ms, tok_idx) AS end_ms,
       count(*) AS n_tokens, string_agg(text, '' ORDER BY tok_idx) AS text
FROM tok GROUP BY 1, 2""",
)
def _(t):
    return utterances_from_tokens(t.tokens())


TAGGED = """
'<speaker_' || speaker || '>' || text || '</speaker_' || speaker || '>'"""


@query(
    "prj_11_tag_utterance",
    S.UTT,
    WIN3,
    NEAR3,
    select=f"""
SELECT conv_id, win_id, utt_idx, {TAGGED}
       || CASE WHEN is_ts THEN '<ts>' ELSE '' END || CASE WHEN is_bc THEN '<bc>' ELSE '' END
       || CASE WHEN is_pause THEN '<pause>' ELSE '' END
       || CASE WHEN is_silence THEN '<silence>' ELSE '' END
       || CASE WHEN is_te THEN '<te>' ELSE '' END AS tagged
FROM near""",
)
def _(t):
    out = R.record_utterances(t.utterances(), 3)
    return R.tagged_utterances(out).select(*REC, "utt_idx", "tagged")


@query(
    "prj_11_tag_utterance_plain",
    S.UTT,
    select=f"SELECT conv_id, utt_idx, {TAGGED} AS tagged FROM utt",
)
def _(t):
    out = R.tagged_utterances(t.utterances(), tags=False)
    return out.select("conv_id", "utt_idx", "tagged")


# --- chunks -----------------------------------------------------------------------------------


def _events(t, two_state=False):
    u = t.utterances()
    wins = R.record_windows(u, 3)
    if not two_state:
        return R.record_events(u, t.tokens(), 3), wins
    return D.two_state_stream(wins, t.tokens(), REC, split=False), wins


TWO3 = S.two_state_sql(REC)


@query(
    "jn_7_event_chunks",
    S.TOK,
    WIN3,
    NEAR3,
    EVT3,
    S.placed_sql(REC),
    select="SELECT conv_id, win_id, seq, k FROM placed",
)
def _(t):
    events, wins = _events(t)
    grid = C.with_grid(events, wins, REC, 2000)
    return C.assign_chunks(grid, REC, 2000, n_chunks="n_chunks").select(*REC, "seq", "k")


@query(
    "jn_7_event_chunks_strict",
    S.TOK,
    WIN3,
    NEAR3,
    TWO3,
    S.placed_sql(REC, inclusive=False, chunk=500),
    select="SELECT conv_id, win_id, seq, k FROM placed",
)
def _(t):
    events, wins = _events(t, True)
    grid = C.with_grid(events, wins, REC, 500)
    out = C.assign_chunks(grid, REC, 500, inclusive=False, n_chunks="n_chunks")
    return out.select(*REC, "seq", "k")


@query(
    "jn_7_conversation_chunks",
    S.TOK,
    NEAR,
    EVT,
    S.placed_sql(("conv_id",), src="utt"),
    select="SELECT conv_id, seq, k FROM placed",
)
def _(t):
    by = ["conv_id"]
    toks = t.tokens()
    events = D.event_stream(t.utterances(), toks)
    grid = C.with_grid(events, t.utterances(), by, 2000, split=True, stats=toks)
    out = C.assign_chunks(grid, by, 2000, n_chunks="n_chunks", split=True, stats=toks)
    return out.select("conv_id", "seq", "k")


@query(
    "tx_16_chunk_text",
    S.TOK,
    WIN3,
    NEAR3,
    EVT3,
    S.placed_sql(REC),
    S.text_sql(REC),
    select="SELECT conv_id, win_id, k, text FROM txt",
)
def _(t):
    events, wins = _events(t)
    placed = C.assign_chunks(C.with_grid(events, wins, REC, 2000), REC, 2000, n_chunks="n_chunks")
    return C.chunk_text(placed, REC).where("text <> ''")


@query(
    "tx_17_training_text",
    S.TOK,
    WIN3,
    NEAR3,
    TWO3,
    select="""
SELECT conv_id, win_id, string_agg(CASE WHEN kind = 'ts' THEN '[' || speaker || ']' ELSE '' END
       || token, ' ' ORDER BY seq) AS text
FROM evt GROUP BY 1, 2""",
)
def _(t):
    events, _w = _events(t, True)
    return D.training_text(events, REC)


@query(
    "tx_18_two_state_text",
    S.TOK,
    WIN3,
    NEAR3,
    TWO3,
    S.placed_sql(REC, inclusive=False),
    S.text_sql(REC, mode="two_state"),
    select="SELECT conv_id, win_id, k, text FROM txt",
)
def _(t):
    events, wins = _events(t, True)
    grid = C.with_grid(events, wins, REC, 2000)
    placed = C.assign_chunks(grid, REC, 2000, inclusive=False, n_chunks="n_chunks")
    return C.chunk_text(placed, REC, "two_state").where("text <> ''")


@query(
    "tx_19_events_only_text",
    S.TOK,
    WIN3,
    NEAR3,
    EVT3,
    S.placed_sql(REC, inclusive=False),
    S.text_sql(REC, mode="events_only"),
    select="SELECT conv_id, win_id, k, text FROM txt",
)
def _(t):
    events, wins = _events(t)
    grid = C.with_grid(events, wins, REC, 2000)
    placed = C.assign_chunks(grid, REC, 2000, inclusive=False, n_chunks="n_chunks")
    return C.chunk_text(placed, REC, "events_only").where("text <> ''")


@query(
    "ag_7_record_span",
    S.UTT,
    WIN3,
    S.placed_sql(REC, evt="(SELECT *, 0 AS seq FROM win)").split("placed AS")[0].rstrip(",\n"),
    select="""
SELECT s.*, n_speakers FROM span s JOIN (
  SELECT conv_id, win_id, count(DISTINCT speaker) AS n_speakers FROM win GROUP BY 1, 2)
USING (conv_id, win_id)""",
)
def _(t):
    return R.record_span(R.record_windows(t.utterances(), 3))


def _turns(t, mode, two_state=False):
    events, wins = _events(t, two_state)
    out = C.chunked_conversation(events, wins, mode=mode, query="transcribe")
    return out.select(*REC, "k", "start_ms", "end_ms", "query", "text")


TURN_COLS = """
SELECT conv_id, win_id, k, (k - 1) * 2000 AS start_ms, k * 2000 AS end_ms,
       CASE WHEN k = 1 THEN 'transcribe' END AS "query", text FROM turns"""


@query(
    "st_1_chunked_conversation",
    S.TOK,
    WIN3,
    NEAR3,
    EVT3,
    S.placed_sql(REC),
    S.text_sql(REC),
    S.turns_sql(REC),
    select=TURN_COLS,
)
def _(t):
    return _turns(t, "full")


@query(
    "st_1_chunked_two_state",
    S.TOK,
    WIN3,
    NEAR3,
    TWO3,
    S.placed_sql(REC, inclusive=False),
    S.text_sql(REC, mode="two_state"),
    S.turns_sql(REC, strict=True),
    select=TURN_COLS,
)
def _(t):
    return _turns(t, "two_state", True)


@query(
    "st_1_chunked_events_only",
    S.TOK,
    WIN3,
    NEAR3,
    EVT3,
    S.placed_sql(REC, inclusive=False),
    S.text_sql(REC, mode="events_only"),
    S.turns_sql(REC, strict=True),
    select=TURN_COLS,
)
def _(t):
    return _turns(t, "events_only")


@query(
    "st_1_chunked_single_channel",
    S.TOK,
    """
utt_a AS (SELECT * FROM utt WHERE speaker = 'A'),
win AS (
  SELECT u.*, dense // 3 AS win_id FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY utt_idx) - 1 AS dense,
           count(*) OVER (PARTITION BY conv_id) AS n FROM utt_a) u
  WHERE dense // 3 < n // 3)""",
    NEAR3,
    EVT3,
    S.placed_sql(REC),
    S.text_sql(REC),
    S.turns_sql(REC),
    select="SELECT conv_id, win_id, k, text FROM turns",
)
def _(t):
    u = t.utterances().where("speaker = 'A'").withColumnRenamed("utt_idx", "old_idx")
    u = positions(u, ["conv_id"], ["old_idx"], name="utt_idx")
    toks = t.tokens().withColumnRenamed("utt_idx", "old_idx")
    toks = toks.join(u.select("conv_id", "old_idx", "utt_idx"), ["conv_id", "old_idx"])
    events = R.record_events(u, toks, 3)
    out = C.chunked_conversation(events, R.record_windows(u, 3))
    return out.select(*REC, "k", "text")


@query(
    "st_2_chunk_plan",
    S.MAN,
    """
n AS (SELECT a.conv_id, a.duration_ms AS da,
             least(CASE WHEN a.duration_ms > 0 THEN 1 + greatest(CAST(ceil((a.duration_ms - 3000) / 1000) AS BIGINT), 0) ELSE 0 END,
                   CASE WHEN b.duration_ms > 0 THEN 1 + greatest(CAST(ceil((b.duration_ms - 3000) / 1000) AS BIGINT), 0) ELSE 0 END) AS n
      FROM man a JOIN man b USING (conv_id) WHERE a.channel = 'A' AND b.channel = 'B'),
g AS (SELECT conv_id, da, unnest(range(n)) AS i FROM n),
h AS (SELECT conv_id, i, CASE WHEN i = 0 THEN 0 ELSE 3000 + (i - 1) * 1000 END AS s,
             least(CASE WHEN i = 0 THEN 3000 ELSE 3000 + i * 1000 END, da) AS e FROM g)""",
    select="""
SELECT conv_id, i AS chunk_idx, s AS start_ms, e AS end_ms,
       'Time=' || CAST((s + 50) // 1000 AS VARCHAR) || '.' || CAST((s + 50) // 100 % 10 AS VARCHAR)
       || '-' || CAST((e + 50) // 1000 AS VARCHAR) || '.' || CAST((e + 50) // 100 % 10 AS VARCHAR)
       || 's' AS label
FROM h""",
)
def _(t):
    pairs, _u = pair_channels(split_channel(t.manifest().drop("channel")))
    out = C.chunk_plan(pairs, 3000, 1000)
    return out.select(
        F.col("a_conv_id").alias("conv_id"), "chunk_idx", "start_ms", "end_ms", "label"
    )
