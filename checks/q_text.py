"""Text and path functions, labelling, splits."""

import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import query
from parley import model as M
from parley.functions import repeats as P
from parley.functions import tagged as G
from parley.functions import text as X
from parley.functions import udtf
from parley.functions.distance import edit_distance
from parley.operators import labelling as L
from parley.operators import utterances as U
from parley.operators.evaluation import prepare
from parley.operators.scan import positions

LEX = S.in_list(M.BC_LEXICON)
ARR = S.lit_list


# --- paths and cleaning -----------------------------------------------------------------------


@query(
    "prj_1_infer_speaker",
    S.MAN,
    select="SELECT path, channel AS by_channel, channel AS by_folder FROM man",
)
def _(t):
    return t.manifest().select(
        "path",
        X.infer_speaker("path").alias("by_channel"),
        X.infer_speaker("path", "pseudo").alias("by_folder"),
    )


NOISY = """
noisy AS (SELECT conv_id, utt_idx, start_ms, end_ms,
       CASE event_id % 6 WHEN 0 THEN '●' WHEN 1 THEN ' 〓 ' WHEN 2 THEN '●' || text || '。'
            WHEN 3 THEN '。' || text || '。' || text WHEN 4 THEN '●〓' ELSE text END AS text
     FROM utt)"""


def _noisy(t):
    n, text = F.col("event_id") % 6, F.col("text")
    stop = F.lit("。")
    out = (
        F.when(n == 0, "●")
        .when(n == 1, " 〓 ")
        .when(n == 2, F.concat(F.lit("●"), text, stop))
        .when(n == 3, F.concat(stop, text, stop, text))
        .when(n == 4, "●〓")
        .otherwise(text)
    )
    return t.utterances().select("conv_id", "utt_idx", "start_ms", "end_ms", out.alias("text"))


@query(
    "prj_3_clean_transcript",
    S.UTT,
    NOISY,
    select="""
SELECT conv_id, utt_idx, start_ms, end_ms, clean AS text, end_ms - start_ms AS duration_ms
FROM (SELECT *, trim(replace(replace(replace(text, '●', ''), '〓', ''), '。', ' ')) AS clean
      FROM noisy)
WHERE clean <> '' AND trim(text) NOT IN ('●', '〓')""",
)
def _(t):
    return U.clean_transcript(_noisy(t))


@query(
    "prj_4_relativize_path",
    S.MAN,
    select="""
SELECT conv_id, channel, 'corpus/audios/' || channel || '_gd/' || conv_id || '_' || lower(channel)
       || '.wav' AS relative, path AS unchanged FROM man""",
)
def _(t):
    return t.manifest().select(
        "conv_id",
        "channel",
        X.relativize_path("path", "corpus").alias("relative"),
        X.relativize_path("path", "nowhere").alias("unchanged"),
    )


TAIL = """
toks AS (SELECT conv_id, utt_idx,
       text || CASE event_id % 4 WHEN 0 THEN '。' WHEN 1 THEN '？' WHEN 2 THEN '。。' ELSE '' END
         AS text FROM utt)"""


def _tail(t):
    n = F.col("event_id") % 4
    end = F.when(n == 0, "。").when(n == 1, "？").when(n == 2, "。。").otherwise("")
    return t.utterances().select("conv_id", "utt_idx", F.concat("text", end).alias("text"))


@query(
    "prj_5_strip_final_punct",
    S.UTT,
    TAIL,
    select="""
SELECT conv_id, utt_idx, regexp_replace(text, '[。？！，、；：]$', '') AS text FROM toks""",
)
def _(t):
    cut = X.strip_final_punct(X.char_array("text"))
    return _tail(t).select("conv_id", "utt_idx", F.array_join(cut, "").alias("text"))


@query(
    "prj_6_drop_empty",
    S.UTT,
    select="SELECT conv_id, utt_idx FROM utt WHERE event_id % 9 <> 0",
)
def _(t):
    stream = F.when(F.col("event_id") % 9 == 0, F.array().cast("array<string>")).otherwise(
        X.char_array("text")
    )
    rows = t.utterances().select("conv_id", "utt_idx", stream.alias("text_stream"))
    return U.drop_empty(rows).drop("text_stream")


@query(
    "prj_7_drop_name_parts",
    S.MAN,
    select="""
SELECT path, name AS one_less, lower(channel) AS two_less FROM man""",
)
def _(t):
    long = F.concat(F.lit("shard_"), F.col("name"))
    return t.manifest().select(
        "path",
        X.drop_name_parts(long, 1).alias("one_less"),
        X.drop_name_parts(long, 2).alias("two_less"),
    )


@query(
    "prj_8_clean_generated",
    S.RES,
    select="SELECT sample_id, turn_id, trim(pred) AS pred FROM res",
)
def _(t):
    marked = F.concat(F.lit(" "), "pred", F.lit("<|im_end|>"), F.lit("<|endoftext|> "))
    return t.results().select("sample_id", "turn_id", X.clean_generated(marked).alias("pred"))


@query(
    "prj_12_truncate_text",
    S.RES,
    select="""
SELECT sample_id, turn_id, CASE WHEN length(pred) > 240 THEN left(pred, 240) || '... <truncated '
       || CAST(length(pred) - 240 AS VARCHAR) || ' chars>' ELSE pred END AS pred FROM res""",
)
def _(t):
    return t.results().select("sample_id", "turn_id", X.truncate_text("pred", 240).alias("pred"))


CODES = """
ids AS (
  SELECT sample_id, turn_id,
         list_concat(list_concat([1, 10, 99], list_transform(string_split(r, ''), lambda c: ascii(c))),
           list_concat(list_concat([2, 1, 11, 99], list_transform(string_split(p, ''), lambda c: ascii(c))),
                       [2])) AS ids,
         length(r) AS nr, length(p) AS np
  FROM (SELECT *, regexp_replace(ref, '[<>/_]', '', 'g') AS r,
               regexp_replace(pred, '[<>/_]', '', 'g') AS p FROM res))"""


@query(
    "prj_13_assistant_loss_mask",
    S.RES,
    CODES,
    select="""
SELECT sample_id, turn_id, CAST(length(ids) AS INTEGER) AS n,
       CAST((nr + 7) * -100 + list_sum(ids[nr + 8:]) AS BIGINT) AS total,
       CAST(np + 1 AS INTEGER) AS shown FROM ids""",
)
def _(t):
    codes = lambda c: F.transform(
        F.split(F.regexp_replace(c, "[<>/_]", ""), ""), lambda x: F.ascii(x)
    )
    mark = lambda *n: F.array(*[F.lit(i) for i in n])
    ids = F.concat(mark(1, 10, 99), codes("ref"), mark(2, 1, 11, 99), codes("pred"), mark(2))
    rows = t.results().select("sample_id", "turn_id", ids.alias("ids"))
    rows = rows.withColumn("labels", X.assistant_loss_mask("ids", 1, 11, 2))
    return rows.select(
        "sample_id",
        "turn_id",
        F.size("ids").alias("n"),
        F.aggregate("labels", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
        F.size(F.filter("labels", lambda x: x != -100)).alias("shown"),
    )


@query(
    "prj_14_split_placeholders",
    S.UTT,
    select="""
SELECT conv_id, utt_idx, CAST(pos AS INTEGER) AS pos, piece, id FROM (
  SELECT conv_id, utt_idx, unnest(range(6)) AS pos,
         unnest(['Speaker A', '<A>', 'Speaker B', '<B>', text, '<audio>']) AS piece,
         unnest([NULL, -201, NULL, -202, NULL, -203]) AS id FROM utt)""",
)
def _(t):
    text = F.concat(F.lit("Speaker A<A>Speaker B<B>"), "text", F.lit("<audio>"))
    rows = t.utterances().select(
        "conv_id", "utt_idx", F.posexplode(X.split_placeholders(text)).alias("pos", "p")
    )
    return rows.select("conv_id", "utt_idx", "pos", "p.piece", "p.id")


@query(
    "prj_15_mask_oov",
    select="""
SELECT conv_id, turn, regexp_replace(replace(lower(trim(text)), ' ', '|'), '[^a-z|'']', '*', 'g')
       AS masked FROM conversations""",
)
def _(t):
    vocab = list("abcdefghijklmnopqrstuvwxyz|'") + ["<pad>"]
    return t.raw("conversations").select(
        "conv_id", "turn", X.mask_oov("text", vocab, "en").alias("masked")
    )


@query(
    "prj_16_drop_degenerate",
    S.TOK,
    select="SELECT conv_id, utt_idx, tok_idx, start_ms, end_ms FROM tok WHERE end_ms - 60 > start_ms",
)
def _(t):
    rows = t.tokens().withColumn("end_ms", F.col("end_ms") - 60)
    return (
        U.drop_degenerate(rows)
        .withColumn("end_ms", F.col("end_ms") + 60)
        .select("conv_id", "utt_idx", "tok_idx", "start_ms", "end_ms")
    )


@query(
    "prj_17_classification_prompt",
    S.UTT,
    select=f"""
SELECT conv_id, utt_idx, '{L.SYSTEM_TEXT}' AS "system", 'Utterance: ' || text AS "user"
FROM utt WHERE {S.candidate_sql()}""",
)
def _(t):
    out = L.with_prompt(L.candidates(t.utterances()))
    return out.select("conv_id", "utt_idx", "prompt.system", "prompt.user")


# --- backchannel text rules -------------------------------------------------------------------


@query(
    "tx_1_short_response",
    S.UTT,
    select=f"""
SELECT conv_id, utt_idx, (text IN {LEX} AND end_ms - start_ms <= 1000)
       OR (end_ms - start_ms <= 800 AND length(text) <= 4)
       OR (end_ms - start_ms <= 1000 AND length(text) <= 8) AS flag FROM utt""",
)
def _(t):
    flag = X.is_short_response("text", F.col("end_ms") - F.col("start_ms"))
    return t.utterances().select("conv_id", "utt_idx", flag.alias("flag"))


# Two lines of the lexicon with marks between them, so that words repeat.
DOUBLED = f"""
dbl AS (SELECT conv_id, utt_idx, text || CASE event_id % 3 WHEN 0 THEN '、' WHEN 1 THEN '。' ELSE '' END
             || text || CASE event_id % 2 WHEN 0 THEN '！' || text ELSE '' END AS text FROM utt),
words AS (SELECT conv_id, utt_idx, text, p, unnest(w) AS w, unnest(range(length(w))) AS nth FROM (
  SELECT *, list_filter(string_split(regexp_replace(text, '[。、！？…]', ' ', 'g'), ' '), lambda x: x <> '')
           AS w, 0 AS p FROM dbl)),
wtok AS (SELECT conv_id, utt_idx, nth, CASE WHEN w IN {LEX} THEN [w]
  WHEN contains(w, 'うん') THEN list_transform(range(length(string_split(w, 'うん')) - 1), lambda x: 'うん')
  WHEN contains(w, 'そう') THEN list_transform(range(length(string_split(w, 'そう')) - 1), lambda x: 'そう')
  WHEN contains(w, 'はい') THEN list_transform(range(length(string_split(w, 'はい')) - 1), lambda x: 'はい')
  ELSE [w] END AS toks FROM words),
alltok AS (SELECT conv_id, utt_idx, flatten(list(toks ORDER BY nth)) AS toks FROM wtok GROUP BY 1, 2)
"""


def _doubled(t):
    e, text = F.col("event_id"), F.col("text")
    gap = F.when(e % 3 == 0, "、").when(e % 3 == 1, "。").otherwise("")
    more = F.when(e % 2 == 0, F.concat(F.lit("！"), text)).otherwise("")
    return t.utterances().select(
        "conv_id", "utt_idx", F.concat(text, gap, text, more).alias("text")
    )


@query(
    "tx_2_lexicon_tokens",
    S.UTT,
    DOUBLED,
    select="SELECT conv_id, utt_idx, array_to_string(toks, ' ') AS tokens FROM alltok",
)
def _(t):
    return _doubled(t).select(
        "conv_id", "utt_idx", F.array_join(X.lexicon_tokens("text"), " ").alias("tokens")
    )


@query(
    "tx_3_low_information",
    S.UTT,
    DOUBLED,
    select=f"SELECT conv_id, utt_idx, {S.density_sql('toks', LEX)} AS flag FROM alltok",
)
def _(t):
    return _doubled(t).select(
        "conv_id", "utt_idx", X.low_information_density("text").alias("flag")
    )


@query(
    "tx_4_candidates",
    S.UTT,
    select=f"SELECT conv_id, utt_idx, text FROM utt WHERE {S.candidate_sql()}",
)
def _(t):
    return L.candidates(t.utterances()).select("conv_id", "utt_idx", "text")


@query(
    "tx_5_brief_segment",
    S.UTT,
    select="""
SELECT conv_id, utt_idx, end_ms - start_ms < 500 AND length(text) < 5 AS flag FROM utt""",
)
def _(t):
    flag = X.is_brief_segment("text", F.col("end_ms") - F.col("start_ms"))
    return t.utterances().select("conv_id", "utt_idx", flag.alias("flag"))


@query(
    "tx_6_parse_label",
    S.UTT,
    select="""
SELECT conv_id, utt_idx, CASE event_id % 7 WHEN 0 THEN 'continuer' WHEN 1 THEN 'assessment'
       WHEN 2 THEN 'non_backchannel' WHEN 3 THEN 'assessment' WHEN 4 THEN 'non_backchannel'
       WHEN 5 THEN 'continuer' ELSE 'non_backchannel' END AS label FROM utt""",
)
def _(t):
    answers = [
        "Continuer.",
        "assessment:\nbecause it reacts",
        "",
        "I would say assessment, not continuer",
        "continuers? no idea",
        "  CONTINUER  ",
        "assessment or non_backchannel",
    ]
    pick = F.get(F.array(*[F.lit(a) for a in answers]), (F.col("event_id") % 7).cast("int"))
    answer = F.concat(pick, F.when(F.col("event_id") % 7 == 4, F.col("text")).otherwise(""))
    return t.utterances().select("conv_id", "utt_idx", X.parse_label(answer).alias("label"))


# --- tagged text ------------------------------------------------------------------------------


TX7 = """
cells AS (
  SELECT sample_id, turn_id, unnest(range(length(c))) AS nth, unnest(c) AS c FROM (
    SELECT sample_id, turn_id, regexp_extract_all(pred,
      '</?speaker_[AB]>|<ts>|<te>|<bc>|<silence>|<pause>|[^<]+') AS c FROM res)),
spk AS (
  SELECT *, last_value(CASE WHEN c LIKE '<speaker%' THEN substr(c, 2, 9)
                            WHEN c LIKE '</speaker%' THEN '' END IGNORE NULLS)
              OVER (PARTITION BY sample_id, turn_id ORDER BY nth) AS cur
  FROM cells)"""
TX7_SELECT = """
SELECT sample_id, turn_id, CAST(row_number() OVER (PARTITION BY sample_id, turn_id ORDER BY nth) - 1
         AS INTEGER) AS pos, kind, CASE WHEN kind = 'text' THEN nullif(cur, '') END AS speaker, value
FROM (SELECT *, CASE WHEN c IN ('<ts>', '<te>', '<bc>', '<silence>', '<pause>') THEN 'special'
                     WHEN c LIKE '<%' THEN 'tag' ELSE 'text' END AS kind, trim(c) AS value FROM spk)
WHERE kind <> 'tag' AND value <> ''"""


@query("tx_7_parse_events", S.RES, TX7, select=TX7_SELECT)
def _(t):
    rows = t.results().select(
        "sample_id", "turn_id", F.posexplode(G.parse_events("pred")).alias("pos", "e")
    )
    return rows.select("sample_id", "turn_id", "pos", "e.kind", "e.speaker", "e.value")


@query("ud_3_tagged_events_udtf", S.RES, TX7, select=TX7_SELECT)
def _(t):
    udtf.register(t.spark)
    t.results().createOrReplaceTempView("parley_results")
    return t.spark.sql(
        "SELECT sample_id, turn_id, e.* FROM parley_results r, LATERAL tagged_events(r.pred) e"
    )


@query(
    "tx_8_speaker_text",
    S.RES,
    S.scored_sql(),
    select="SELECT sample_id, turn_id, pa_ AS text_a, pb_ AS text_b FROM sides",
)
def _(t):
    return t.results().select(
        "sample_id",
        "turn_id",
        G.speaker_text("pred", "A").alias("text_a"),
        G.speaker_text("pred", "B").alias("text_b"),
    )


@query(
    "tx_9_edit_distance",
    S.RES,
    S.scored_sql(),
    select=f"""
SELECT sample_id, turn_id, {S.distance_sql("pb_", "rb_")} AS edits,
       {S.distance_sql("pb_", "rb_")} / greatest(length(rb_), 1) AS cer FROM sides""",
)
def _(t):
    rows = t.results().select(
        "sample_id",
        "turn_id",
        G.speaker_text("pred", "B").alias("p"),
        G.speaker_text("ref", "B").alias("r"),
    )
    rows = rows.withColumn("edits", edit_distance("p", "r").cast("long"))
    return rows.select(
        "sample_id", "turn_id", "edits", G.cer(F.col("edits"), F.length("r")).alias("cer")
    )


@query(
    "tx_11_lcs_length",
    S.RES,
    S.scored_sql(),
    select="SELECT sample_id, turn_id, CAST(tp AS INTEGER) AS lcs FROM scored",
)
def _(t):
    rows = t.results().select(
        "sample_id",
        "turn_id",
        G.special_tokens("pred").alias("p"),
        G.special_tokens("ref").alias("r"),
    )
    return rows.select("sample_id", "turn_id", G.lcs_length("p", "r").alias("lcs"))


# Units that compete for the same place, and what is left of them.
COMPETING = {
    "aababab#": "aab#",
    "aaabaaabaaab#": "aaab#",
    "abababababab#": "ab#",
    "aaaaaa#": "a#",
    "xyyyxyyyxyyy#": "xyyy#",
}


@query(
    "tx_13_collapse_repeats",
    S.UTT,
    select=f"""
SELECT conv_id, utt_idx, CASE event_id % 8 WHEN 0 THEN text WHEN 1 THEN text
       WHEN 2 THEN text || 'x' || text
       {" ".join(f"WHEN {k + 3} THEN '{v}' || text" for k, v in enumerate(COMPETING.values()))}
       END AS text FROM utt""",
)
def _(t):
    n, text = F.col("event_id") % 8, F.col("text")
    out = F.when(n == 0, F.repeat(text, 3)).when(n == 1, F.repeat(text, 5))
    out = out.when(n == 2, F.concat(text, F.lit("x"), text))
    for k, given in enumerate(COMPETING):
        out = out.when(n == k + 3, F.concat(F.lit(given), text))
    return t.utterances().select("conv_id", "utt_idx", P.collapse_repeats(out).alias("text"))


@query(
    "tx_14_collapse_phrases",
    S.UTT,
    select="""
SELECT conv_id, utt_idx, CASE event_id % 3 WHEN 0 THEN text WHEN 1 THEN text || '，終'
       ELSE text || '、' || text END AS text FROM utt""",
)
def _(t):
    n, text = F.col("event_id") % 3, F.col("text")
    out = F.when(n == 0, F.concat_ws("、", text, text, text))
    out = out.when(n == 1, F.concat(F.concat_ws(", ", text, text, text), F.lit("，終")))
    out = out.otherwise(F.concat_ws("、", text, text))
    return t.utterances().select("conv_id", "utt_idx", P.collapse_phrases(out).alias("text"))


def _tagged(text):
    """Predictions with repeated units, phrases and event tokens; only the last are to stay."""
    return F.concat(
        F.lit("<speaker_A>"),
        F.repeat(text, 4),
        F.lit("</speaker_A><ts><ts><ts><speaker_B>"),
        F.concat_ws("、", text, text, F.concat(F.lit(" "), text), F.lit("終")),
        F.lit("</speaker_B><te>"),
    )


CLEANED = """'<speaker_A>' || text || '</speaker_A><ts><ts><ts><speaker_B>' || text || '、終</speaker_B><te>'"""


@query(
    "tx_15_clean_prediction",
    S.UTT,
    select=f"""
SELECT conv_id, utt_idx, CASE WHEN event_id % 2 = 0 THEN {CLEANED} ELSE text END AS pred,
       event_id % 2 = 0 AS cleanup_changed,
       CAST(length(text) * CASE WHEN event_id % 2 = 0 THEN 7 ELSE 1 END
            + CASE WHEN event_id % 2 = 0 THEN length({CLEANED}) - 2 * length(text) + 3 ELSE 0 END
            AS INTEGER) AS chars_before
FROM utt""",
)
def _(t):
    text = F.col("text")
    pred = F.when(F.col("event_id") % 2 == 0, _tagged(text)).otherwise(text)
    rows = t.utterances().select("conv_id", "utt_idx", pred.alias("pred"))
    return prepare(rows).select("conv_id", "utt_idx", "pred", "cleanup_changed", "chars_before")


@query("ud_2_repeat_cleanup", S.UTT, select=f"SELECT conv_id, utt_idx, {CLEANED} AS pred FROM utt")
def _(t):
    rows = t.utterances().select("conv_id", "utt_idx", _tagged(F.col("text")).alias("pred"))
    return prepare(rows).select("conv_id", "utt_idx", "pred")


# --- labelling --------------------------------------------------------------------------------


def _rule_model():
    """Stands in for a classifier: answers by word list."""

    def predict(prompts):
        out = []
        for p in prompts:
            word = p.split(": ", 1)[1]
            out.append("Continuer." if word in ("はい", "うん") else "I think: assessment")
        return out

    return predict


@query(
    "ud_1_classify",
    S.UTT,
    select=f"""
SELECT conv_id, utt_idx, text, CASE WHEN text IN ('はい', 'うん') THEN 'continuer'
       ELSE 'assessment' END AS label FROM utt WHERE {S.candidate_sql()}""",
)
def _(t):
    out = L.classify(L.candidates(t.utterances()), _rule_model, batch_size=32)
    return out.select("conv_id", "utt_idx", "text", "label")


@query(
    "ag_9_dedup_first",
    S.LAB,
    select="""
SELECT id, rank, pos, text, label FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, pos) AS n FROM lab) WHERE n = 1""",
)
def _(t):
    return L.dedup_first(t.label_results()).select("id", "rank", "pos", "text", "label")


DEDUP = """
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, pos) AS n
                         FROM lab) WHERE n = 1),
merged AS (SELECT u.conv_id, u.utt_idx, u.event_id AS id,
       CASE WHEN f.text = u.text THEN f.label ELSE 'non_backchannel' END AS bc_label,
       coalesce(f.text <> u.text, false) AS label_mismatch
  FROM utt u LEFT JOIN first f ON f.id = u.event_id)"""


def _merged(t):
    labels = L.dedup_first(t.label_results())
    return L.merge_labels(t.utterances().withColumnRenamed("event_id", "id"), labels)


@query("jn_4_merge_labels", S.LAB, DEDUP, select="SELECT * FROM merged")
def _(t):
    return _merged(t).select("conv_id", "utt_idx", "id", "bc_label", "label_mismatch")


@query(
    "ag_1_label_distribution",
    S.LAB,
    DEDUP,
    select="""
SELECT file, label, n, n / sum(n) OVER (PARTITION BY file) * 100 AS pct,
       row_number() OVER (PARTITION BY file ORDER BY n DESC, label) AS place
FROM (SELECT conv_id % 5 AS file, bc_label AS label, count(*) AS n FROM merged GROUP BY 1, 2)""",
)
def _(t):
    return L.label_distribution(_merged(t).withColumn("file", F.col("conv_id") % 5))


@query(
    "jn_8_exclude_labelled",
    S.LAB,
    select="""
SELECT conv_id, utt_idx FROM utt WHERE conv_id NOT IN (
  SELECT conv_id FROM utt WHERE bc_label = 'continuer' AND utt_idx < 10)""",
)
def _(t):
    u = t.utterances()
    labelled = u.where("bc_label = 'continuer' AND utt_idx < 10")
    return L.exclude_labelled(u, labelled).select("conv_id", "utt_idx")


@query(
    "so_1_stable_sort",
    S.UTT,
    select="""
SELECT conv_id, utt_idx, row_number() OVER (PARTITION BY conv_id
         ORDER BY end_ms - start_ms, speaker, utt_idx) - 1 AS place FROM utt""",
)
def _(t):
    u = t.utterances().withColumn("duration", F.col("end_ms") - F.col("start_ms"))
    out = positions(u, ["conv_id"], ["duration", "speaker", "utt_idx"], name="place", x="duration")
    return out.select("conv_id", "utt_idx", "place")


@query(
    "so_2_limit_samples",
    S.RES,
    select="SELECT sample_id, turn_id, ref FROM res ORDER BY sample_id, turn_id LIMIT 50",
)
def _(t):
    out = L.limit_samples(t.results(), 50, ["sample_id", "turn_id"])
    return out.select("sample_id", "turn_id", "ref")


@query(
    "so_3_train_test_split",
    S.UTT,
    select="""
SELECT conv_id, utt_idx, CASE WHEN
         CAST('0x' || substr(md5('42:/a/' || conv_id || '.jsonl'), 1, 8) AS BIGINT) % 100 < 80
       THEN 'train' ELSE 'test' END AS split FROM utt""",
)
def _(t):
    path = F.concat(F.lit("/a/"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    rows = L.train_test_split(t.utterances().withColumn("path", path), "path")
    return rows.select("conv_id", "utt_idx", "split")


@query("so_4_union_ranks", S.LAB, select="SELECT id, rank, text, label FROM lab")
def _(t):
    r = t.label_results()
    parts = [r.where(F.col("rank") == i).select("id", "rank", "text", "label") for i in range(4)]
    return L.union_ranks(parts)


# Workers need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
