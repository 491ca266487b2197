"""DuckDB forms of the derived tables, written independently of the Spark operators."""

from parley import model as M

LEXICON = [
    "はい", "うん", "そうです", "それはけど", "わかりました", "なんか",
    "よろしくおねがいします", "えっと", "すごいですね", "なるほど", "最近は", "と思います",
]
SPECIALS = M.SPECIAL_TOKENS


def lit_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def in_list(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# D1
UTT = f"""
ev AS (
  SELECT user_id AS conv_id, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events),
utt AS (
  SELECT conv_id, pos AS utt_idx, event_id,
         CASE WHEN (event_id * 7 + pos * 3) % 5 < 3 THEN 'A' ELSE 'B' END AS speaker,
         pos * 1600 + (event_id * 37) % 900 AS start_ms,
         pos * 1600 + (event_id * 37) % 900 + 250
           + CAST(floor(value * 20) AS BIGINT) % 2600 AS end_ms,
         {lit_list(LEXICON)}[event_id % 12 + 1] AS text,
         CASE event_id % 11 WHEN 0 THEN 'continuer' WHEN 1 THEN 'assessment'
                            WHEN 2 THEN 'non_backchannel' END AS bc_label
  FROM ev)"""

# D2
TOK = UTT + """,
tok AS (
  SELECT conv_id, utt_idx, event_id, speaker, i AS tok_idx,
         start_ms + i * (end_ms - start_ms) // n AS start_ms,
         start_ms + (i + 1) * (end_ms - start_ms) // n AS end_ms,
         substr(text, CAST(i + 1 AS BIGINT), 1) AS text
  FROM (SELECT *, length(text) AS n, unnest(range(length(text))) AS i FROM utt))"""

# D3
RES = f"""
pairs AS (
  SELECT a.conv_id, a.turn, a.text AS ra, b.text AS rb
  FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user'),
res AS (
  SELECT conv_id AS sample_id, turn AS turn_id,
         CASE WHEN conv_id % 11 = 0 THEN NULL ELSE conv_id % 4 END AS rank,
         'part' || CAST(conv_id % 3 AS VARCHAR) AS file,
         '<speaker_A>' || pa || '</speaker_A>' || s[(conv_id + turn) % 5 + 1]
           || '<speaker_B>' || pb || '</speaker_B>' || s[(conv_id * 2 + turn) % 5 + 1]
           || CASE WHEN conv_id % 3 = 0 THEN s[turn % 5 + 1] ELSE '' END AS pred,
         '<speaker_A>' || ra || '</speaker_A>' || s[(conv_id + turn) % 5 + 1]
           || '<speaker_B>' || rb || '</speaker_B>' || s[(conv_id * 3 + turn) % 5 + 1]
           || s[turn % 5 + 1] AS ref
  FROM (SELECT *, replace(ra, 'th', 't') AS pa,
               replace(rb, 'on', 'no')
                 || CASE WHEN (conv_id + turn) % 5 = 0 THEN 'hahahahahahahaha' ELSE '' END AS pb,
               {lit_list(SPECIALS)} AS s
        FROM pairs))"""

# Letters beyond ASCII in the texts, and characters of one byte that do not occur in them.
LETTERS = "ÀÁÂÄÇÈÉÊËÍÎÑÓÔÖÚÛÜßàáâäçèéêëíîñóôöúûü"
STAND_INS = "0123456789!#$%&()*+-:;=?@[]^`{|}~X\x01\x02\x03"


def distance_sql(a, b):
    """Edit distance by character: DuckDB's is one by byte, so each letter becomes one byte."""
    one = lambda c: f"translate({c}, '{LETTERS}', '{STAND_INS[: len(LETTERS)]}')"
    return f"levenshtein({one(a)}, {one(b)})"


# Scores of D3, from the text alone.
_side = lambda c, s: (
    f"array_to_string(list_transform(regexp_extract_all({c}, '<speaker_{s}>([^<]*)</speaker_{s}>',"
    " 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '')"
)
_letters = lambda c: (
    "array_to_string(list_transform(regexp_extract_all(" + c
    + ", '<(ts|te|bc|silence|pause)>', 1), lambda x: CASE x WHEN 'ts' THEN 's' WHEN 'te' THEN 'e'"
    " WHEN 'bc' THEN 'b' WHEN 'silence' THEN 'l' ELSE 'p' END), '')"
)


def scored_sql(source="res"):
    """Columns of ``evaluation.score``. The longest common subsequence is the longest choice of
    predicted tokens that matches the reference as a LIKE pattern."""
    return f"""
sides AS (
  SELECT *, {_side('pred', 'A')} AS pa_, {_side('pred', 'B')} AS pb_,
         {_side('ref', 'A')} AS ra_, {_side('ref', 'B')} AS rb_,
         {_letters('pred')} AS pl, {_letters('ref')} AS rl
  FROM {source}),
lcs AS (
  SELECT sample_id, turn_id, max(length(pick)) AS tp
  FROM (SELECT sample_id, turn_id, rl,
               array_to_string(list_transform(
                 list_filter(range(length(pl)), lambda i: (mask >> CAST(i AS INTEGER)) & 1 = 1),
                 lambda i: substr(pl, i + 1, 1)), '') AS pick
        FROM (SELECT *, unnest(range(CAST(1 << CAST(length(pl) AS INTEGER) AS BIGINT))) AS mask
              FROM sides))
  WHERE rl LIKE '%' || array_to_string(
          list_transform(range(length(pick)), lambda i: substr(pick, i + 1, 1) || '%'), '')
  GROUP BY 1, 2),
cers AS (
  SELECT s.*, l.tp,
         {distance_sql('pa_', 'ra_')} AS edits_A, {distance_sql('pb_', 'rb_')} AS edits_B,
         length(ra_) AS ref_chars_A, length(rb_) AS ref_chars_B,
         length(pl) - l.tp AS fp, length(rl) - l.tp AS fn,
         l.tp / greatest(length(pl), 1) AS "precision",
         l.tp / greatest(length(rl), 1) AS recall
  FROM sides s JOIN lcs l USING (sample_id, turn_id)),
scored AS (
  SELECT *, edits_A / greatest(ref_chars_A, 1) AS cer_A, edits_B / greatest(ref_chars_B, 1) AS cer_B,
         edits_A + edits_B AS edits, ref_chars_A + ref_chars_B AS ref_chars,
         (edits_A + edits_B) / greatest(ref_chars_A + ref_chars_B, 1) AS cer,
         2 * "precision" * recall / greatest("precision" + recall, 1e-8) AS f1
  FROM cers)"""


# D4
def candidate_sql(text="text", dur="(end_ms - start_ms)"):
    """TX-4 on the lexicon texts, none of which holds white space or punctuation."""
    lex = in_list(M.BC_LEXICON)
    size = f"length({text})"
    toks = (
        f"(CASE WHEN {text} IN {lex} THEN [{text}]"
        + "".join(
            f" WHEN contains({text}, '{c}') THEN list_transform("
            f"range(length(string_split({text}, '{c}')) - 1), lambda x: '{c}')"
            for c in M.REPEATABLE
        )
        + f" ELSE [{text}] END)"
    )
    return (
        f"({size} > 0 AND (({text} IN {lex} AND {dur} <= 1000) OR ({dur} <= 800 AND {size} <= 4)"
        f" OR ({dur} <= 1000 AND {size} <= 8) OR {density_sql(toks, lex)}))"
    )


def density_sql(toks, lex):
    n = f"length({toks})"
    return (
        f"({n} > 0 AND length(list_filter({toks}, lambda x: x IN {lex})) / {n} >= 0.6"
        f" AND length(list_distinct({toks})) / {n} <= 0.6"
        f" AND length(list_filter({toks}, lambda x: length(list_filter({toks}, lambda y: y = x)) > 1)) / {n}"
        " >= 0.3)"
    )


LAB = UTT + f""",
lab0 AS (
  SELECT event_id AS id, event_id % 4 AS rank,
         CASE WHEN event_id % 23 = 0 THEN text || 'x' ELSE text END AS text,
         {lit_list(M.LABELS)}[event_id % 3 + 1] AS label
  FROM utt WHERE {candidate_sql()}),
lab AS (
  SELECT *, id AS pos FROM lab0
  UNION ALL
  SELECT id, (rank + 1) % 4, text, 'assessment', id FROM lab0 WHERE id % 17 = 0)"""

# D5
FRM = TOK + """,
frm AS (
  SELECT conv_id, utt_idx, tok_idx AS token_index, before + j AS time_index,
         ((event_id * 7 + (before + j) * 13) % 64) / 64 AS score
  FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS j
        FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id, utt_idx ORDER BY tok_idx) - n
                             AS BIGINT) AS before
              FROM (SELECT *, (event_id + tok_idx) % 5 + 1 AS n FROM tok))))"""

# D6
MAN = UTT + """,
man AS (
  SELECT conv_id, channel,
         CAST(conv_id AS VARCHAR) || '_' || lower(channel) AS name,
         '/data/corpus/audios/' || channel || '_gd/' || CAST(conv_id AS VARCHAR) || '_'
           || lower(channel) || '.wav' AS path,
         max_end - (conv_id * 131) % 4000 AS duration_ms
  FROM (SELECT conv_id, max(end_ms) AS max_end FROM utt GROUP BY conv_id),
       (SELECT unnest(['A', 'B']) AS channel)
  WHERE NOT (channel = 'B' AND conv_id % 13 = 0)),
seg AS (
  SELECT u.*, '/data/corpus/audios/' || speaker || '_gd/' || CAST(conv_id AS VARCHAR) || '_'
           || lower(speaker) || '.wav' AS path
  FROM utt u)"""

# Characters of whole conversation texts.
CHR = """
chr AS (
  SELECT conv_id, turn, CAST(i AS BIGINT) AS char_idx, substr(text, CAST(i + 1 AS BIGINT), 1) AS char,
         CASE WHEN i % 11 = 0 THEN NULL ELSE i * 40 END AS start_ms,
         CASE WHEN i % 11 = 0 THEN NULL ELSE i * 40 + 35 END AS end_ms,
         ((i * 7 + turn) % 64) / 64 AS score, n
  FROM (SELECT *, length(text) AS n, unnest(range(length(text))) AS i FROM conversations)),
wrd AS (
  SELECT *, CAST(coalesce(sum(b) OVER (PARTITION BY conv_id, turn ORDER BY char_idx
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS word_idx
  FROM (SELECT *, CASE WHEN char_idx = n - 1
                    OR lead(char) OVER (PARTITION BY conv_id, turn ORDER BY char_idx) = ' '
                  THEN 1 ELSE 0 END AS b FROM chr))"""


def windows_sql(length, overlap=False, name="win"):
    """Record windows of D1."""
    if overlap:
        return f"""
{name} AS (
  SELECT u.*, w.win_id FROM utt u
  JOIN (SELECT conv_id, unnest(range(CAST(max(utt_idx) - {length} + 2 AS BIGINT))) AS win_id
        FROM utt GROUP BY conv_id) w
    ON u.conv_id = w.conv_id AND u.utt_idx BETWEEN w.win_id AND w.win_id + {length - 1})"""
    return f"""
{name} AS (
  SELECT u.*, u.utt_idx // {length} AS win_id
  FROM utt u JOIN (SELECT conv_id, max(utt_idx) + 1 AS n FROM utt GROUP BY conv_id) c USING (conv_id)
  WHERE u.utt_idx // {length} < n // {length})"""


def near_sql(src="utt", keys=("conv_id",), name="near"):
    """Neighbours by self joins; turn-taking rules on top."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    ak = ", ".join(f"a.{c}" for c in keys)
    nonfinal, final = "|".join(M.NONFINAL_SUFFIXES), "|".join(M.FINAL_SUFFIXES)
    return f"""
{name}_idx AS (
  SELECT {ak}, a.utt_idx,
         min(CASE WHEN a.speaker = b.speaker THEN b.utt_idx END) AS same_idx,
         min(CASE WHEN a.speaker <> b.speaker THEN b.utt_idx END) AS other_idx,
         min(b.utt_idx) AS next_idx, count(b.utt_idx) AS n_after
  FROM {src} a LEFT JOIN {src} b ON {on} AND b.utt_idx > a.utt_idx
  GROUP BY {ak}, a.utt_idx),
{name}0 AS (
  SELECT u.*, length(u.text) AS n_tokens, i.n_after,
         s.utt_idx AS same_idx, s.start_ms - u.end_ms AS same_gap,
         o.utt_idx AS other_idx, o.start_ms - u.end_ms AS other_gap,
         o.start_ms AS other_start, o.end_ms AS other_end, length(o.text) AS other_n,
         x.utt_idx AS next_idx, x.start_ms - u.end_ms AS next_gap,
         x.speaker AS next_speaker, x.start_ms AS next_start, x.end_ms AS next_end
  FROM {src} u JOIN {name}_idx i USING ({k}, utt_idx)
  LEFT JOIN {src} s ON {' AND '.join(f's.{c} = u.{c}' for c in keys)} AND s.utt_idx = i.same_idx
  LEFT JOIN {src} o ON {' AND '.join(f'o.{c} = u.{c}' for c in keys)} AND o.utt_idx = i.other_idx
  LEFT JOIN {src} x ON {' AND '.join(f'x.{c} = u.{c}' for c in keys)} AND x.utt_idx = i.next_idx),
{name}1 AS (
  SELECT *,
    coalesce(same_gap <= 1500, false) AS resumes,
    CASE WHEN trim(text) = '' THEN false
         WHEN regexp_matches(text, '({nonfinal})$') THEN false
         WHEN regexp_matches(text, '({final})$') THEN true
         ELSE length(text) <= 8 AND text IN {in_list(M.SHORT_REPLIES)} END AS complete
  FROM {name}0),
{name} AS (
  SELECT *,
    CASE WHEN other_idx IS NULL THEN false
         WHEN bc_label IS NOT NULL THEN bc_label <> 'non_backchannel'
         ELSE start_ms < other_end AND other_start < end_ms AND other_end - other_start <= 1000
              AND other_n <= 8 AND same_idx IS NOT NULL AND resumes END AS is_bc,
    other_idx IS NOT NULL AND other_gap <= 700 AND NOT resumes AS is_ts,
    coalesce(same_gap >= 300 AND same_gap < 1500, false) AS is_pause,
    coalesce(next_gap >= 1500, false) AS is_silence,
    NOT resumes AND NOT coalesce(other_gap BETWEEN 0 AND 700, false) AND complete AS is_te,
    CASE WHEN next_speaker <> speaker AND start_ms < next_end AND next_start < end_ms
         THEN next_start END AS cut_all,
    CASE WHEN n_after > 1 AND next_speaker <> speaker AND start_ms < next_end
              AND next_start < end_ms THEN next_start END AS cut_ms,
    CASE WHEN coalesce(other_gap BETWEEN 0 AND 700, false) AND NOT resumes
         THEN 'ts' ELSE 'te' END AS two_state
  FROM {name}1)"""


BOUNDARY = (
    "CASE WHEN is_bc THEN 'bc' WHEN is_ts THEN 'ts' WHEN is_pause THEN 'pause' "
    "WHEN is_silence THEN 'silence' WHEN is_te THEN 'te' END"
)


def events_sql(keys=("conv_id",), near="near", name="evt"):
    """Event stream; needs ``tok`` and the neighbours."""
    k = ", ".join(keys)
    nk = ", ".join(f"n.{c}" for c in keys)
    return f"""
{name}0 AS (
  SELECT {nk}, t.utt_idx, 0 AS b, t.tok_idx, t.start_ms, t.end_ms, n.speaker, t.text AS token,
         n.cut_ms, row_number() OVER (PARTITION BY {nk}, t.utt_idx, t.end_ms > n.cut_ms
                                      ORDER BY t.start_ms, t.tok_idx) AS nth
  FROM tok t JOIN {near} n USING (conv_id, utt_idx)),
{name}1 AS (
  SELECT {k}, utt_idx, b, tok_idx, start_ms, end_ms, speaker, token, 'asr' AS kind FROM {name}0
  WHERE cut_ms IS NULL OR end_ms <= cut_ms
  UNION ALL
  SELECT {k}, utt_idx, b, tok_idx, cut_ms, cut_ms, speaker, token, 'overlap' FROM {name}0
  WHERE end_ms > cut_ms AND nth = 1
  UNION ALL
  SELECT {k}, utt_idx, 1, 0, end_ms, end_ms, speaker, '<' || kind || '>', kind
  FROM (SELECT *, {BOUNDARY} AS kind FROM {near}) WHERE kind IS NOT NULL),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY start_ms,
           CASE WHEN kind IN ('asr', 'overlap') THEN 0 WHEN kind IN ('pause', 'silence') THEN 2
                ELSE 1 END, utt_idx, b, tok_idx) - 1 AS seq
  FROM {name}1)"""


def two_state_sql(keys=("conv_id",), near="near", name="evt"):
    k = ", ".join(keys)
    nk = ", ".join(f"n.{c}" for c in keys)
    return f"""
{name}1 AS (
  SELECT {nk}, t.utt_idx, 0 AS b, t.tok_idx, t.start_ms, t.end_ms, n.speaker, t.text AS token,
         'asr' AS kind
  FROM tok t JOIN {near} n USING (conv_id, utt_idx)
  UNION ALL
  SELECT {k}, utt_idx, 1, 0, end_ms, end_ms, speaker, '<' || two_state || '>', two_state
  FROM {near}),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY start_ms, utt_idx, b, tok_idx) - 1 AS seq
  FROM {name}1)"""


def placed_sql(keys, src="win", evt="evt", chunk=2000, inclusive=True, name="placed"):
    """Events with chunk numbers, past-the-end ones dropped."""
    k = ", ".join(keys)
    num = (
        f"CAST(ceil((eff - span_start) / {chunk}) AS BIGINT)"
        if inclusive
        else f"CAST(floor((eff - span_start) / {chunk}) AS BIGINT) + 1"
    )
    return f"""
span AS (
  SELECT {k}, min(lo) AS span_start, max(hi) AS span_end FROM (
    SELECT {k}, speaker, min(start_ms) AS lo, arg_max(end_ms, start_ms * 100000000 + end_ms) AS hi
    FROM {src} GROUP BY {k}, speaker) GROUP BY {k}),
{name} AS (
  SELECT * FROM (
    SELECT *, greatest(1, {num}) AS k,
           greatest(1, CAST(ceil((span_end - span_start) / {chunk}) AS BIGINT)) AS n_chunks
    FROM (SELECT e.*, s.span_start, s.span_end,
                 max(end_ms) OVER (PARTITION BY {', '.join('e.' + c for c in keys)} ORDER BY seq) AS eff
          FROM {evt} e JOIN span s USING ({k})))
  WHERE k <= n_chunks)"""


def text_sql(keys, src="placed", mode="full", name="txt"):
    """Serialised text per (record, k)."""
    spoken, marks, needed = {
        "full": ("asr", ("bc", "silence", "pause", "ts", "te"), None),
        "two_state": ("asr", ("ts", "te"), "asr"),
        "events_only": ("bc", ("ts", "te", "silence", "pause"), "bc"),
    }[mode]
    k = ", ".join(keys)
    shown = in_list((spoken,) + tuple(marks))
    need = "" if needed is None else f" HAVING count(CASE WHEN kind = '{needed}' THEN 1 END) > 0"
    return f"""
{name}0 AS (
  SELECT *, coalesce(lag(kind || speaker) OVER w = '{spoken}' || speaker, false) AS cont,
         coalesce(lead(kind || speaker) OVER w = '{spoken}' || speaker, false) AS goes
  FROM {src} WHERE kind IN {shown}
  WINDOW w AS (PARTITION BY {k}, k ORDER BY seq)),
{name} AS (
  SELECT {k}, k, string_agg(CASE WHEN kind = '{spoken}' THEN
           CASE WHEN cont THEN '' ELSE '<speaker_' || speaker || '>' END || token
           || CASE WHEN goes THEN '' ELSE '</speaker_' || speaker || '>' END
         ELSE '<' || kind || '>' END, '' ORDER BY seq) AS text
  FROM {name}0 GROUP BY {k}, k{need})"""


def turns_sql(keys, src="txt", chunk=2000, strict=False, name="turns"):
    """Chunked conversation: silent chunks filled, the tail trimmed."""
    k = ", ".join(keys)
    grid = f"""
{name}0 AS (
  SELECT {k}, k, coalesce(t.text, ' ...') AS text FROM (
    SELECT {k}, unnest(range(1, top + 1)) AS k
    FROM (SELECT {k}, max(k) AS top FROM {src} GROUP BY {k}))
  LEFT JOIN {src} t USING ({k}, k))"""
    if not strict:
        return grid + f""",
{name} AS (SELECT * FROM {name}0)"""
    return grid + f""",
{name} AS (
  SELECT {k}, k, CASE WHEN k = top THEN regexp_replace(text, ' \\.\\.\\.$', '') ELSE text END AS text
  FROM (SELECT *, max(CASE WHEN text <> ' ...' AND text <> prev THEN k END)
                    OVER (PARTITION BY {k}) AS top
        FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY {k} ORDER BY k), '') AS prev
              FROM {name}0))
  WHERE k <= top)"""
