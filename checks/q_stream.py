"""Streaming forms, run over all available input and compared with their batch counterparts.

The input is written as files in several spans of time, one trigger each, and at last a row that moves
the watermark past everything before it.
"""

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import query
from parley.operators import dialogue as D
from parley.operators import evaluation as E
from parley.operators.records import record_span
from parley.streaming import live

FAR_MS = 10_000_000_000


SLICES, FILES = 3, 4


def _stream(t, name, df, time, tail=None):
    """A stream over ``df`` in ``SLICES`` spans of time, each of some files and a trigger, then ``tail``."""
    path, whole = t.path(name), t.path(name + "_whole")
    schema = df.schema
    df.write.parquet(whole)
    df = t.spark.read.schema(schema).parquet(whole)
    cuts = df.select(F.percentile_approx(time, [k / SLICES for k in range(1, SLICES)])).first()[0]
    bounds = [None, *cuts, None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = df
        if lo is not None:
            part = part.where(F.col(time) >= lo)
        if hi is not None:
            part = part.where(F.col(time) < hi)
        part.repartition(FILES).write.mode("append").parquet(path)
    if tail is not None:
        tail.write.mode("append").parquet(path)
    reader = t.spark.readStream.schema(t.spark.read.parquet(path).schema)
    return reader.option("maxFilesPerTrigger", FILES).parquet(path)


def _run(t, name, stream):
    out = live.run_to_files(stream, t.path(name), t.path(name + "_state"))
    return t.spark.read.schema(stream.schema).parquet(out)


def _tail_row(df, **values):
    """One row with the given values to close all windows."""
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.sparkSession.createDataFrame([tuple(values.get(f.name) for f in df.schema.fields)], names)


@query(
    "st_3_live_chunk_text",
    S.TOK,
    S.near_sql(),
    S.events_sql(),
    S.placed_sql(("conv_id",), src="utt"),
    S.text_sql(("conv_id",)),
    select="SELECT CAST(conv_id AS VARCHAR) AS conv_id, k, text FROM txt",
)
def _(t):
    events = D.event_stream(t.utterances(), t.tokens())
    events = events.withColumn("conv_id", F.col("conv_id").cast("string"))
    tail = _tail_row(events, conv_id="end", start_ms=FAR_MS, end_ms=FAR_MS, seq=0, kind="overlap")
    stream = _stream(t, "events", events, "start_ms", tail)
    out = _run(t, "live_chunks", live.chunk_text(stream)).where("conv_id <> 'end' AND text <> ''")
    # The batch form leaves out what lies past the end of a conversation.
    last = record_span(t.utterances(), ["conv_id"]).select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.greatest(F.lit(1), F.ceil((F.col("span_end") - F.col("span_start")) / 2000)).alias("n"),
    )
    return out.join(last, "conv_id").where("k <= n").select("conv_id", "k", "text")


@query(
    "st_4_live_sessions",
    S.TOK,
    """
gap AS (SELECT *, coalesce(start_ms - lag(start_ms) OVER w > 1000, true) AS opens FROM tok
        WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY start_ms, utt_idx, tok_idx)),
ses AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY conv_id, speaker
               ORDER BY start_ms, utt_idx, tok_idx) AS n FROM gap)""",
    select="""
SELECT conv_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_tokens
FROM ses GROUP BY conv_id, speaker, n""",
)
def _(t):
    toks = t.tokens()
    tail = _tail_row(toks, conv_id=-1, speaker="A", start_ms=FAR_MS, end_ms=FAR_MS)
    out = _run(t, "live_sessions", live.sessions(_stream(t, "tokens", toks, "start_ms", tail)))
    return out.where("conv_id >= 0").select(
        "conv_id", "speaker", "start_ms", "end_ms", "n_tokens"
    )


@query(
    "st_4_live_utterances",
    S.TOK,
    """
g AS (SELECT *, coalesce(speaker <> lag(speaker) OVER w OR start_ms - lag(end_ms) OVER w > 1000,
                         false) AS fresh
      FROM tok WINDOW w AS (PARTITION BY conv_id ORDER BY start_ms, utt_idx, tok_idx)),
h AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY conv_id
               ORDER BY start_ms, utt_idx, tok_idx) AS n FROM g)""",
    select="""
SELECT conv_id, any_value(speaker) AS speaker, min(start_ms) AS start_ms,
       arg_max(end_ms, start_ms * 1000000 + utt_idx * 100 + tok_idx) AS end_ms,
       count(*) AS n_tokens, string_agg(text, '' ORDER BY start_ms, utt_idx, tok_idx) AS text
FROM h GROUP BY conv_id, n""",
)
def _(t):
    toks = t.tokens()
    tail = _tail_row(
        toks, conv_id=-1, utt_idx=0, tok_idx=0, speaker="A", start_ms=FAR_MS, end_ms=FAR_MS, text=""
    )
    out = _run(t, "live_utterances", live.utterances(_stream(t, "tokens", toks, "start_ms", tail)))
    return out.where("conv_id >= 0")


# Pauses of over a minute after every seventh line.
PAUSE = 70_000
PAUSED = f"""
utg AS (SELECT * REPLACE (start_ms + utt_idx // 7 * {PAUSE} AS start_ms, end_ms + utt_idx // 7 * {PAUSE} AS end_ms)
        FROM utt)"""


@query(
    "st_5_live_tagger",
    S.UTT,
    PAUSED,
    S.near_sql("utg"),
    select=f"SELECT CAST(conv_id AS VARCHAR) AS conv_id, utt_idx, end_ms, {S.BOUNDARY} AS kind FROM near",
)
def _(t):
    u = t.utterances()
    pause = F.floor(F.col("utt_idx") / 7).cast("long") * PAUSE
    u = u.withColumns({"start_ms": F.col("start_ms") + pause, "end_ms": F.col("end_ms") + pause})
    u = u.withColumn("conv_id", F.col("conv_id").cast("string"))
    ends = u.groupBy("conv_id").agg((F.max("end_ms") + 1).alias("start_ms"))
    rows = u.unionByName(ends, allowMissingColumns=True)
    tail = _tail_row(rows, conv_id="end", start_ms=FAR_MS)
    out = _run(t, "live_tags", live.tagged_utterances(_stream(t, "utterances", rows, "start_ms", tail)))
    return out.where("conv_id <> 'end'")


@query(
    "st_6_live_label_counts",
    S.UTT,
    select="""
SELECT (start_ms // 60000) * 60000 AS window_ms, coalesce(bc_label, 'non_backchannel') AS label,
       count(*) AS n FROM utt GROUP BY 1, 2""",
)
def _(t):
    u = t.utterances().select("start_ms", F.col("bc_label").alias("label"))
    stream = _stream(t, "labels", u, "start_ms", _tail_row(u, start_ms=FAR_MS, label="none"))
    stream = live.with_event_time(stream, "start_ms", shift_ms=60000)
    out = _run(t, "live_labels", live.label_counts(stream, "60 seconds", "10 seconds"))
    return out.where("label <> 'none'").select(
        (F.unix_millis("window_start") - 60000).alias("window_ms"), "label", "n"
    )


@query(
    "st_7_live_scores",
    S.RES,
    S.scored_sql(),
    select="""
SELECT sample_id // 10 AS part, coalesce(CAST(rank AS VARCHAR), 'unknown') AS rank,
       count(*) AS turns, CAST(sum(edits) AS BIGINT) AS edits,
       CAST(sum(ref_chars) AS BIGINT) AS ref_chars, CAST(sum(tp) AS BIGINT) AS tp,
       round(sum(edits) / greatest(sum(ref_chars), 1), 6) AS cer
FROM scored GROUP BY 1, 2""",
)
def _(t):
    r = t.results()
    stream = _stream(
        t, "results", r, "sample_id", _tail_row(r, sample_id=FAR_MS, turn_id=0, rank=0, pred="", ref="")
    )
    timed = live.with_event_time(E.score(stream), "sample_id", shift_ms=10)
    out = _run(t, "live_scores", live.score_totals(timed, "10 milliseconds", "1 seconds"))
    part = F.unix_millis("window_start") - 10
    return out.where(part < FAR_MS - 10).select(
        F.floor(part / 10).cast("long").alias("part"),
        "rank",
        "turns",
        "edits",
        "ref_chars",
        "tp",
        F.round("cer", 6).alias("cer"),
    )
