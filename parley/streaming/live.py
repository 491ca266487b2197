"""Structured Streaming forms of the chunk, utterance, tagging, label and score operators.

The stateful ones are in ``processors``; a stream that uses them is started in a session that is
``prepared``. How many rows of a conversation come in one trigger is up to the source
(``maxFilesPerTrigger``, ``maxBytesPerTrigger``).

Event time is a timestamp column ``ts`` made from the millisecond columns. All functions take and
return (streaming) DataFrames; the caller picks sink, trigger and checkpoint folder.
"""

import pandas as pd
from pyspark.sql import functions as F

from parley import model as M
from parley.functions import tagged as G
from parley.operators import dialogue as D
from parley.streaming import processors as P

IDLE = "7 days"
TOGETHER = 1024  # state keys; a trigger's rows and the open conversations of one are held in memory at a time
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark):
    """Set the session's state store to the one that the stateful forms need, writing changes, not copies.

    Making a stateful form does it; a stream that is started later from another session needs it again.
    """
    spark.conf.set(PROVIDER, ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def with_event_time(df, ms="end_ms", name="ts", shift_ms=1):
    """Event time from milliseconds. A stream starts with watermark 0 and takes rows at or before
    the watermark as late, hence the shift: time 0 has to come after it."""
    return df.withColumn(name, F.timestamp_millis(F.col(ms) + shift_ms))


def _key_fields(df, by):
    """Schema text of the key columns, of whatever type the input has."""
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


def _whole_numbers(df, by):
    return [c for c in by if df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")]


def _milliseconds(interval):
    """Milliseconds of a text like "7 days"; None for never."""
    return None if interval is None else int(pd.Timedelta(interval).total_seconds() * 1000)


def _stateful(df, by, processor, fields, delay):
    """Rows of ``by`` and ``fields``; conversations are dealt to ``TOGETHER`` state keys by their hash."""
    prepared(df.sparkSession)
    rows = with_event_time(df, "start_ms").withWatermark("ts", delay)
    rows = rows.withColumn("_together", F.pmod(F.xxhash64(*by), F.lit(TOGETHER)))
    # In a frame, a whole number beside a null is a float: as keys they go as text.
    numbers = {c: df.schema[c].dataType for c in _whole_numbers(df, by)}
    rows = rows.withColumns({c: F.col(c).cast("string") for c in numbers}) if numbers else rows
    schema = f"{_key_fields(rows, by)}, {fields}"
    out = rows.groupBy("_together").transformWithStateInPandas(P.Together(processor, by), schema, "append", "EventTime")
    return out.withColumns({c: F.col(c).cast(t) for c, t in numbers.items()}) if numbers else out


def chunk_text(events, chunk_ms=M.CHUNK_MS, delay="10 seconds", mode="full", by=("conv_id",), idle=IDLE):
    """Tagged text per conversation and chunk ``k``, as soon as the chunk can get no more events.

    The rule is that of ``chunks.assign_chunks``: events count in ``seq`` order, which has to be an order
    of their starts, with the largest end so far, and chunks are counted from the conversation's first
    event. An event waits until the watermark has passed its start; one that arrives behind the watermark
    is dropped. How many chunks a conversation has is not known while it runs, so none are cut off at its
    end. A row without a ``kind`` ends its conversation at its ``start_ms``, as does event time without a
    row for ``idle``: nothing is kept of it, and a later event would begin a new one.
    """
    by = list(by)
    item = "struct<seq:bigint,kind:string,speaker:string,token:string>"
    processor = P.Chunks([*by, "k", "items"], chunk_ms, _milliseconds(idle))
    chunks = _stateful(events, by, processor, f"k long, items array<{item}>", delay)
    return chunks.select(*by, "k", G.serialise(F.col("items"), mode).alias("text"))


def sessions(tokens, gap_ms=M.UTTERANCE_GAP, delay="10 seconds"):
    """Runs of one speaker's tokens without a pause, by start times (no speaker-change rule)."""
    return (
        with_event_time(tokens, "start_ms")
        .withWatermark("ts", delay)
        .groupBy(
            "conv_id", "speaker", F.session_window("ts", f"{gap_ms} milliseconds").alias("w")
        )
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.max("end_ms").alias("end_ms"),
            F.count(F.lit(1)).alias("n_tokens"),
        )
        .drop("w")
    )


def utterances(tokens, gap_ms=M.UTTERANCE_GAP, delay="10 seconds"):
    """Utterances by the exact rule: a new one on a speaker change or a gap.

    Tokens wait in the state until the watermark shows that none can come before them. A token
    that arrives behind the watermark is dropped.
    """
    names = ["speaker", "start_ms", "end_ms", "n_tokens", "text"]
    fields = "speaker string, start_ms long, end_ms long, n_tokens long, text string"
    return _stateful(tokens, ["conv_id"], P.Utterances(["conv_id", *names], gap_ms), fields, delay)


MATE = ["utt_idx", "start_ms", "end_ms", "n_tokens"]


def tagged_utterances(utts, delay="10 seconds", idle=IDLE):
    """Boundary event of each utterance as soon as it is settled.

    Lines come in ``utt_idx`` order, which has to be an order of their starts. An utterance waits until the
    watermark has passed its end by the longest look-ahead and the next line is known (for a labelled
    backchannel also the other speaker's next line). A row without a speaker says that its conversation
    has ended before its ``start_ms``; then the lines that still wait are settled without a next one, as they
    are when event time has gone on for ``idle`` without a row (None: never). The stateful step only finds
    the neighbours; the rules are the batch ones.
    """
    horizon = max(M.SWITCH_GAP, M.RESUME_WINDOW, M.SILENCE_THRESHOLD)
    names = ["conv_id", *[c.split()[0] for c in P.Neighbours.LINE.split(", ")]]
    processor = P.Neighbours(names, horizon, M.DEFAULT_LABEL, _milliseconds(idle))
    near = _stateful(utts, ["conv_id"], processor, P.Neighbours.LINE, delay)

    def mate(which):
        cols = [F.col(f"{which}_{c}").alias(c) for c in MATE]
        return F.when(F.col(f"{which}_utt_idx").isNotNull(), F.struct(*cols))

    near = near.withColumns(
        {
            "next": F.when(
                F.col("next_speaker").isNotNull(),
                F.struct(
                    F.col("next_speaker").alias("speaker"),
                    F.col("next_start").alias("start_ms"),
                    F.col("next_end").alias("end_ms"),
                ),
            ),
            "next_same": mate("same"),
            "next_other": mate("other"),
        }
    )
    return near.select("conv_id", "utt_idx", "end_ms", D.boundary().alias("kind"))


def label_counts(labels, window="1 hour", delay="10 minutes", ts="ts"):
    """Labels per window; rows behind the watermark are dropped."""
    return (
        labels.withWatermark(ts, delay)
        .groupBy(
            F.window(ts, window).alias("w"),
            F.coalesce("label", F.lit(M.DEFAULT_LABEL)).alias("label"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "label", "n")
    )


def score_totals(scored, window="1 hour", delay="10 minutes", ts="ts"):
    """Error rate and event-token F1 by rank and window, from scored results."""
    out = (
        scored.withWatermark(ts, delay)
        .groupBy(
            F.window(ts, window).alias("w"),
            F.coalesce(F.col("rank").cast("string"), F.lit("unknown")).alias("rank"),
        )
        .agg(
            F.count(F.lit(1)).alias("turns"),
            *[F.sum(c).alias(c) for c in ("edits", "ref_chars", "tp", "fp", "fn")],
        )
    )
    _, _, f1 = G.prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    return out.select(
        F.col("w.start").alias("window_start"),
        "rank",
        "turns",
        "edits",
        "ref_chars",
        "tp",
        "fp",
        "fn",
        G.cer(F.col("edits"), F.col("ref_chars")).alias("cer"),
        f1.alias("f1"),
    )


def run_to_files(stream, path, checkpoint, mode="append"):
    """Process all available input into Parquet files and wait for the end."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return path
