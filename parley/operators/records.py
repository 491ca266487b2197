"""Windows of consecutive lines and the dialogue records built from them.

A record holds a handful of lines, so everything inside one is keyed by (conv_id, win_id): a long
conversation spreads over as many groups as it has windows.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.text import tag_utterance
from parley.operators import dialogue as D
from parley.operators.scan import positions

RECORD = ("conv_id", "win_id")


def record_windows(df, length, overlap=False, by=("conv_id",), idx="utt_idx", complete=True):
    """Rows copied into the windows of ``length`` lines they belong to (column ``win_id``).

    Windows step by one line with ``overlap``, else by their length; an incomplete tail is left
    out. ``win_id`` is the index of the first line divided by the step. ``idx`` must be dense.
    """
    at = F.col(idx)
    if overlap:
        first = F.greatest(at - (length - 1), F.lit(0))
        out = df.withColumn("win_id", F.explode(F.sequence(first.cast("long"), at.cast("long"))))
    else:
        out = df.withColumn("win_id", F.floor(at / length).cast("long"))
    if not complete:
        return out
    # Ordered although a count needs no order: the sort then serves the windows that follow.
    whole = W.partitionBy(*by, "win_id").orderBy(idx)
    size = F.count(F.lit(1)).over(
        whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    return out.withColumn("__size", size).where(F.col("__size") == length).drop("__size")


def context_windows(df, n=1, by=RECORD, other_channel=True):
    """Every run of ``n`` lines by (start, end): span and members in order.

    Runs without a positive span are left out for n > 1 as for n = 1. With
    ``other_channel=False`` (single lines only) a column ``channel`` names the one channel in use.
    """
    order = W.partitionBy(*by).orderBy("start_ms", "end_ms", "utt_idx")
    members = F.collect_list(F.struct("utt_idx", "speaker", "start_ms", "end_ms", "text")).over(
        order.rowsBetween(0, n - 1)
    )
    out = df.select(
        *by,
        (F.row_number().over(order) - 1).cast("long").alias("ctx_id"),
        F.col("start_ms").alias("span_start"),
        F.lead("end_ms", n - 1).over(order).alias("span_end"),
        *([] if other_channel else [F.col("speaker").alias("channel")]),
        members.alias("members"),
    )
    out = out.where(F.col("span_end").isNotNull())
    return out.where(F.col("span_end") > F.col("span_start")) if other_channel else out


def record_events(utts, tokens, length, overlap=False, parity=True, label_parity=False):
    """Event streams of all record windows; lines outside a window are not seen."""
    wins = record_windows(utts, length, overlap)
    return D.event_stream(
        wins, tokens, RECORD, split=False, parity=parity, label_parity=label_parity
    )


def record_utterances(utts, length, overlap=False, label_parity=False):
    """Flagged lines of all record windows."""
    wins = record_windows(utts, length, overlap)
    return D.annotate(wins, RECORD, split=False, parity=label_parity)


def dialogue_records(utts, tokens, length, overlap=False, parity=True, label_parity=False):
    """One row per window: conversation id, flagged utterances and event stream, in order."""
    lines = (
        record_utterances(utts, length, overlap, label_parity)
        .groupBy(*RECORD)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("utt_idx", "speaker", "start_ms", "end_ms", "text", *D.FLAGS)
                )
            ).alias("utterances")
        )
    )
    stream = (
        record_events(utts, tokens, length, overlap, parity, label_parity)
        .groupBy(*RECORD)
        .agg(
            F.sort_array(
                F.collect_list(F.struct("seq", "start_ms", "end_ms", "speaker", "token", "kind"))
            ).alias("stream")
        )
    )
    return lines.join(stream, list(RECORD))


def record_span(utts, by=RECORD):
    """Audio span of a record: earliest start, and the latest end of the speakers' last
    intervals by (start, end)."""
    per_speaker = utts.groupBy(*by, "speaker").agg(
        F.min("start_ms").alias("s"),
        F.max(F.struct("start_ms", "end_ms")).alias("last"),
    )
    return per_speaker.groupBy(*by).agg(
        F.min("s").alias("span_start"),
        F.max("last.end_ms").alias("span_end"),
        F.count(F.lit(1)).alias("n_speakers"),
    )


def tagged_utterances(annotated, tags=True):
    """Tagged text per utterance; blank ones are left out."""
    flags = {
        "ts": "is_turn_taking",
        "bc": "is_back_channel",
        "pause": "is_pause",
        "silence": "is_silence",
        "te": "is_turn_ending",
    }
    out = annotated.withColumn(
        "tagged", tag_utterance(F.col("speaker"), F.col("text"), flags if tags else None)
    )
    return out.where(F.col("tagged").isNotNull())


def dense_index(df, by=("conv_id",), order=("utt_idx",), name="utt_idx", **kw):
    """Renumber lines densely after a filter."""
    return positions(
        df.withColumnsRenamed({c: f"__{c}" for c in order}),
        by,
        [f"__{c}" for c in order],
        name=name,
        **kw,
    ).drop(*[f"__{c}" for c in order])
