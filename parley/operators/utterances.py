"""Tokens and utterances: grouping, bounds, cleaning, channel merging."""

from pyspark.sql import functions as F

from parley import model as M
from parley.functions import text as X
from parley.operators.scan import Run, positions, running, segment

TOKEN_ORDER = ["start_ms", "utt_idx", "tok_idx"]


def group_into_utterances(tokens, gap_ms=M.UTTERANCE_GAP, by=("conv_id",), order=None, **kw):
    """Number utterances in a time-ordered token stream (column ``group_idx``).

    A new one starts when the speaker changes or more than ``gap_ms`` pass since the end of the
    token before.
    """
    by, order = list(by), list(order or TOKEN_ORDER)
    data, hot = segment(tokens, by, order[0], **kw)
    before = F.struct("speaker", "end_ms")
    data = running(data, by, order, {"__before": Run("last", before, False)}, hot=hot)
    new = (
        F.col("__before").isNotNull()
        & (
            (F.col("__before.speaker") != F.col("speaker"))
            | (F.col("start_ms") - F.col("__before.end_ms") > gap_ms)
        )
    ).cast("long")
    data = running(data, by, order, {"group_idx": Run("sum", new)}, hot=hot)
    return data.drop("__before", "__seg")


def utterances_from_tokens(tokens, by=("conv_id", "utt_idx"), keep=()):
    """Bounds and text per utterance: start of the first token, end of the last one by start."""
    at = F.struct("start_ms", "tok_idx")
    words = F.sort_array(F.collect_list(F.struct("start_ms", "tok_idx", "text")))
    return tokens.groupBy(*by).agg(
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", at).alias("end_ms"),
        F.count(F.lit(1)).alias("n_tokens"),
        F.array_join(F.transform(words, lambda w: w["text"]), "").alias("text"),
        *[F.first(c).alias(c) for c in keep],
    )


def clean_transcript(df):
    """Segments with noise marks removed and their duration; empty ones are dropped."""
    return (
        df.withColumn("text", X.clean_text("text"))
        .where(F.col("text").isNotNull())
        .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    )


def drop_empty(df, stream="text_stream"):
    return df.where(F.size(stream) > 0)


def drop_degenerate(df):
    return df.where(F.col("end_ms") > F.col("start_ms"))


def split_channel(manifest, name="name"):
    """Base name and channel of ``<base>_a`` / ``<base>_b`` names."""
    name = F.col(name)
    return manifest.withColumns(
        {
            "base": F.regexp_extract(name, "^(.*)_[ab]$", 1),
            "channel": F.upper(F.regexp_extract(name, "_([ab])$", 1)),
        }
    ).where(F.col("channel") != "")


def pair_channels(manifest):
    """(pairs, unmatched): bases with both channels, and A channels without a B."""
    cols = [c for c in manifest.columns if c not in ("base", "channel")]

    def side(channel):
        return manifest.where(F.col("channel") == channel).select(
            "base", *[F.col(c).alias(f"{channel.lower()}_{c}") for c in cols]
        )

    a, b = side("A"), side("B")
    return a.join(b, "base"), a.join(b.select("base"), "base", "left_anti")


def merge_channels(a, b, by=("conv_id",), start="start_ms", idx="src_idx", **kw):
    """A rows then B rows of each conversation in one order by start; ``utt_idx`` is new."""
    both = a.withColumn("channel", F.lit("A")).unionByName(b.withColumn("channel", F.lit("B")))
    return positions(both, by, [start, "channel", idx], name="utt_idx", x=start, **kw)


def merge_counts(merged, by=("conv_id",)):
    return merged.groupBy(*by).agg(
        F.count(F.when(F.col("channel") == "A", 1)).alias("n_a"),
        F.count(F.when(F.col("channel") == "B", 1)).alias("n_b"),
        F.count(F.lit(1)).alias("n_total"),
    )


def to_chat_records(segments, drop_last=False, by="file", order="line"):
    """One two-message chat record per segment.

    ``drop_last`` leaves out the last row of each file, for files that end in a record which
    stands in for a seek footer.
    """
    if drop_last:
        last = segments.groupBy(by).agg(F.max(order).alias(order))
        segments = segments.join(last, [by, order], "left_anti")
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")

    def message(role, kind, audio, start, end, text):
        return F.struct(
            F.lit(role).alias("role"),
            F.array(
                F.struct(
                    F.lit(kind).alias("type"),
                    audio.alias("audio"),
                    start.alias("start"),
                    end.alias("end"),
                    text.alias("text"),
                )
            ).alias("content"),
        )

    return segments.withColumn(
        "messages",
        F.array(
            message(
                "user",
                "audio",
                F.col("audio_path"),
                F.col("start"),
                F.col("end"),
                none_s,
            ),
            message("assistant", "text", none_s, none_d, none_d, F.col("text")),
        ),
    )
