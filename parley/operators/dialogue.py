"""Turn-taking events of a dialogue.

Input is one row per utterance with ``next``, ``next_same`` and ``next_other`` from
``scan.neighbours``; every rule is a boolean column on such a row.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley import model as M
from parley.functions.text import is_complete
from parley.operators.scan import dealt, neighbours, positions

KIND_ORDER = {"asr": 0, "overlap": 0, "bc": 1, "ts": 1, "te": 1, "pause": 2, "silence": 2}


def _false(c):
    return F.coalesce(c, F.lit(False))


def _gap(which):
    return F.col(f"{which}.start_ms") - F.col("end_ms")


def overlaps(start_a, end_a, start_b, end_b):
    """Strict overlap of two intervals."""
    return (start_a < end_b) & (start_b < end_a)


def _overlaps(which):
    return overlaps(
        F.col("start_ms"), F.col("end_ms"), F.col(f"{which}.start_ms"), F.col(f"{which}.end_ms")
    )


def _resumes():
    return _false(_gap("next_same") <= M.RESUME_WINDOW)


def backchannel(label="bc_label", parity=False):
    """By label where there is one, else by a short overlapping line of the other speaker.

    With ``parity`` a missing label counts as ``non_backchannel``.
    """
    label = F.col(label)
    if parity:
        label = F.coalesce(label, F.lit(M.DEFAULT_LABEL))
    other = F.col("next_other")
    heuristic = (
        _overlaps("next_other")
        & (other["end_ms"] - other["start_ms"] <= M.BC_MAX_DURATION)
        & (other["n_tokens"] <= M.BC_MAX_TOKENS)
        & F.col("next_same").isNotNull()
        & _resumes()
    )
    labelled = label.isNotNull() & (label != "")
    return F.col("next_other").isNotNull() & _false(
        F.when(labelled, label != M.DEFAULT_LABEL).otherwise(heuristic)
    )


def turn_switch():
    return _false(_gap("next_other") <= M.SWITCH_GAP) & ~_resumes()


def pause():
    gap = _gap("next_same")
    return _false((gap >= M.PAUSE_THRESHOLD) & (gap < M.SILENCE_THRESHOLD))


def silence():
    return _false(_gap("next") >= M.SILENCE_THRESHOLD)


def turn_end(text="text"):
    taken = _false(_gap("next_other").between(0, M.SWITCH_GAP))
    return ~_resumes() & ~taken & is_complete(text)


def boundary(parity=False):
    """The one event at the end of an utterance, or null."""
    return (
        F.when(backchannel(parity=parity), "bc")
        .when(turn_switch(), "ts")
        .when(pause(), "pause")
        .when(silence(), "silence")
        .when(turn_end(), "te")
    )


def two_state_boundary():
    quick = _false(_gap("next_other").between(0, M.SWITCH_GAP))
    return F.when(quick & ~_resumes(), "ts").otherwise("te")


def prev_overlap():
    """The line before has another speaker and overlaps."""
    return _false((F.col("prev.speaker") != F.col("speaker")) & _overlaps("prev"))


def interruption():
    """Start of an overlapping next line by another speaker, else null."""
    return F.when(
        (F.col("next.speaker") != F.col("speaker")) & _overlaps("next"), F.col("next.start_ms")
    )


def with_interruption(utts, by=("conv_id",), idx="utt_idx", parity=True):
    """Column ``cut_ms``; needs the neighbour columns.

    ``parity`` keeps the rule that the line before the last of a group is never cut.
    """
    if not parity:
        return utts.withColumn("cut_ms", interruption())
    return utts.withColumn("cut_ms", F.when(~F.col("next_is_last"), interruption()))


FLAGS = {
    "is_turn_taking": turn_switch,
    "is_pause": pause,
    "is_silence": silence,
    "is_back_channel": backchannel,
    "is_turn_ending": turn_end,
}


def annotate(utts, by=("conv_id",), split=True, turn_ending=True, parity=False, **kw):
    """Independent flags per utterance; ``turn_ending=False`` is the four-flag form."""
    out = neighbours(utts, by, split=split, **kw)
    flags = {
        n: (backchannel(parity=parity) if f is backchannel else f())
        for n, f in FLAGS.items()
        if turn_ending or n != "is_turn_ending"
    }
    return out.withColumns(flags).drop("prev", "next", "next_is_last", "next_same", "next_other")


def _with_lines(tokens, utts, by, idx, *cols, rows=None):
    """Tokens joined to their lines; a window id that tokens lack comes from the lines."""
    key = list(by) + [idx]
    on = [c for c in key if c in tokens.columns]
    lines = utts.select(*key, "speaker", *cols)
    return dealt(tokens.drop("speaker"), on, rows).join(dealt(lines, on, rows), on)


def token_events(utts, tokens, by=("conv_id",), idx="utt_idx", rows=None):
    """Events of the tokens of utterances with ``cut_ms``; ``rows`` is the number of tokens, if known.

    Up to the cut all tokens are spoken; the first one ending after it becomes a zero-length
    overlap event at the cut, the rest is dropped.
    """
    key = list(by) + [idx]
    before = W.partitionBy(*key).orderBy("start_ms", "tok_idx").rowsBetween(W.unboundedPreceding, -1)
    late = _false(F.col("end_ms") > F.col("cut_ms"))
    joined = _with_lines(tokens, utts, by, idx, "cut_ms", rows=rows).withColumn("__late", late)
    joined = joined.withColumn("__past", _false(F.max("__late").over(before)))
    cut = F.col("__late")
    return joined.where(~F.col("__past")).select(
        *key,
        F.lit(0).alias("is_boundary"),
        F.col("tok_idx").cast("long").alias("tok_idx"),
        F.when(cut, F.col("cut_ms")).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(cut, F.col("cut_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
        "speaker",
        F.col("text").alias("token"),
        F.when(cut, "overlap").otherwise("asr").alias("kind"),
    )


def boundary_events(utts, kind, by=("conv_id",), idx="utt_idx"):
    """Events at the end of utterances from a nullable kind column."""
    return (
        utts.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            *by,
            idx,
            F.lit(1).alias("is_boundary"),
            F.lit(0).cast("long").alias("tok_idx"),
            F.col("end_ms").alias("start_ms"),
            "end_ms",
            "speaker",
            F.concat(F.lit("<"), F.col("kind"), F.lit(">")).alias("token"),
            "kind",
        )
    )


def _kind_rank():
    rank = F.lit(2)
    for kind, value in KIND_ORDER.items():
        rank = F.when(F.col("kind") == kind, F.lit(value)).otherwise(rank)
    return rank


def event_stream(utts, tokens, by=("conv_id",), split=True, parity=True, label_parity=False, **kw):
    """Time-ordered event stream with dense ``seq``; ties keep the order of emission."""
    near = neighbours(utts, by, split=split, **kw)
    cut, rows = with_interruption(near, by, parity=parity), tokens.count()
    events = token_events(cut, tokens, by, rows=rows).unionByName(
        boundary_events(near, boundary(parity=label_parity), by)
    )
    events = events.withColumn("kind_rank", _kind_rank())
    order = ["start_ms", "kind_rank", "utt_idx", "is_boundary", "tok_idx"]
    kw["stats"] = tokens
    return positions(events, by, order, name="seq", x="start_ms", split=split, rows=rows, **kw).drop(
        "kind_rank", "is_boundary"
    )


def two_state_stream(utts, tokens, by=("conv_id",), split=True, **kw):
    """Every token, and ``ts`` or ``te`` after every utterance; ordered by start alone."""
    near, rows = neighbours(utts, by, split=split, **kw), tokens.count()
    spoken = _with_lines(tokens, utts, by, "utt_idx", rows=rows).select(
        *by,
        "utt_idx",
        F.lit(0).alias("is_boundary"),
        F.col("tok_idx").cast("long").alias("tok_idx"),
        "start_ms",
        "end_ms",
        "speaker",
        F.col("text").alias("token"),
        F.lit("asr").alias("kind"),
    )
    events = spoken.unionByName(boundary_events(near, two_state_boundary(), by))
    order = ["start_ms", "utt_idx", "is_boundary", "tok_idx"]
    kw["stats"] = tokens
    return positions(events, by, order, name="seq", x="start_ms", split=split, rows=rows, **kw).drop(
        "is_boundary"
    )


def training_text(events, by):
    """Space-joined tokens of a record, ``[X]`` before each turn switch."""
    piece = F.concat(
        F.when(F.col("kind") == "ts", F.concat(F.lit("["), F.col("speaker"), F.lit("]"))).otherwise(
            ""
        ),
        F.col("token"),
    )
    items = F.sort_array(F.collect_list(F.struct("seq", piece.alias("piece"))))
    shown = F.filter(F.transform(items, lambda e: e["piece"]), lambda p: p != "")
    return events.groupBy(*by).agg(F.array_join(shown, " ").alias("text"))
