"""Fixed-length chunks: which events a chunk completes, its text, and the chunked conversation."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley import model as M
from parley.functions import tagged as G
from parley.operators.lookup import lookup_join
from parley.operators.records import RECORD, record_span
from parley.operators.scan import Run, running


def assign_chunks(
    events, by, chunk_ms, inclusive=True, offset="offset", n_chunks=None, split=False, **kw
):
    """Chunk number ``k`` (from 1) in which each event is released.

    Events are taken in ``seq`` order and a chunk stops at the first one ending after it, so a
    late event holds back all that follow: an event counts with the largest end so far. An end on
    a chunk border belongs to the chunk before it (``inclusive``) or after it. Events past
    ``n_chunks`` are dropped. ``split`` is for groups of any size; records are small.
    """
    reach = {"eff_end": Run("max", F.col("end_ms"))}
    out = running(events, by, ["seq"], reach, x="start_ms", split=split, **kw)
    chunks = (F.col("eff_end") - F.col(offset)) / chunk_ms
    k = F.ceil(chunks) if inclusive else F.floor(chunks) + 1
    out = out.withColumn("k", F.greatest(F.lit(1), k).cast("long")).drop("eff_end")
    return out if n_chunks is None else out.where(F.col("k") <= F.col(n_chunks))


def with_grid(events, utts, by, chunk_ms, split=False, **kw):
    """Events with the start (``offset``) and number of chunks of their record.

    ``split`` is for groups of any size; records are small.
    """
    span = record_span(utts, by).select(
        *by,
        F.col("span_start").alias("offset"),
        F.greatest(F.lit(1), F.ceil((F.col("span_end") - F.col("span_start")) / chunk_ms))
        .cast("long")
        .alias("n_chunks"),
    )
    return lookup_join(events, span, by, **kw) if split else events.join(span, list(by))


def chunk_text(events, by, mode="full"):
    """Tagged text per (record, k)."""
    items = F.sort_array(F.collect_list(F.struct("seq", "kind", "speaker", "token")))
    return (
        events.groupBy(*by, "k")
        .agg(items.alias("items"))
        .select(*by, "k", G.serialise(F.col("items"), mode).alias("text"))
    )


def chunked_conversation(
    events, utts, by=RECORD, chunk_ms=M.CHUNK_MS, mode="full", query="", strict=None
):
    """Turns of the chunked conversation of each record: (k, start_ms, end_ms, query, text).

    A chunk that completes nothing says " ..."; such chunks at the end are left out. The query is
    asked in the first turn only. The stricter forms (``two_state``, ``events_only``) release an
    event one chunk later if it ends on the border, and also drop a last turn that repeats the
    one before it.
    """
    strict = mode != "full" if strict is None else strict
    grid = with_grid(events, utts, by, chunk_ms)
    placed = assign_chunks(
        grid, by, chunk_ms, inclusive=not strict, offset="offset", n_chunks="n_chunks"
    )
    said = chunk_text(placed, by, mode).where(F.col("text") != "")
    order = W.partitionBy(*by).orderBy("k")
    # Each spoken chunk also stands for the silent ones right before it.
    before = F.coalesce(F.lag("k").over(order), F.lit(0))
    turns = said.withColumn("__gap", F.sequence(before + 1, F.col("k"))).select(
        *by,
        F.explode("__gap").alias("turn"),
        F.col("k").alias("__k"),
        F.col("text").alias("__text"),
    )
    turns = turns.select(
        *by,
        F.col("turn").alias("k"),
        F.when(F.col("turn") == F.col("__k"), F.col("__text"))
        .otherwise(M.STREAMING_CONT)
        .alias("text"),
    )
    if strict:
        fresh = F.when(
            (F.col("text") != M.STREAMING_CONT)
            & (F.col("text") != F.coalesce(F.lag("text").over(order), F.lit(""))),
            F.col("k"),
        )
        turns = turns.withColumn("__fresh", fresh)
        turns = turns.withColumn("__last", F.max("__fresh").over(W.partitionBy(*by)))
        turns = turns.where(F.col("k") <= F.col("__last")).withColumn(
            "text",
            F.when(
                F.col("k") == F.col("__last"), F.regexp_replace("text", r" \.\.\.\z", "")
            ).otherwise(F.col("text")),
        ).drop("__fresh", "__last")
    return turns.select(
        *by,
        "k",
        ((F.col("k") - 1) * chunk_ms).alias("start_ms"),
        (F.col("k") * chunk_ms).alias("end_ms"),
        F.when(F.col("k") == 1, F.lit(query)).alias("query"),
        "text",
    )


def time_label(start_ms, end_ms):
    """``Time=a-bs`` with one decimal, rounded half up in milliseconds."""

    def tenths(ms):
        t = F.floor((ms + 50) / 100).cast("long")
        whole = F.floor(t / 10).cast("long")
        return F.concat(whole.cast("string"), F.lit("."), (t % 10).cast("string"))

    return F.concat(F.lit("Time="), tenths(start_ms), F.lit("-"), tenths(end_ms), F.lit("s"))


def chunk_plan(pairs, first_ms, next_ms, a="a_duration_ms", b="b_duration_ms", start_ms=0):
    """Chunk grid of a channel pair with a first chunk of another length.

    The plan ends with the channel that has fewer chunks; the last chunk is as long as what is
    left of channel A.
    """

    def count(d):
        rest = F.greatest(F.ceil((F.col(d) - first_ms) / next_ms), F.lit(0))
        return F.when(F.col(d) > 0, 1 + rest).otherwise(0).cast("long")

    n = F.least(count(a), count(b))
    out = pairs.withColumn("n_chunks", n).where(F.col("n_chunks") > 0)
    out = out.withColumn(
        "chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1))
    )
    i = F.col("chunk_idx")
    begin = F.when(i == 0, F.lit(0)).otherwise(first_ms + (i - 1) * next_ms).cast("long")
    size = F.when(i == 0, F.lit(first_ms)).otherwise(F.lit(next_ms))
    out = out.withColumn("start_ms", begin + start_ms).withColumn(
        "end_ms", (F.least(begin + size, F.col(a)) + start_ms).cast("long")
    )
    return out.withColumn("label", time_label(F.col("start_ms"), F.col("end_ms")))
