"""Ordered scans (running sums, maxima, last values, neighbours) that survive a hot key.

A plain window puts all rows of one key into one task. Keys are counted first, by a job of its own; where
none has more than ``HOT_ROWS`` rows, a plain window is all there is. Otherwise the rows are written once,
and a hot key is cut along its order into segments of about ``SEG_ROWS`` rows. Each segment is summed up
in one row; these few rows, combined along the order, say what every segment inherits from the ones
before it, and are written as well. The rows are then scanned segment by segment, in one pass, and what is
inherited is joined on. All other keys are one segment and inherit nothing.

``x`` names a numeric column that never decreases along ``order``; segments are ranges of it.

Rows are dealt over tasks by their number where it is known, ``TASK_ROWS`` to a task: what a shuffle writes may
be small and still fill a sort's memory.
"""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import written

HOT_ROWS = 2_000_000
SEG_ROWS = 500_000
TASK_ROWS = 1_000_000
MAX_HOT = 1000
GRID = 256

UNB = W.unboundedPreceding


@dataclass
class Run:
    """One running value: ``kind`` is sum, max or last (last skips nulls)."""

    kind: str
    value: Column
    inclusive: bool = True
    reverse: bool = False


def null_safe_join(left, right, on, how="left"):
    """Join on equal columns ``on``, nulls being equal, too; the right side's copies of them go."""
    there = {c: f"__r_{c}" for c in on}
    match = [left[c].eqNullSafe(F.col(there[c])) for c in on]
    return left.join(right.withColumnsRenamed(there), match, how).drop(*there.values())


def largest_keys(df, by, hot_rows):
    """(key, ``__n``) of the keys over ``hot_rows`` rows, at most the ``MAX_HOT`` largest ones.

    Small enough to broadcast whatever the data; a key left out has under rows / MAX_HOT rows.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    return counts.orderBy(F.desc("__n"), *by).limit(MAX_HOT)


def key_counts(df, by, hot_rows):
    """(number of rows, what ``largest_keys`` finds as tuples), by one job."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).withColumn("__less", -F.col("__n"))
    hot = F.collect_list(F.when(F.col("__n") > hot_rows, F.struct("__less", *by)))
    rows, found = counts.agg(F.sum("__n"), F.slice(F.sort_array(hot), 1, MAX_HOT)).first()
    return rows or 0, [(*key, -less) for less, *key in found]


def dealt(df, by, rows, task_rows=None):
    """``df``, of about ``rows`` rows, dealt by key over tasks of ``task_rows`` rows, if one task is not enough.

    With no fewer tasks than the session's shuffles have, so that a join by the key deals the rows no second time.
    """
    task_rows = TASK_ROWS if task_rows is None else task_rows
    if rows is None or rows <= task_rows:
        return df
    spark = df.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(-(-rows // task_rows), least), *by)


def cuts(df, by, x, counts, seg_rows):
    """(key, values of ``x`` at which its segments begin) of the counted keys, by quantiles.

    An outlier in ``x`` moves no border. A key has at most ``GRID`` segments, so this is a small table.
    """
    spark, keys = df.sparkSession, [df.schema[c] for c in by]
    hot = spark.createDataFrame(counts, T.StructType([*keys, T.StructField("__n", T.LongType())]))
    rows = null_safe_join(df.select(*by, F.col(x).alias("__x")), F.broadcast(hot), by, "inner")
    grid = F.percentile_approx("__x", [k / GRID for k in range(1, GRID)], 10 * GRID).alias("__grid")
    many = F.least(F.lit(GRID), F.ceil(F.col("__n") / seg_rows)).cast("int")
    place = lambda k: F.greatest(F.lit(1), F.floor(k * GRID / many)).cast("int")
    begins = F.when(
        many > 1,
        F.array_distinct(F.transform(F.sequence(F.lit(1), many - 1), lambda k: F.get("__grid", place(k) - 1))),
    )
    found = rows.groupBy(*by).agg(F.first("__n").alias("__n"), grid).select(*by, begins.alias("__cuts"))
    return spark.createDataFrame(found.collect(), found.schema)


@dataclass
class Segments:
    """What ``segment`` found: the hot keys with their cuts, or None where there is no hot key."""

    hot: DataFrame | None


def segment(df, by, x, stats=None, hot_rows=None, seg_rows=None):
    """(rows with ``__seg``, ``Segments``): lets several scans share one shuffle.

    ``stats`` may be a table that is cheaper to count than ``df`` and has its keys; it need not hold the
    very same rows. With a hot key the rows come from a written table, and ``__seg`` counts the segments of
    hot keys; it is 0 for all other keys. With ``hot_rows`` infinite nothing is cut, and nothing counted.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    seg_rows = SEG_ROWS if seg_rows is None else seg_rows
    if hot_rows == float("inf"):
        return df.withColumn("__seg", F.lit(0).cast("long")), Segments(None)
    rows, counts = key_counts(df if stats is None else stats, by, hot_rows)
    none = F.lit(0).cast("long")
    if not counts:
        return dealt(df, by, rows).withColumn("__seg", none), Segments(None)
    df = written(df, "rows")
    hot = cuts(df, by, x, counts, seg_rows)
    seg = F.size(F.filter("__cuts", lambda c: c <= F.col(x))).cast("long")
    seg = F.when(F.col("__cuts").isNotNull(), seg).otherwise(none)
    df = null_safe_join(df, F.broadcast(hot), by).withColumn("__seg", seg).drop("__cuts")
    return dealt(df, [*by, "__seg"], rows), Segments(hot)


def _only_hot(df, by, hot):
    keys = hot.select(*[F.col(c).alias(f"__r_{c}") for c in by])
    match = [df[c].eqNullSafe(F.col(f"__r_{c}")) for c in by]
    return df.join(F.broadcast(keys), match, "left_semi")


def _ordered(cols, reverse):
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in cols]


def running(
    df,
    by,
    order,
    runs,
    x=None,
    reverse=False,
    split=True,
    hot=None,
    stats=None,
    hot_rows=None,
    seg_rows=None,
    rows=None,
):
    """Add one column per entry of ``runs`` (name -> Run), scanning ``by`` groups in ``order``.

    ``order`` lists column names and must be total inside a group. With ``split=False`` the
    groups are known to be small (one record, one line of text) and a plain window is used. With the
    ``Segments`` that ``segment`` found as ``hot``, the rows carry ``__seg`` already and keep it. ``rows`` is the
    number of rows, if known; it is counted where groups are cut.
    """
    by, order = list(by), list(order)
    if reverse:
        runs = {n: replace(r, reverse=not r.reverse) for n, r in runs.items()}

    def window(part, cols, run):
        return W.partitionBy(*part).orderBy(*_ordered(cols, run.reverse))

    shared = hot is not None
    if split and not shared:
        df, hot = segment(df, by, x or order[0], stats, hot_rows, seg_rows)
    elif not split:
        df = dealt(df, by, rows)
    if not split or hot.hot is None:
        out = df.withColumns({n: _local(r, window(by, order, r)) for n, r in runs.items()})
        return out if shared or not split else out.drop("__seg")

    values = {f"__v{i}": r.value for i, r in enumerate(runs.values())}
    df = df.withColumns(values)
    parts, carried = [], []
    for i, run in enumerate(runs.values()):
        value = F.col(f"__v{i}")
        across = window(by, ["__seg"], run).rowsBetween(UNB, -1)
        if run.kind == "sum":
            parts.append(F.sum(value).alias(f"__s{i}"))
            carried.append(F.sum(f"__s{i}").over(across).alias(f"__c{i}"))
        elif run.kind == "max":
            parts.append(F.max(value).alias(f"__s{i}"))
            carried.append(F.max(f"__s{i}").over(across).alias(f"__c{i}"))
        else:
            key = F.when(value.isNotNull(), F.struct(*order))
            pick = F.min_by if run.reverse else F.max_by
            parts.append(pick(value, key).alias(f"__s{i}"))
            carried.append(F.last(f"__s{i}", True).over(across).alias(f"__c{i}"))
    sums = _only_hot(df, by, hot.hot).groupBy(*by, "__seg").agg(*parts)
    # A row per segment of a hot key.
    carry = written(sums.select(*by, "__seg", *carried), "carry")
    out = df.withColumns(
        {
            n: _local(replace(r, value=F.col(f"__v{i}")), window(by + ["__seg"], order, r))
            for i, (n, r) in enumerate(runs.items())
        }
    )
    out = null_safe_join(out, carry, by + ["__seg"])
    out = out.withColumns(
        {n: _combine(r.kind, F.col(n), F.col(f"__c{i}")) for i, (n, r) in enumerate(runs.items())}
    )
    out = out.drop(*values, *[f"__c{i}" for i in range(len(runs))])
    return out if shared else out.drop("__seg")


def _local(run, window):
    frame = window.rowsBetween(UNB, 0 if run.inclusive else -1)
    if run.kind == "sum":
        return F.coalesce(F.sum(run.value).over(frame), F.lit(0))
    if run.kind == "max":
        return F.max(run.value).over(frame)
    return F.last(run.value, True).over(frame)


def _combine(kind, local, carry):
    if kind == "sum":
        return local + F.coalesce(carry, F.lit(0))
    if kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)


def positions(df, by, order, name="pos", x=None, **kw) -> DataFrame:
    """Zero-based position of every row in its group."""
    one = F.lit(1).cast("long")
    out = running(df, by, order, {name: Run("sum", one, inclusive=False)}, x=x, **kw)
    return out.withColumn(name, F.col(name).cast("long"))


def neighbours(
    df, by=("conv_id",), idx="utt_idx", split=True, hot_rows=None, seg_rows=None
) -> DataFrame:
    """Previous and next line, next line of the same and of another speaker.

    Adds ``next_is_last`` (the next line ends its group; null without one) and the structs ``prev``, ``next`` (speaker, start_ms, end_ms), ``next_same`` and ``next_other``
    (utt_idx, start_ms, end_ms, n_tokens). One shuffle on (by, segment) serves all four.
    """
    by = list(by)
    line = F.struct("speaker", "start_ms", "end_ms")
    mate = F.struct(F.col(idx).alias("utt_idx"), "start_ms", "end_ms", "n_tokens")
    hot = None
    if split:
        df, found = segment(df, by, idx, None, hot_rows, seg_rows)
        df, hot = (df, found.hot) if found.hot is not None else (df.drop("__seg"), None)
    data, part = df, by + ["__seg"] if hot is not None else by
    ahead = W.partitionBy(*part).orderBy(idx)
    back = W.partitionBy(*part).orderBy(F.col(idx).desc()).rowsBetween(UNB, -1)
    own = W.partitionBy(*part, "speaker").orderBy(idx)
    data = data.withColumns(
        {
            "prev": F.lag(line).over(ahead),
            "next": F.lead(line).over(ahead),
            "next_is_last": F.lead(F.lit(True), 2).over(ahead).isNull(),
        }
    )
    turn = F.col("prev.speaker") != F.col("speaker")
    if split:
        other = F.last(F.when(turn, mate), True).over(back)
    else:
        # Work grows with the square of the group, which is a few lines here; saves a sort.
        other = F.first(F.when(turn, mate), True).over(
            ahead.rowsBetween(1, W.unboundedFollowing)
        )
    data = data.withColumn("next_other", other)
    data = data.withColumn("next_same", F.lead(mate).over(own))
    if hot is None:
        return data.withColumn(
            "next_is_last", F.when(F.col("next").isNotNull(), F.col("next_is_last"))
        )

    # What a hot segment cannot see: the segments around it.
    firsts = written(
        _only_hot(df, by, hot)
        .groupBy(*part, "speaker")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(idx).alias("f_idx"),
            F.min_by("start_ms", idx).alias("f_start"),
            F.min_by("end_ms", idx).alias("f_end"),
            F.min_by("n_tokens", idx).alias("f_n"),
            F.max(idx).alias("l_idx"),
            F.max_by("start_ms", idx).alias("l_start"),
            F.max_by("end_ms", idx).alias("l_end"),
        ),
        "firsts",
    )
    first_mate = F.struct(
        F.col("f_idx").alias("utt_idx"),
        F.col("f_start").alias("start_ms"),
        F.col("f_end").alias("end_ms"),
        F.col("f_n").alias("n_tokens"),
    )
    same = firsts.select(
        *part,
        "speaker",
        F.lead(first_mate).over(W.partitionBy(*by, "speaker").orderBy("__seg")).alias("__same"),
    )
    same = written(same, "same")
    nth = F.row_number().over(W.partitionBy(*part).orderBy("f_idx"))
    edges = (
        firsts.withColumn("__nth", nth)
        .groupBy(*part)
        .agg(
            F.sum("n").alias("n"),
            F.max(F.when(F.col("__nth") == 1, F.col("speaker"))).alias("f_speaker"),
            F.max(F.when(F.col("__nth") == 1, first_mate)).alias("f1"),
            F.max(F.when(F.col("__nth") == 2, first_mate)).alias("f2"),
            F.max(
                F.struct(
                    "l_idx",
                    F.col("speaker"),
                    F.col("l_start").alias("start_ms"),
                    F.col("l_end").alias("end_ms"),
                )
            ).alias("l"),
        )
    )
    segs = W.partitionBy(*by).orderBy("__seg")
    later = W.partitionBy(*by).orderBy(F.col("__seg").desc()).rowsBetween(UNB, -1)
    l_line = F.struct("l.speaker", "l.start_ms", "l.end_ms")
    f_line = F.struct(
        F.col("f_speaker").alias("speaker"),
        F.col("f1.start_ms").alias("start_ms"),
        F.col("f1.end_ms").alias("end_ms"),
    )
    edges = edges.withColumns(
        {
            "__prev": F.lag(l_line).over(segs),
            "__next": F.lead(f_line).over(segs),
            "__next_last": (F.lead("n").over(segs) == 1) & F.lead("n", 2).over(segs).isNull(),
        }
    )
    # First place in a segment where the speaker changes.
    change = F.when(F.col("__prev.speaker") != F.col("f_speaker"), F.col("f1")).otherwise(
        F.col("f2")
    )
    edges = edges.withColumn("__turn", change).select(
        *part, "__prev", "__next", "__next_last", F.last("__turn", True).over(later).alias("__other")
    )
    edges = written(edges, "edges")
    data = null_safe_join(null_safe_join(data, edges, part), same, part + ["speaker"])
    return data.withColumns(
        {
            "next_is_last": F.when(
                F.col("next").isNotNull(), F.col("next_is_last") & F.col("__next").isNull()
            ).otherwise(F.col("__next_last")),
            "prev": F.coalesce("prev", "__prev"),
            "next": F.coalesce("next", "__next"),
            "next_other": F.coalesce("next_other", "__other"),
            "next_same": F.coalesce("next_same", "__same"),
        }
    ).drop("__seg", "__prev", "__next", "__next_last", "__other", "__same")
