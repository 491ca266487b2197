"""Helpers that several operators share."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parley.session import scratch_dir


def reachable(spark):
    """Let Python workers import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    places = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in places:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, places)])


def materialise(df, name):
    """Write a table to the shared scratch folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_crc32(col):
    """CRC-32 of a text's UTF-8 bytes as an unsigned long; null counts as empty."""
    return F.crc32(F.coalesce(col, F.lit("")).cast("binary"))


def crc32_mod(key, n):
    """crc32 of a key's decimal text modulo ``n``; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def binary_values(column):
    """(bytes buffer, start offsets, end offsets) of an Arrow string column without nulls in a batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32).astype(np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets[:-1], offsets[1:]


def texts_of(column):
    """UTF-8 bytes of each value of an Arrow string column; null counts as empty."""
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def tree_merge(parts, merge, by=(), fan=64):
    """Merge rows of task summaries, at most ``fan`` tasks' rows in one call, until one is left.

    ``parts`` has an int column ``_task``. ``merge`` takes a pandas frame of a group's rows (equal
    values of ``by``) and returns one with the same columns but ``_task``.
    """
    names = parts.columns
    parts = materialise(parts, "merge")
    tasks = (parts.agg(F.max("_task")).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // fan)
        step = parts.withColumn("_task", F.floor(F.col("_task") / fan).cast("int"))
        out = step.groupBy("_task", *by).applyInPandas(
            lambda key, frame: merge(frame).assign(_task=key[0])[names], parts.schema
        )
        parts = materialise(out, "merge")
        if tasks <= 1:
            return parts.drop("_task")


def running_offset(counts, group, order):
    """Exclusive running sum of ``n`` within ``group``, along ``order``, as ``before``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def number_within(df, group, key, buckets):
    """Number equal rows from 0, gapless, within each value of ``group``.

    ``df`` holds only the columns ``group + key``. Equal rows are counted before they are shuffled and
    given out again at the end, so a key with a third of all rows is one row until then. A group is cut
    into ``buckets`` hash ranges that are numbered apart; a range's first number comes from the counts
    of the ranges before it, so no task holds a whole group. Returns ``group + key + position``.
    """
    from pyspark.sql import Window

    cols = [*group, *key]
    runs = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    w = Window.partitionBy(*group, "_bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_in", F.coalesce(F.sum("n").over(w), F.lit(0)))
    runs = materialise(runs, "numbered")
    counts = runs.groupBy(*group, "_bucket").agg(F.sum("n").alias("n"))
    starts = running_offset(counts, group, ["_bucket"])
    starts = starts.select(*[F.col(c).alias(f"_{c}_") for c in [*group, "_bucket"]], "before")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in [*group, "_bucket"]]
    joined = runs.join(starts, on, "left").select(*cols, "n", (F.col("_in") + F.col("before")).alias("_first"))
    return spread(joined, cols, "n", "_copy").select(*cols, (F.col("_first") + F.col("_copy")).alias("position"))


def spread(df, cols, n, index, step=4096):
    """Repeat each row ``n`` times with ``index`` 0 .. n-1, through short arrays only."""
    outer = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / step)))
    rows = df.withColumn("_block", outer)
    last = F.least(F.col("_block") * step + step, F.col(n)) - 1
    return rows.withColumn(index, F.explode(F.sequence(F.col("_block") * step, last))).drop("_block")
