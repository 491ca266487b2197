"""Exact deduplication with a heavy-hitter split.

Digests of a third of all rows must not meet in one task. Each task runs Misra-Gries with ``counters``
counters over its digests; the summaries are added up and cut back to ``counters`` digests, which are
sure to include every digest with more than rows / (counters + 1) copies. Their exact counts and
winners are then computed with map-side combining, and the verified ones, at most ``counters`` rows,
are broadcast: their rows leave the data map-side. All other digests go through an ordinary shuffle.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from parley.llm.common import materialise, spread, tree_merge

COUNTERS = 2048


def misra_gries(batches, counters):
    """Summary of a stream of arrays of values: {value: lower bound of its count}."""
    held = {}
    for values in batches:
        for value, n in values.items():
            held[value] = held.get(value, 0) + n
        if len(held) > counters:
            held = reduced(held, counters)
    return held


def reduced(held, counters):
    """Take the (counters + 1)-th largest count off all; what stays above 0 is at most ``counters``."""
    cut = sorted(held.values(), reverse=True)[counters]
    return {k: n - cut for k, n in held.items() if n > cut}


def _frame(held):
    return pd.DataFrame({"digest": np.array(list(held), object), "n": np.array(list(held.values()), np.int64)})


def heavy_digests(digests, counters=COUNTERS):
    """At most ``counters`` digests, among them all with over rows / (counters + 1) copies.

    Tasks' summaries are added in a tree, a group of 64 tasks at a time, and cut back after each step.
    """

    def summaries(frames):
        held = misra_gries((f["digest"].value_counts().to_dict() for f in frames), counters)
        yield _frame(held)

    def merged(frame):
        total = frame.groupby("digest")["n"].sum().to_dict()
        if len(total) > counters:
            total = reduced(total, counters)
        return _frame(total)

    part = digests.select("digest").mapInPandas(summaries, "digest string, n long")
    return tree_merge(part.withColumn("_task", F.spark_partition_id()), merged).select("digest")


def winners(digests):
    """Per digest: the largest ``key`` as ``keep_id``, and the number of rows as ``group_size``."""
    return digests.groupBy("digest").agg(
        F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def verified(digests, counters=COUNTERS):
    """Exact winners of the heavy digests with over one copy: at most ``counters`` rows."""
    heavy = heavy_digests(digests, counters)
    rows = digests.join(F.broadcast(heavy), "digest", "left_semi")
    return materialise(winners(rows).filter("group_size > 1"), "heavy")


def resolve(digests, counters=COUNTERS):
    """(key, digest) rows to (key, digest, keep_id, group_size, kept).

    The row with the largest key stays; a null key is smaller than any other. Of rows that repeat key
    and text, one stays. ``digests`` should be a written table: it is read several times.
    """
    heavy = F.broadcast(verified(digests, counters))
    cols = ["key", "digest", "keep_id", "group_size"]
    hot = digests.join(heavy, "digest").select(*cols)
    rest = digests.join(heavy, "digest", "left_anti")
    other = winners(rest).withColumnRenamed("digest", "_digest")
    cold = rest.join(other, F.col("digest") == F.col("_digest")).select(*cols)
    rows = hot.unionByName(cold)
    loser = ~F.col("key").eqNullSafe(F.col("keep_id"))
    lost = rows.filter(loser).withColumn("kept", F.lit(False))
    first = rows.filter(~loser).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    first = spread(first, cols, "n", "_copy").select(*cols, (F.col("_copy") == 0).alias("kept"))
    return lost.unionByName(first)


def with_digest(df, key="doc_id", text="text"):
    """(key, digest): lowercase SHA-256 of the text's UTF-8 bytes; null counts as empty."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    return df.select(F.col(key).alias("key"), digest.alias("digest"))


def deduplicated(df, key="doc_id", text="text", counters=COUNTERS):
    """Rows of ``df`` that stay, all columns as they are."""
    digests = materialise(with_digest(df, key, text), "digests")
    mark = "__"
    while {mark + "digest", mark + "keep", mark + "size"} & set(df.columns):
        mark += "_"
    by, keep, size = mark + "digest", mark + "keep", mark + "size"
    found = verified(digests, counters).toDF(by, keep, size)
    heavy, names = F.broadcast(found), df.columns
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    rows = df.withColumn(by, digest)
    stays = F.col(key).eqNullSafe(F.col(keep))
    hot = rows.join(heavy, by).filter(stays).select(*names, by)
    cold = rows.join(heavy, by, "left_anti")
    rest = digests.join(heavy.select(F.col(by).alias("digest")), "digest", "left_anti")
    repeated = winners(rest).filter("group_size > 1").toDF(by, keep, size)
    cold = cold.join(repeated, by, "left")
    single = cold.filter(F.col(size).isNull()).select(*names)
    winner = cold.filter(F.col(size).isNotNull() & stays).select(*names, by)
    # Rows that repeat key and text: one of them.
    return single.unionByName(hot.unionByName(winner).dropDuplicates([key, by]).select(*names))


def documents_query(docs, counters=COUNTERS):
    """op5: keep_id, group_size and kept of every document."""
    digests = materialise(with_digest(docs), "digests")
    return resolve(digests, counters).select(
        F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )
