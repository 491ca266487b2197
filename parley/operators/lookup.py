"""Joins of a large table to one with a single row per key, safe for a hot key.

A key that holds a large share of the big side would put that share into one join task. Rows of
such keys get a salt, and the single row of the other side is copied once per salt; all other
keys join as they are. The salt comes from the row's content, so a task that is run again sends
its rows to the same place.
"""

from pyspark.sql import functions as F

from parley.operators.scan import HOT_ROWS, SEG_ROWS, largest_keys, null_safe_join


def _hashable(df):
    simple = ("map", "variant")
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in simple]


def lookup_join(df, small, on, how="inner", stats=None, hot_rows=None, seg_rows=None):
    """``df`` joined to ``small`` (unique on ``on``); how is inner, left, left_semi or left_anti.

    ``stats`` may be a table that is cheaper to count than ``df`` and has about its keys.
    """
    on = [on] if isinstance(on, str) else list(on)
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    seg_rows = SEG_ROWS if seg_rows is None else seg_rows
    hot = largest_keys(df if stats is None else stats, on, hot_rows)
    hot = hot.select(*on, F.ceil(F.col("__n") / seg_rows).cast("int").alias("__salts"))
    salt = F.pmod(F.xxhash64(*_hashable(df)), F.col("__salts")).cast("int")
    # A null key matches nothing but may be hot all the same.
    left = null_safe_join(df, F.broadcast(hot), on).withColumn(
        "__salt", F.coalesce(salt, F.lit(0))
    )
    copies = F.sequence(F.lit(0), F.coalesce(F.col("__salts") - 1, F.lit(0)))
    right = small.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(copies))
    out = left.drop("__salts").join(right.drop("__salts"), on + ["__salt"], how)
    return out.drop("__salt")
