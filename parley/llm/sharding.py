"""Weighted rendezvous hashing of stable record keys.

Every (key, shard) pair gets a score from a hash of both; a key goes to the shard of the highest
score. A shard's scores do not depend on the other shards, so a new shard takes keys only into
itself, and as many as its weight asks for. The score ``-weight / ln(u)`` of a uniform ``u`` makes a
shard win in proportion to its weight.
"""

from pyspark.sql import functions as F

from parley.llm.common import number_within, text_crc32


def uniform(key, shard):
    """A number strictly between 0 and 1 from the key's text and the shard number; null is ''."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard)))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key, weights):
    """Column with the shard (0 .. n-1) of a key, for a list of positive weights.

    Equal scores go to the smaller shard number. A shard of weight 0 takes no key.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be non-negative, and one positive")
    best, shard = None, None
    for k, weight in enumerate(weights):
        if not weight:
            continue
        score = -F.lit(float(weight)) / F.log(uniform(key, k))
        if best is None:
            best, shard = score, F.lit(k)
        else:
            shard, best = F.when(score > best, F.lit(k)).otherwise(shard), F.greatest(best, score)
    return shard.cast("int")


def assign(df, key="doc_id", weights=(1.0,) * 8, shard="shard"):
    """``df`` with one more column, the shard of each row's key. No shuffle.

    Rows of one key share a shard; a null key is a key too. To keep rows that belong together in one
    shard, pass a column that they share, such as a digest of their text.
    """
    return df.withColumn(shard, rendezvous(F.col(key), list(weights)))


def sharded(df, key="doc_id", text="text", weights=(1.0,) * 8, grown=1.0, buckets=1024):
    """Shard and place of every row, and its shard once a shard of weight ``grown`` is added.

    Law ``key``: the key and the shard list alone decide. ``size`` is the text's UTF-8 bytes (null:
    none) plus 1. ``slot`` numbers a shard's rows from 0 without gaps; repeated rows get slots of
    their own. Only key, size and checksum are shuffled, never the text. Empty tables give none.
    """
    slim = df.select(
        F.col(key).alias("key"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"),
        text_crc32(F.col(text)).alias("crc"),
    )
    slim = slim.select((F.col("bytes") + 1).alias("size"), F.col("crc"), F.col("key"))
    slim = assign(slim, "key", weights)
    placed = number_within(slim, ["shard"], ["key", "size", "crc"], buckets)
    return placed.withColumn("grown_shard", rendezvous(F.col("key"), [*weights, grown])).withColumnRenamed(
        "position", "slot"
    )


def documents_query(docs, shards=8):
    """op1: all documents in shards 0 to 7, law ``key``."""
    return sharded(docs, weights=[1.0] * shards).select(
        F.col("key").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
