"""Exact top-k inner products by norm order, partial sums and Cauchy-Schwarz bounds.

Vectors are sorted by descending length and cut into blocks. All are rotated by the singular vectors
of the whole table, so that the first coordinates carry most of every product. A block is walked from
its longest vector on: once |query| * |vector| falls below a query's k-th best score the query is done
with it, and a vector is multiplied out only if the product of the first coordinates plus the product
of both residual lengths reaches that score. A query starts with its k-th best score among the longest
vectors of all. Scores are exact integers.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.llm.common import materialise, tree_merge

BLOCK = 4096
QUERY_BLOCK = 2048
TILE = 256
SALTS = 64
K = 5


def quantised(df, key="vec_id", vector="embedding", scale=256):
    """(key, norm, v): floor(scale * x) of every component as 64-bit integers, one row per key.

    Vectors that are null or hold null or non-finite components take no part, nor do null keys. Rows
    that repeat a key count once; of different vectors of a key the longest one does.
    """

    def run(batches):
        for batch in batches:
            keys, norms, data = [], [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k is None or not x.is_valid or x.values.null_count:
                    continue
                x = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(x).all():
                    continue
                q = np.floor(scale * x).astype(np.int64)
                keys.append(k)
                norms.append(float(np.sqrt((q.astype(np.float64) ** 2).sum())))
                data.append(q.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(norms, pa.float64()), pa.array(data, pa.binary())], names=["key", "norm", "v"]
            )

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    out = rows.mapInArrow(run, "key long, norm double, v binary")
    return out.groupBy("key").agg(F.max(F.struct("norm", "v")).alias("x")).select("key", "x.norm", "x.v")


def matrix(values, width):
    """Rows of 64-bit integers as a matrix, shorter ones filled up with zeros."""
    if all(len(v) == 8 * width for v in values):
        return np.frombuffer(b"".join(values), "<i8").reshape(len(values), width)
    out = np.zeros((len(values), width), np.int64)
    for row, v in zip(out, values):
        row[: len(v) // 8] = np.frombuffer(v, "<i8")
    return out


def rotation(rows, width):
    """Orthogonal matrix of the table's right singular vectors, by descending singular value."""

    def gram(frames):
        total = np.zeros((width, width))
        for frame in frames:
            m = matrix(list(frame["v"]), width).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"g": [total.tobytes()]})

    def add(frame):
        return pd.DataFrame({"g": [sum(np.frombuffer(g) for g in frame["g"]).tobytes()]})

    part = rows.select("v").mapInPandas(gram, "g binary").withColumn("_task", F.spark_partition_id())
    found = tree_merge(part, add).collect()  # one matrix
    total = np.frombuffer(found[0]["g"]).reshape(width, width) if found else np.eye(width)
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def blocks(rows, size, parts):
    """A row per block of up to ``size`` vectors, in descending order of length: block, top, keys, v."""

    def run(frames):
        held = []
        for frame in frames:
            held.append(frame)
            have = pd.concat(held)
            while len(have) >= size:
                yield row(have.iloc[:size])
                have = have.iloc[size:]
            held = [have]
        if held and len(held[0]):
            yield row(held[0])

    def row(f):
        return pd.DataFrame({"top": [f["norm"].iloc[0]], "keys": [f["key"].to_numpy("<i8").tobytes()], "v": [f["v"].tolist()]})

    ordered = rows.repartitionByRange(parts, F.col("norm").desc(), "key").sortWithinPartitions(F.col("norm").desc(), "key")
    out = ordered.mapInPandas(run, "top double, keys binary, v array<binary>")
    return materialise(out.withColumn("block", F.monotonically_increasing_id()), "blocks")


class Side:
    """One block, rotated: integers, leading coordinates, residual and whole lengths."""

    def __init__(self, keys, values, width, turn, lead):
        self.keys, self.v = np.frombuffer(keys, "<i8"), matrix(values, width)
        turned = self.v.astype(np.float64) @ turn
        self.head = turned[:, :lead]
        self.tail = np.sqrt((turned[:, lead:] ** 2).sum(1))
        self.norm = np.sqrt((turned**2).sum(1))
        self.most = int(np.abs(self.v).max(initial=0))


def products(q, v, small):
    """Exact integer inner products of all rows; in floating point where that is exact."""
    if small:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


LOWEST = np.iinfo(np.int64).min


def best(queries, block, floor, k=K):
    """Top k of each query within a block: (scores, keys) by rank, and how many rows were multiplied out.

    ``floor`` is a score that k rows of the table are known to reach (LOWEST: none). Fewer than k
    results have score LOWEST at the end.
    """
    n, width = queries.v.shape
    score = np.full((n, k), LOWEST, np.int64)
    keys = np.zeros((n, k), np.int64)
    small = queries.most * block.most * max(width, 1) < 1 << 53
    done = 0
    for lo in range(0, len(block.keys), TILE):
        hi = min(lo + TILE, len(block.keys))
        limit = np.maximum(score[:, -1], floor)
        slack = 1e-9 * queries.norm * block.norm[lo] + 1e-6
        live = np.flatnonzero(queries.norm * block.norm[lo] + slack >= limit)
        if not len(live):
            break
        bound = queries.head[live] @ block.head[lo:hi].T
        bound += queries.tail[live, None] * block.tail[None, lo:hi]
        bound += slack[live, None]
        may = bound >= limit[live, None]
        may &= queries.keys[live, None] != block.keys[None, lo:hi]
        rows, cols = may.any(1), may.any(0)
        if not rows.any():
            continue
        live, may, cols = live[rows], may[rows][:, cols], np.flatnonzero(cols) + lo
        exact = products(queries.v[live], block.v[cols], small)
        done += exact.size
        exact[~may | (exact < limit[live, None])] = LOWEST
        hit = np.flatnonzero((exact > LOWEST).any(1))
        if not len(hit):
            continue
        live, exact = live[hit], exact[hit]
        every = np.concatenate((score[live], exact), 1)
        owner = np.concatenate((keys[live], np.broadcast_to(block.keys[cols], exact.shape)), 1)
        order = np.lexsort((owner, -np.maximum(every, LOWEST + 1)), axis=1)[:, :k]
        score[live], keys[live] = np.take_along_axis(every, order, 1), np.take_along_axis(owner, order, 1)
    return score, keys, done


def top_k(df, is_query, key="vec_id", vector="embedding", k=K, scale=256, block=BLOCK, query_block=QUERY_BLOCK):
    """(query_id, rank, vec_id, score) of the k highest inner products of every query with other rows.

    ``is_query`` is a condition on the key. Ties go to the smaller key. A table without queries gives
    no rows; a query without candidates has none. Vectors of different lengths are filled up by zeros.
    """
    spark = df.sparkSession
    rows = materialise(quantised(df, key, vector, scale), "vectors")
    stats = rows.agg(F.count(F.lit(1)), F.max(F.length("v"))).first()
    many, width = stats[0], (stats[1] or 0) // 8
    asked = rows.filter(is_query(F.col("key")))
    n_asked = asked.count()
    schema = "query_id long, vec_id long, score long"
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn, lead = rotation(rows, width), max(1, width // 4)
    sides = blocks(rows, block, max(1, -(-many // block)))
    questions = blocks(asked, query_block, max(1, -(-n_asked // query_block)))
    longest = sides.orderBy(F.col("top").desc(), "block").limit(1).collect()[0]  # one block
    sent = spark.sparkContext.broadcast((turn, longest["keys"], longest["v"]))

    def first(frames):
        turn, keys, v = sent.value
        start = Side(keys, v, width, turn, lead)
        for frame in frames:
            floors = []
            for q, data in zip(frame["keys"], frame["v"]):
                score, _, _ = best(Side(q, list(data), width, turn, lead), start, np.int64(LOWEST), k)
                floors.append(score[:, -1].astype("<i8").tobytes())
            yield frame.assign(floor=floors)

    asked = questions.select("block", "keys", "v").mapInPandas(first, "block long, keys binary, v array<binary>, floor binary")
    asked = materialise(asked.withColumnsRenamed({"block": "q", "keys": "q_keys", "v": "q_v"}), "questions")
    numbers = asked.select("q")

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    left = sides.select("block", "keys", "v", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    # Every block of vectors meets every block of queries: rows of blocks, never of single vectors.
    left = left.join(numbers.select(F.col("q"), salts), "salt")
    right = asked.select("*", salts)

    def run(frames):
        turn = sent.value[0]
        for frame in frames:
            for keys, v, q_keys, q_v, floor in zip(*(frame[c] for c in ("keys", "v", "q_keys", "q_v", "floor"))):
                asked = Side(q_keys, list(q_v), width, turn, lead)
                score, who, _ = best(asked, Side(keys, list(v), width, turn, lead), np.frombuffer(floor, "<i8"), k)
                row, col = np.nonzero(score > LOWEST)
                yield pd.DataFrame({"query_id": asked.keys[row], "vec_id": who[row, col], "score": score[row, col]})

    found = left.join(right, ["q", "salt"]).select("keys", "v", "q_keys", "q_v", "floor").mapInPandas(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def embeddings_query(embeddings):
    """op7: the five highest inner products of every 50th vector with all others."""
    return top_k(embeddings, lambda key: key % 50 == 0)
