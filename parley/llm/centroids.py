"""Centroid clustering of integer vectors with a vantage-point tree over the centroids.

Each round the driver builds a tree of the few centroids and broadcasts it; a pass over the vectors
finds every vector's nearest centroid, and sums by cluster come back. A node of the tree holds one
centroid, the vantage point, and the others in two halves by their distance to it, each half with the
range of those distances; a small half is a leaf. Every vector visits nodes in order of the least distance that the
triangle inequality leaves possible, and stops when that exceeds the best distance found. A node whose
bound equals the best one is still visited, as it may hold a centroid of smaller number.

Squared distances are exact integers. Bounds are lengths rounded down to integers (up for ranges' upper
ends), so rounding never prunes what could win or tie. Vectors of a batch are searched together, each
by its own order of nodes.

Components of 2^27 or more take Python integers, for vectors, sums and centroids alike: slower, as exact.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import materialise

K = 8
ROUNDS = 10
WIDTH = 64
SCALE = 1024
SEED = 3
LEAF = 2
BATCH = 4096  # vectors searched together
FAN = 256  # groups in which tasks' sums are added up first
WIDE = 1 << 27  # from here on squared distances of 64 components may not fit 64 bits
LONG = (1 << 63) - 1
ASSIGNED = [("cluster", T.IntegerType()), ("distance", T.LongType())]


def integer(x, scale):
    """floor(scale * x) of a finite number, exact for any size."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def quantised(df, key="vec_id", vector="embedding", width=WIDTH, scale=SCALE):
    """(key, v, wide): vectors of ``width`` finite components as integers, one row for each row kept.

    ``v`` holds 64-bit integers; where a component is beyond 2^27 it is null and ``wide`` has the decimals.
    """

    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            at, small, wide = [], [], []
            for k, x in enumerate(vectors):
                if not x.is_valid or len(x.values) != width or x.values.null_count:
                    continue
                x = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(x).all():
                    continue
                at.append(k)
                if np.abs(x).max(initial=0) < (WIDE - 1) / scale:
                    small.append(np.floor(scale * x).astype("<i8").tobytes())
                    wide.append(None)
                else:
                    small.append(None)
                    wide.append(",".join(str(integer(float(c), scale)) for c in x))
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(small, pa.binary()), pa.array(wide, pa.string())], names=["key", "v", "wide"])

    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("x"))
    schema = T.StructType([rows.schema[0], T.StructField("v", T.BinaryType()), T.StructField("wide", T.StringType())])
    return rows.mapInArrow(run, schema)


def matrix(small, wide, width=WIDTH):
    """Vectors as rows of integers: 64-bit ones, or Python's if a row is wide."""
    if all(w is None for w in wide):
        return np.frombuffer(b"".join(small), "<i8").reshape(len(small), width)
    rows = [np.frombuffer(v, "<i8").tolist() if w is None else list(map(int, w.split(","))) for v, w in zip(small, wide)]
    return np.array(rows, object).reshape(len(rows), width)


def narrow(m):
    """``m`` with 64-bit integers if all are small enough for exact distances, else with Python's."""
    if m.dtype != object or (m.size and np.abs(m).max() >= WIDE):
        return m if m.dtype == object or not m.size or np.abs(m).max() < WIDE else m.astype(object)
    return m.astype(np.int64)


def squared(m, c):
    """Exact squared distances of the rows of ``m`` to one centroid."""
    d = m - c
    return (d * d).sum(1)


def roots(d):
    """(lower, upper) integers around the square roots of exact integers."""
    if d.dtype == object:
        low = np.array([math.isqrt(x) for x in d], object)
        return low, low + 1
    low = np.sqrt(d.astype(np.float64)).astype(np.int64)
    return np.maximum(low - 2, 0), low + 2


class Tree:
    """Vantage-point tree over the rows of ``centroids``; nodes are numbered from the root, 0."""

    def __init__(self, centroids, leaf=LEAF):
        self.centroids = centroids = narrow(centroids)
        self.nodes = []  # (centroids to compare with, [(child, nearest, farthest distance to the vantage point)])
        self._grow(np.arange(len(centroids)), max(leaf, 1))

    def _grow(self, members, leaf):
        at = len(self.nodes)
        self.nodes.append(None)
        if len(members) <= leaf:
            self.nodes[at] = (members, [])
            return at
        vantage, rest = members[0], members[1:]
        d = squared(self.centroids[rest], self.centroids[vantage])
        order = np.argsort(d, kind="stable")
        halves, children = np.array_split(order, 2), []
        for half in halves:
            if len(half):
                low, high = roots(d[half])
                children.append((self._grow(np.sort(rest[half]), leaf), low.min(), high.max()))
        self.nodes[at] = (members[:1], children)
        return at

    def nearest(self, m):
        """(number, squared distance) of the nearest centroid of every row, ties to the smaller number."""
        m, c = (m, self.centroids) if m.dtype == self.centroids.dtype else (m.astype(object), self.centroids.astype(object))
        far = float("inf") if m.dtype == object else np.iinfo(np.int64).max
        best, who = np.full(len(m), far, m.dtype), np.full(len(m), len(c))
        bound = np.full((len(m), len(self.nodes)), far, m.dtype)  # ``far``: not to be visited, or not yet
        bound[:, 0] = 0
        live, visits = np.arange(len(m)), 0
        while len(live):
            node = bound[live].argmin(1) if m.dtype != object else np.array([min(range(len(b)), key=b.__getitem__) for b in bound[live]])
            least = bound[live, node]
            # Inclusive: a bound that equals the best distance is still looked at.
            go = (least != far) & ((best[live] == far) | (_square(least, best[live], far) <= best[live]))
            live, node = live[go], node[go]
            visits += len(live)
            for at in np.unique(node):
                self._visit(at, live[node == at], m, c, best, who, bound)
        return who, best, visits

    def _visit(self, at, rows, m, c, best, who, bound):
        mine, children = self.nodes[at]
        entry = bound[rows, at].copy()
        bound[rows, at] = float("inf") if m.dtype == object else np.iinfo(np.int64).max
        for number in mine:
            d = squared(m[rows], c[number])
            better = (d < best[rows]) | ((d == best[rows]) & (number < who[rows]))
            best[rows[better]], who[rows[better]] = d[better], number
        if children:
            low, high = roots(d)  # to the vantage point, the only centroid of this node
            for child, near, farthest in children:
                bound[rows, child] = np.maximum(np.maximum(entry, near - high), low - farthest)


def _square(least, best, far):
    """Squares of bounds, without overflow: bounds of 2^31 and more exceed any small distance."""
    if least.dtype == object:
        return np.array([x if x == far else x * x for x in least], object)
    return np.where(least < 1 << 31, least, 1 << 31) ** 2


def searched(frame, tree):
    """(vectors, numbers, distances) for groups of rows of a frame."""
    for first in range(0, len(frame), BATCH):
        some = frame.iloc[first : first + BATCH]
        m = matrix(some["v"].tolist(), some["wide"].tolist(), tree.centroids.shape[1])
        who, best, _ = tree.nearest(m)
        yield first, m, who, best


def summed(rows, tree):
    """{cluster: (rows, sums of components, sum of distances)} of the nearest vectors, exact.

    Tasks add up their own rows; ``FAN`` groups of tasks are added up next, and then those.
    """
    sent = rows.sparkSession.sparkContext.broadcast(tree)
    width = tree.centroids.shape[1]

    def add(total, cluster, n, sums, inertia):
        have = total.setdefault(cluster, [0, np.zeros(width, object), 0])
        have[0], have[1], have[2] = have[0] + n, have[1] + sums, have[2] + inertia

    def frame_of(total, group):
        out = pd.DataFrame({"cluster": list(total), "n": [t[0] for t in total.values()]})
        out["sums"] = [",".join(map(str, t[1])) for t in total.values()]
        return out.assign(inertia=[str(t[2]) for t in total.values()], group=group)

    def run(frames):
        total = {}
        for frame in frames:
            for _, m, who, best in searched(frame, sent.value):
                for cluster in np.unique(who):
                    mine = who == cluster
                    d = best[mine].astype(object) if best.dtype == object or best.max(initial=0) > LONG // BATCH else best[mine]
                    add(total, int(cluster), int(mine.sum()), m[mine].sum(0).astype(object), int(d.sum()))
        if total:
            yield frame_of(total, 0)

    def merge(key, frame):
        total = {}
        for cluster, n, sums, inertia in frame[["cluster", "n", "sums", "inertia"]].itertuples(index=False):
            add(total, int(cluster), int(n), np.array(list(map(int, sums.split(","))), object), int(inertia))
        return frame_of(total, 0)

    schema = "cluster int, n long, sums string, inertia string, group int"
    part = rows.select("v", "wide").mapInPandas(run, schema)
    part = part.withColumn("group", (F.spark_partition_id() % FAN).cast("int")).groupBy("group", "cluster").applyInPandas(merge, schema)
    # One row per cluster.
    found = part.groupBy("cluster").applyInPandas(merge, schema).collect()
    return {r["cluster"]: (r["n"], [int(x) for x in r["sums"].split(",")], int(r["inertia"])) for r in found}


def moved(centroids, sums):
    """Floor of the mean of every cluster's vectors; an empty cluster stays."""
    out = centroids.astype(object)
    for cluster, (n, total, _) in sums.items():
        out[cluster] = [x // n for x in total]
    return out


def first_centroids(rows, k, seed):
    """The ``k`` vectors with the smallest hash of ``seed:key``; a null key counts as empty. Ties by content."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    mark = F.sha2(text.cast("binary"), 256)
    found = rows.orderBy(mark, F.col("wide").asc_nulls_first(), "v").limit(k).collect()
    return matrix([bytes(r["v"] or b"") for r in found], [r["wide"] for r in found]) if found else None


def clustered(df, key="vec_id", vector="embedding", k=K, rounds=ROUNDS, seed=SEED, width=WIDTH, scale=SCALE, leaf=LEAF):
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Rows whose vector is null, has another number of components than ``width``, or holds null or non-finite
    ones take no part. Rows that repeat a key, or have none, are vectors of their own. With fewer than
    ``k`` vectors there are as many clusters as vectors; an empty table has no rows. A distance or sum that
    64 bits do not hold is null; clusters and centroids are exact all the same.
    """
    spark = df.sparkSession
    rows = materialise(quantised(df, key, vector, width, scale), "vectors")
    schema = T.StructType(
        [T.StructField(key, rows.schema["key"].dataType), *(T.StructField(*f) for f in ASSIGNED)]
        + [T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())]
    )
    centroids = first_centroids(rows, k, seed)
    if centroids is None:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(centroids, summed(rows, Tree(centroids, leaf)))
    tree = Tree(centroids, leaf)
    sums = summed(rows, tree)
    held = lambda x: x if x <= LONG else None
    per_cluster = [held(sums[c][2]) if c in sums else 0 for c in range(len(centroids))]
    total = held(sum(s[2] for s in sums.values()))
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sent = spark.sparkContext.broadcast((tree, per_cluster, total, marks))

    def run(batches):
        tree, per_cluster, total, marks = sent.value
        for batch in batches:
            frame = batch.select(["v", "wide"]).to_pandas()
            for first, _, who, best in searched(frame, tree):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(who)),
                        pa.array(who.tolist(), pa.int32()),
                        pa.array([held(int(d)) for d in best], pa.int64()),
                        pa.array([per_cluster[c] for c in who], pa.int64()),
                        pa.array([total] * len(who), pa.int64()),
                        pa.array([marks[c] for c in who], pa.string()),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def embeddings_query(embeddings):
    """op11: eight clusters of the 64-component vectors after ten rounds."""
    return clustered(embeddings)
