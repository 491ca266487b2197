"""Connected components: each task joins up its own edges, alternating large-star and small-star steps the rest."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parley.llm.common import materialise

CHUNK = 1 << 20  # edges that a task joins up at a time


def _joined(pairs):
    """(u, v) pairs with the smallest of u and its neighbours as ``m``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("_u")).drop("_u")


def forest(u, v):
    """(node, smallest node that the edges (u, v) connect it with) of all nodes but the smallest ones."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def contracted(edges, size=CHUNK):
    """Edges (u, v) with ``part``; about ``size`` edges of a task at a time are replaced by their ``forest``.

    Components stay. Where ``part`` has one value, the edges are the forest of all.
    """

    def run(batches):
        held, n, part = [], 0, 0

        def joined():
            u, v = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in (0, 1))
            return forest(u, v)

        def rows(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), part))], names=["u", "v", "part"])

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in (0, 1)])
            n += batch.num_rows
            if n >= size:
                held = [joined()]
                n = len(held[0][0])
                if n > size // 2:
                    yield rows(*held[0])
                    held, n, part = [], 0, part + 1
        if n:
            yield rows(*joined())

    out = edges.select("u", "v").mapInArrow(run, "u long, v long, part long")
    return out.withColumn("part", F.struct(F.spark_partition_id(), "part"))


def _mark(edges):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges, size=CHUNK):
    """Edges (a, b) of longs to (node, root), root being the smallest node of the component.

    Roots themselves are not listed. Each step keeps the components and brings nodes closer to their
    root; every step's edges are written, so lineage stays short. Once tasks have left over ``size`` edges
    they are joined up by joins and aggregates, fewer by a task.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        now = materialise(contracted(now, size), "edges")
        first, last, many = now.agg(F.min("part"), F.max("part"), F.count(F.lit(1))).first()
        if first == last:
            break
        now = now.select("u", "v")
        if many <= size:
            now = now.coalesce(1)
            continue
        now = materialise(now.distinct(), "edges")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _joined(materialise(large.distinct(), "large"))
        small = small.select("u", F.col("m").alias("v")).unionByName(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        before = _mark(now)
        now = materialise(small.filter("u <> v").distinct(), "edges")
        if _mark(now) == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
