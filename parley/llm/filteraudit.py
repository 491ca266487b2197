"""Which filter removes what, whatever the order: an audit of filters by forward-backward path counting.

Every document fails a set of filters, a bit mask; documents are counted by part and mask, and all that
follows is worked out from these counts. The sets of filters applied so far form a lattice: a state is
a set, an edge adds one filter to it. An order of all filters is a path from the empty set to the full
one. Counting paths forward from the empty set and backward from the full one gives the number of
orders that use an edge; the documents that an edge removes, weighted by that number and summed over a
filter's edges, are its Shapley sum. A step of an order is an edge as well, so its row is read from
the same table.
"""

from itertools import permutations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"


def lattice(n):
    """(state, filter, orders through the edge) of every edge of the lattice of ``n`` filters."""
    full = (1 << n) - 1
    states = sorted(range(full + 1), key=lambda s: s.bit_count())
    forward, backward = dict.fromkeys(states, 0), dict.fromkeys(states, 0)
    forward[0] = backward[full] = 1
    edges = [(s, f) for s in states for f in range(n) if not s >> f & 1]
    for s, f in edges:
        forward[s | 1 << f] += forward[s]
    for s, f in reversed(edges):
        backward[s] += backward[s | 1 << f]
    return [(s, f, forward[s] * backward[s | 1 << f]) for s, f in edges]


def orders(letters):
    """(filter_order, step, state before the step, filter) of every step of every order."""
    out = []
    for order in permutations(range(len(letters))):
        state, name = 0, "".join(letters[f] for f in order)
        for step, f in enumerate(order, 1):
            out.append((name, step, state, f))
            state |= 1 << f
    return out


def contributions(n):
    """What a document of each mask counts for on each edge, as rows for a join on the mask."""
    return [
        (mask, s, f, orders_, int(not mask & (s | 1 << f)), int(not mask & s and mask >> f & 1), mask >> f & 1, int(mask == 1 << f))
        for s, f, orders_ in lattice(n)
        for mask in range(1 << n)
    ]


def audit(masks, letters=LETTERS):
    """One row per part, order of the filters and step, from counts of documents.

    ``masks`` has the columns part, mask (bit f is set for what fails filter f), n, good and toxic (counts;
    rows may repeat a part and mask). Every part has all orders and steps. Up to six filters or so: the
    result has n! * n rows for each part.
    """
    spark, n = masks.sparkSession, len(letters)
    totals = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # Both tables have a size that the number of filters fixes.
    edges = spark.createDataFrame(contributions(n), "mask int, state int, filter int, orders long, stays int, goes int, fails int, only int")
    steps = spark.createDataFrame(orders(letters), "filter_order string, step int, state int, filter int")
    per_edge = totals.join(F.broadcast(edges), "mask").groupBy("part", "state", "filter", "orders")
    per_edge = per_edge.agg(
        F.sum(F.col("n") * F.col("stays")).alias("kept"),
        F.sum(F.col("n") * F.col("goes")).alias("removed"),
        F.sum(F.col("n") * (F.col("fails") - F.col("goes"))).alias("redundant"),
        F.sum(F.col("n") * F.col("only")).alias("unique_fails"),
        F.sum(F.col("good") * F.col("goes")).alias("good_lost"),
        F.sum(F.col("toxic") * F.col("goes")).alias("toxic_lost"),
    )
    weight = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter"))
    per_edge = per_edge.withColumn("shapley", weight)
    longs = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return per_edge.join(F.broadcast(steps), ["state", "filter"]).select(
        "part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in longs]
    )


def own_failures(text):
    """Bits 0 to 3: what a text fails by itself; null counts as empty.

    A: under 50 words; B: under 65 percent of words distinct; C: over 5 percent capitals; D: a symbol.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # One struct, so that the words are cut out once.
    n = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.struct(n.alias("words"), (100 * capitals > 5 * F.length(text)).alias("c"), text.rlike(r"[#$%&*|]").alias("d"))


def bits(failed):
    tests = [failed["words"]["n"] < 50, 100 * failed["words"]["distinct"] < 65 * failed["words"]["n"], failed["c"], failed["d"]]
    return sum((t.cast("int") * (1 << k) for k, t in enumerate(tests)), F.lit(0))


def masked(docs, labels, key="doc_id", text="text", part="source"):
    """Counts by part and mask of all documents, with the numbers of good and toxic ones.

    Filter E (bit 4) fails what has the text of a row with a smaller key. A null key is neither smaller
    nor larger than another; rows that share key and text do not fail each other. A text's group is never
    gathered: rows are counted by (text, part, labels, key), then by text without the key, map-side
    first, and a row of a count that holds its text's smallest key is told apart by that key's number.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.sha2(body.cast("binary"), 256).alias("digest"),
        own_failures(body).alias("failed"),
    )
    rows = materialise(rows.select("key", "part", "digest", bits(F.col("failed")).cast("int").alias("mask")), "failures")
    rows = rows.groupBy("key", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.select(F.col(key).alias("key"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
    known = known.groupBy("key").agg(F.max((F.col("q") == 1).cast("int")).alias("good"), F.max((F.col("t") == 1).cast("int")).alias("toxic"))
    flags = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    rows = rows.join(known, "key", "left").select("key", "part", "digest", "mask", "n", *flags)
    group = ["digest", "part", "mask", "good", "toxic"]
    # Equal keys in one group are one row here, so the smallest key has one number.
    rows = rows.groupBy(*group, "key").agg(F.sum("n").alias("n"))
    counts = rows.groupBy(*group).agg(
        F.min("key").alias("least"),
        F.min_by("n", "key").alias("at_least"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(F.lit(0))).alias("no_key"),
    )
    counts = materialise(counts, "texts")
    first = counts.groupBy("digest").agg(F.min("least").alias("first"))
    counts = counts.join(first, "digest")
    original = F.col("no_key") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(F.lit(0))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), original.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - original).alias("n")),
    )
    out = counts.select("part", "good", "toxic", F.explode(both).alias("x")).filter("x.n > 0")
    return out.select("part", "x.mask", "x.n", (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic"))


def documents_query(docs, labels):
    """op13: five filters in all orders, by source. A table without rows has no parts and gives no rows."""
    return audit(masked(docs, labels))
