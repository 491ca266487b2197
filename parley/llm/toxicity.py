"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased bytes, white space runs counting as one
blank, hashed into ``buckets``. The log-count ratio of a feature is the log of its share in toxic texts
over its share in clean ones; a feature's value is that ratio if the text has it and 0 if not. Logistic
regression on these values gives the score. Only the ``features`` most telling n-grams take part.

The model is fitted on at most about ``max_train`` labelled rows, picked by a hash of their key; texts
are always whole. Scoring is a single pass over the table without a shuffle.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import crc32_mod, materialise, texts_of, tree_merge

ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 19
FEATURES = 4096
MAX_TRAIN = 16384
THRESHOLD = 0.3  # from this probability on a text is predicted toxic
CHUNK = 1 << 19
ROWS = 512  # of a batch whose texts are copied at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def grams(texts, orders=ORDERS, bits=BUCKET_BITS):
    """Yield (text number, bucket) arrays of all n-grams, one pair of arrays for each order.

    Every text gets a blank at either end. N-grams never span two texts; a NUL in a text is a byte like others.
    """
    raw = b"\0".join(b" " + t + b" " for t in texts) + b"\0"
    end = np.zeros(len(raw), bool)
    end[np.cumsum([len(t) + 3 for t in texts]) - 1] = True
    b = _LOWER[np.frombuffer(raw, np.uint8)]
    high = np.flatnonzero((b >= 0x80) & (b <= 0x9E))
    if len(high):  # capital Latin letters of two bytes
        b[high[(b[high - 1] == 0xC3) & (b[high] != 0x97)]] += 0x20
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    b, end = b[keep], end[keep]
    owner = np.cumsum(end, dtype=np.int32) - end
    h = np.zeros(len(b), np.uint64)
    stop = np.zeros(len(b), bool)
    for n in range(1, max(orders) + 1):
        size = len(b) - n + 1
        if size <= 0:
            return
        h = h[:size] * np.uint64(0x100000001B3) + b[n - 1 :].astype(np.uint64) + np.uint64(1)
        stop = stop[:size] | end[n - 1 :]
        if n in orders:
            bucket = ((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            ok = ~stop
            yield owner[:size][ok], bucket[ok].astype(np.int32)


def in_chunks(texts, size=CHUNK):
    """Consecutive (first, texts) groups of about ``size`` bytes; a longer text is one group."""
    first, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= size or k == len(texts) - 1:
            yield first, texts[first : k + 1]
            first, total = k + 1, 0


def present(texts, table=None, bits=BUCKET_BITS, orders=ORDERS):
    """Distinct (text number, bucket) pairs, of the buckets whose ``table`` entry is set."""
    out = []
    for owner, bucket in grams(texts, orders, bits):
        if table is not None:
            hit = np.flatnonzero(table[bucket])
            owner, bucket = owner[hit], bucket[hit]
        out.append((owner.astype(np.int64) << bits) | bucket)
    keys = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return (keys >> bits).astype(np.int64), (keys & ((1 << bits) - 1)).astype(np.int64)


class Model:
    """Weight of each bucket (0: no feature) and the intercept."""

    def __init__(self, weights, intercept, bits, orders):
        self.weights, self.intercept, self.bits, self.orders = weights, intercept, bits, orders

    def score(self, texts):
        """Probability of label 1 for each text (UTF-8). An empty text gets that of no feature."""
        out = np.full(len(texts), self.intercept)
        used = self.weights != 0
        for first, some in in_chunks(texts):
            owner, bucket = present(some, used, self.bits, self.orders)
            out[first : first + len(some)] += np.bincount(owner, self.weights[bucket], len(some))
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def ratios(positive, negative, n_positive, n_negative, alpha=1.0):
    """Log-count ratio of each bucket from the numbers of texts that have it."""
    p, q = positive + alpha, negative + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def telling(positive, negative, n_positive, n_negative, features, least=3):
    """The buckets that tell the classes apart best, by their chi-square, rare ones left out."""
    n, seen = n_positive + n_negative, positive + negative
    expected = seen * n_positive / n
    spread = expected * (1 - n_positive / n) * (1 - seen / (n + 1)) + 1e-9
    chi = np.where((seen >= least), (positive - expected) ** 2 / spread, 0)
    best = np.argsort(-chi, kind="stable")[:features]
    return np.sort(best[chi[best] > 0])


def logistic(rows, cols, values, labels, width, l2=0.3, steps=300, rate=0.05):
    """Weights and intercept of L2-regularised logistic regression on sparse rows, by Adam."""
    n = len(labels)
    w, b = np.zeros(width), float(np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, values * w[cols], n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels) / n
        grad = np.append(np.bincount(cols, values * g[rows], width) + l2 / n * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def training_rows(docs, labels, key, text, label, fold, max_train):
    """(label, text) of the labelled rows of the training folds, about ``max_train`` at most.

    Labels other than 0 and 1 are left out; of several labels of a key the largest counts.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    known = known.filter("key is not null and label in (0, 1)").filter(crc32_mod(F.col("key"), fold[0]) != fold[1])
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    many = known.count()
    if many > max_train:
        share = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
        known = known.filter(share < int(max_train / many * (1 << 30)))
    # At most about max_train narrow rows: small whatever the tables' size.
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "key").select("label", "text")


def fit(docs, labels, key="doc_id", text="text", label="toxic", fold=(4, 2), max_train=MAX_TRAIN, features=FEATURES, bits=BUCKET_BITS, orders=ORDERS):
    """Train on the rows whose crc32(key) modulo ``fold[0]`` is not ``fold[1]``."""
    train = materialise(training_rows(docs, labels, key, text, label, fold, max_train).repartition(16), "train")

    def count(frames):
        total = np.zeros((2, 1 << bits), np.int64)
        texts = np.zeros(2, np.int64)
        for frame in frames:
            y = frame["label"].to_numpy()
            texts += np.bincount(y, minlength=2)
            for first, some in in_chunks(frame["text"].tolist()):
                some = [t.encode() for t in some]
                owner, bucket = present(some, None, bits, orders)
                mine = y[first + owner]
                for k in (0, 1):
                    total[k] += np.bincount(bucket[mine == k], minlength=1 << bits)
        yield packed(texts, total)

    def packed(texts, total):
        counts = zlib.compress(total.astype("<i4").tobytes(), 1)
        return pd.DataFrame({"clean": [int(texts[0])], "toxic": [int(texts[1])], "counts": [counts]})

    def add(frame):
        total = sum(np.frombuffer(zlib.decompress(c), "<i4").astype(np.int64) for c in frame["counts"])
        return packed(frame[["clean", "toxic"]].sum().to_numpy(), total)

    part = train.mapInPandas(count, "clean long, toxic long, counts binary")
    sizes, negative, positive = np.zeros(2), np.zeros(1 << bits), np.zeros(1 << bits)
    # One row of a size that the parameters fix.
    for row in tree_merge(part.withColumn("_task", F.spark_partition_id()), add).collect():
        sizes = np.array([row["clean"], row["toxic"]], float)
        negative, positive = np.frombuffer(zlib.decompress(row["counts"]), "<i4").reshape(2, -1).astype(float)
    if not sizes.all():  # one class only, or no labelled text: the share of toxic texts is all there is
        share = np.clip((sizes[1] + 0.5) / (sizes.sum() + 1), 1e-6, 1 - 1e-6)
        return Model(np.zeros(1 << bits), float(np.log(share / (1 - share))), bits, orders)
    r = ratios(positive, negative, sizes[1], sizes[0])
    chosen = telling(positive, negative, sizes[1], sizes[0], features)
    index = np.full(1 << bits, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    used = train.sparkSession.sparkContext.broadcast(index)

    def hits(frames):
        table = used.value >= 0
        for frame in frames:
            out = []
            for _, some in in_chunks(frame["text"].tolist()):
                some = [t.encode() for t in some]
                owner, bucket = present(some, table, bits, orders)
                out += np.split(used.value[bucket], np.searchsorted(owner, np.arange(1, len(some))))
            yield pd.DataFrame({"label": frame["label"], "cols": [x.astype("<i4").tobytes() for x in out]})

    # About max_train rows of at most ``features`` numbers each.
    rows = train.mapInPandas(hits, "label int, cols binary").collect()
    rows.sort(key=lambda x: (x["label"], bytes(x["cols"])))
    y = np.array([x["label"] for x in rows], float)
    cols = [np.frombuffer(x["cols"], "<i4") for x in rows]
    owner = np.repeat(np.arange(len(rows)), list(map(len, cols)))
    cols = np.concatenate(cols)
    scale = r[chosen]
    w, b = logistic(owner, cols, scale[cols], y, len(chosen))
    weights = np.zeros(1 << bits)
    weights[chosen] = w * scale
    return Model(weights, b, bits, orders)


def scored(df, model, text="text", score="score"):
    """``df`` with a score column; a null text counts as empty. No shuffle."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = names.index(text)

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                some = batch.slice(first, ROWS)
                values = sent.value.score(texts_of(some.column(at)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(values, pa.float64())], names=[*names, score])

    return df.mapInArrow(run, schema)


def documents_query(docs, labels, threshold=THRESHOLD):
    """op6: toxicity of all documents; learns only where crc32(doc_id) mod 4 is not 2."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select(
        "doc_id",
        (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
