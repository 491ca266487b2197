"""Language-model scores of whole texts, and a smoothed unigram base.

``gather`` reads the corpus once, some texts at a time. Every task counts the words and the ids of its
training texts, and keeps the ids and words of all texts, as numbers of two bytes, for what follows. Word
counts are merged by hash range; the attention model (``attention.py``) starts from the id counts and is
trained on windows of all training ids, data-parallel: each task makes one pass over its own from the
common weights, and the weights are averaged. A round on every ``WARM``-th window, of all texts alike, goes
before, so that the tasks' models start out close enough to be averaged.

``score`` reads what was kept. The most frequent words (a fixed number) and the model go to the tasks; a
text's other words are dealt by hash range to where their counts are, and only sums come back. Words
are 64-bit hashes throughout.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import attention, wordbpe
from parley.llm.common import materialise, texts_of, tree_merge
from parley.llm.shingles import word_hashes

END_ID = 49407
END_WORD = 0x5D1E_57A9_0C3B_F7E1  # the hash that stands for the end of a text
HEAVY = 1 << 17
IDS = -1  # stands in place of a hash range: a task's id counts
CHUNK = 1 << 19  # bytes of text that become one row
FLUSH_WORDS = 6_000_000
RATES = (0.04, 0.02)
WARM = 8  # the rounds before the last take every eighth window
LN10 = float(np.log(10))

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lowered(text):
    """A to Z to a to z, in UTF-8."""
    return text.translate(_LOWER)


def summed(keys, counts):
    """Distinct keys, sorted, with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[at], np.add.reduceat(counts, at)


def range_of(h, ranges):
    """Hash range of each word: equal slices of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def text_chunks(column, size=CHUNK):
    """(first row, texts) of consecutive texts of about ``size`` bytes; a longer text stands alone with those before."""
    first, some, total = 0, [], 0
    for k in range(len(column)):
        some += texts_of(column.slice(k, 1))
        total += len(some[-1])
        if total >= size or k == len(column) - 1:
            yield first, some
            first, some, total = k + 1, [], 0


def gather(df, vocab, ranges, key="key", text="text", fold=(10, 0)):
    """Word counts by range, id counts (range ``IDS``), and rows of texts (range null).

    A task's training texts are one stream of ids, an end id before the first and after each. Every id
    but the first is a window's target; the last window reaches back over ids of the one before, or is
    filled up with end ids in front, so the last ``SPAN`` ids may be targets twice. ``data`` of a row of texts
    is the part of the stream that has its windows: it starts with ids of the row before, and what is
    left over at its end starts the next row's.

    ``keys`` are the row's texts, the ``known`` training ones first. Their ids (``n_ids`` of each text, its end
    id last) are those of ``data`` without the first ``skip``, and ``rest``; ``words`` are numbers, ``n_words`` of each
    text, of the hashes in ``distinct``. The task's last window has no texts.
    """
    span = attention.SPAN
    key_type = df.schema[key].dataType
    kinds = {"range": T.IntegerType(), "task": T.IntegerType(), "data": T.BinaryType(), "keys": T.ArrayType(key_type)}
    kinds |= dict.fromkeys(("known", "skip"), T.IntegerType())
    kinds |= dict.fromkeys(("rest", "n_ids", "words", "n_words", "distinct"), T.BinaryType())
    schema = T.StructType([T.StructField(*x) for x in kinds.items()])

    def run(batches):
        bpe, task = wordbpe.load(vocab), TaskContext.get().partitionId()
        keys, counts, waiting = [], [], 0
        # What is left over for the next row, and the last ids of all.
        left = tail = np.array([END_ID], "<u2")
        seen = np.zeros(len(bpe.width), np.int64)
        shape = None

        def rows(**columns):
            n = len(next(iter(columns.values())))
            columns["task"] = [task] * n
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in shape], schema=shape)

        def counted():
            h, c = summed(np.concatenate(keys), np.concatenate(counts))
            part = range_of(h, ranges)
            edge = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
            some = [r for r in range(ranges) if edge[r] < edge[r + 1]]
            data = [zlib.compress(h[edge[r] : edge[r + 1]].tobytes() + c[edge[r] : edge[r + 1]].astype("<u4").tobytes(), 1) for r in some]
            return rows(range=some, data=data)

        for batch in batches:
            if shape is None:
                types = {"range": pa.int32(), "task": pa.int32(), "keys": pa.list_(batch.schema.field(0).type), "known": pa.int32(), "skip": pa.int32()}
                shape = pa.schema([(name, types.get(name, pa.binary())) for name in schema.names])
            for first, some in text_chunks(batch.column(1)):
                names = batch.column(0).slice(first, len(some))
                held = [zlib.crc32(str(k).encode() if k is not None else b"") % fold[0] == fold[1] for k in names.to_pylist()]
                order = np.argsort(held, kind="stable")
                known = len(held) - sum(held)
                some = [lowered(some[k]) for k in order]

                h, edge = word_hashes(some)
                n_words = np.diff(edge) + 1
                u, words = np.unique(np.insert(h, edge[1:], np.uint64(END_WORD)), return_inverse=True)
                c = np.bincount(words[: n_words[:known].sum()], minlength=len(u))
                keys.append(u[c > 0])
                counts.append(c[c > 0])
                waiting += len(keys[-1])

                ids = bpe.encode(some)
                n_ids = np.fromiter(map(len, ids), np.int64, len(ids)) + 1
                ids = np.concatenate([x for t in ids for x in (t, [END_ID])]).astype("<u2")
                cut = n_ids[:known].sum()
                seen += np.bincount(ids[:cut], minlength=len(seen))
                stream = np.concatenate((left, ids[:cut]))
                done = (len(stream) - 1) // span * span
                data = stream[: done + 1] if done else stream[:0]
                skip = min(len(left), len(data))
                rest = ids[len(data) - skip :]
                tail = np.concatenate((tail, ids[:cut][-span - 1 :]))[-span - 1 :]
                left = stream[done:]
                yield rows(
                    range=[None],
                    data=[data.tobytes()],
                    keys=pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.take(pa.array(order))),
                    known=[known],
                    skip=[skip],
                    rest=[rest.tobytes()],
                    n_ids=[n_ids.astype("<i4").tobytes()],
                    words=[words.astype("<u2" if len(u) <= 1 << 16 else "<u4").tobytes()],
                    n_words=[n_words.astype("<i4").tobytes()],
                    distinct=[u.astype("<u8").tobytes()],
                )
                if waiting > FLUSH_WORDS:
                    yield counted()
                    keys, counts, waiting = [], [], 0
        if waiting:
            yield counted()
        if seen.any():
            yield rows(range=[IDS], data=[zlib.compress(seen.astype("<i8").tobytes(), 1)])
        if len(left) > 1:
            before = np.full(max(span + 1 - len(tail), 0), END_ID, "<u2")
            yield rows(range=[None], data=[np.concatenate((before, tail)).tobytes()])

    return df.select(key, text).mapInArrow(run, schema)


def _counts_of(blob):
    raw = zlib.decompress(blob)
    n = len(raw) // 12
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)


def word_counts(gathered):
    """A row per range: its words and counts, how many there are, their sum, and counts by size class."""

    def merge(frame):
        parts = [_counts_of(x) for x in frame["data"]]
        h, c = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        size = np.bincount(size_class(c), minlength=1024)
        some = np.flatnonzero(size)
        return pd.DataFrame(
            {
                "range": [frame["range"].iloc[0]],
                "data": [h.tobytes() + c.astype("<i8").tobytes()],
                "distinct": [len(h)],
                "total": [int(c.sum())],
                "classes": [some.tolist()],
                "members": [size[some].tolist()],
            }
        )

    schema = "range int, data binary, distinct long, total long, classes array<int>, members array<long>"
    return materialise(gathered.filter(F.col("range") != IDS).select("range", "data").groupBy("range").applyInPandas(merge, schema), "words")


def size_class(c):
    """16 classes for each doubling of a count."""
    return np.floor(np.log2(np.maximum(c, 1)) * 16 + 1e-9).astype(np.int64)


def heavy_words(words, most=HEAVY):
    """Sorted hashes and counts of the most frequent words, at most ``most`` of them."""
    sizes = words.select(F.explode(F.arrays_zip("classes", "members")).alias("x")).groupBy("x.classes")
    left, least = most, 1 << 20
    # At most 1,024 classes.
    for row in sorted(sizes.agg(F.sum("x.members").alias("n")).collect(), key=lambda r: -r["classes"]):
        if row["n"] > left:
            break
        left, least = left - row["n"], row["classes"]

    def pick(frames):
        for frame in frames:
            for blob in frame["data"]:
                n = len(blob) // 16
                h, c = np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<i8", n, 8 * n)
                ok = size_class(c) >= least
                yield pd.DataFrame({"data": [h[ok].tobytes() + c[ok].tobytes()]})

    parts = [r["data"] for r in words.select("data").mapInPandas(pick, "data binary").collect()]
    h = np.concatenate([np.frombuffer(x, "<u8", len(x) // 16) for x in parts]) if parts else np.zeros(0, "<u8")
    c = np.concatenate([np.frombuffer(x, "<i8", -1, len(x) // 2) for x in parts]) if parts else np.zeros(0, "<i8")
    order = np.argsort(h)
    return h[order], c[order]


def _windows_of(blob):
    """Windows of a part of a stream, each with the first id of the next as its last."""
    ids = np.frombuffer(blob, "<u2")
    n = max(len(ids) - 1, 0) // attention.SPAN
    at = np.arange(n)[:, None] * attention.SPAN + np.arange(attention.SPAN + 1)[None, :]
    return ids[at].astype(np.int64)


def trained(gathered, size, rates=RATES):
    """(weights, vocabulary) from the gathered counts and windows of ids below ``size``."""
    blobs = gathered.filter("range is null").select("data")

    def add(frame):
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in frame["data"])
        return pd.DataFrame({"data": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

    part = gathered.filter(F.col("range") == IDS).select("data", F.col("task").alias("_task"))
    found = [r["data"] for r in tree_merge(part, add).collect()]
    counts = np.frombuffer(zlib.decompress(found[0]), "<i8") if found else np.zeros(size, np.int64)
    vocabulary = attention.Vocabulary(counts, END_ID)
    weights = attention.initial(vocabulary)
    for k, rate in enumerate(rates, 1):
        weights = _round(blobs, weights, vocabulary, rate, 1 if k == len(rates) else WARM)
    return weights, vocabulary


def _round(blobs, weights, vocabulary, rate, every):
    """Averaged weights after one pass of each task over every ``every``-th of its windows."""
    sent = blobs.sparkSession.sparkContext.broadcast((weights, vocabulary))

    def train(frames):
        start, known = sent.value
        mine = (known.number[_windows_of(b)[::every]] for f in frames for b in f["data"])
        out, n = attention.train(start, mine, rate)
        if n:
            yield pd.DataFrame({"n": [float(n)], "data": [(attention.pack(out).astype(np.float64) * n).tobytes()]})

    def add(frame):
        total = sum(np.frombuffer(x, "<f8") for x in frame["data"])
        return pd.DataFrame({"n": [float(frame["n"].sum())], "data": [total.tobytes()]})

    part = blobs.mapInPandas(train, "n double, data binary").withColumn("_task", F.spark_partition_id())
    found = tree_merge(part, add).collect()
    if not found:
        return weights
    return attention.unpack(np.frombuffer(found[0]["data"], "<f8") / found[0]["n"], weights)


def scored(df, vocab, key="doc_id", text="text", fold=(10, 0), heavy=HEAVY, rates=RATES):
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    A null text counts as empty and has one token, its end; a null key's fold is that of the empty
    text. Without any training text all counts are 0.
    """
    spark, key_type = df.sparkSession, df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ranges = max(16, rows.rdd.getNumPartitions())
    gathered = materialise(gather(rows, vocab, ranges, fold=fold), "gathered")
    words = word_counts(gathered)
    sums = words.agg(F.sum("distinct"), F.sum("total")).first()
    distinct, total = sums[0] or 0, sums[1] or 0
    weights, vocabulary = trained(gathered, len(wordbpe.load(vocab).width), rates)
    sent = spark.sparkContext.broadcast((*heavy_words(words, heavy), weights, vocabulary))
    least = np.log10(total + 0.1 * (distinct + 1))

    def run(batches):
        task = TaskContext.get().partitionId()
        top, top_count, weights, vocabulary = sent.value
        top_log = np.log10(top_count + 0.1) - least
        model, number = attention.Scorer(weights, vocabulary), 0
        rare = []

        def flush():
            doc, h, n = (np.concatenate(x) for x in zip(*rare))
            part = range_of(h, ranges)
            order = np.argsort(part, kind="stable")
            doc, h, n, part = doc[order], h[order], n[order], part[order]
            edge = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
            some = [r for r in range(ranges) if edge[r] < edge[r + 1]]
            data = []
            for r in some:
                lo, hi = edge[r], edge[r + 1]
                raw = h[lo:hi].tobytes() + doc[lo:hi].astype("<i4").tobytes() + n[lo:hi].astype("<i4").tobytes()
                data.append(zlib.compress(raw, 1))
            none = pa.nulls(len(some))
            types = [f.type for f in shape]
            columns = [pa.array([task] * len(some), pa.int32()), none, none, none, none, none, none, none]
            columns = [c.cast(t) for c, t in zip(columns, types)] + [pa.array(some, pa.int32()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema=shape)

        shape = None
        for batch in batches:
            if shape is None:
                kinds = [pa.int32(), pa.int32(), batch.schema.field(0).type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary()]
                shape = pa.schema(list(zip(names, kinds)))
            for row in range(batch.num_rows):
                parts = [c[row].as_buffer() for c in batch.columns[3:]]
                data, rest, n_ids, words, n_words, u = (np.frombuffer(x, t) for x, t in zip(parts, ("<u2", "<u2", "<i4", np.uint8, "<i4", "<u8")))
                size = n_words.astype(np.int64)
                words = words.view("<u2" if len(words) == 2 * size.sum() else "<u4")
                owner = np.repeat(np.arange(len(size)), size)
                at = np.minimum(np.searchsorted(top, u), max(len(top) - 1, 0))
                found = top[at] == u if len(top) else np.zeros(len(u), bool)
                value = np.where(found, top_log[at], 0) if len(top) else np.zeros(len(u))
                seldom = np.flatnonzero(~found[words])
                pair, many = np.unique(owner[seldom] * len(u) + words[seldom], return_counts=True)
                rare.append((number + pair // len(u), u[pair % len(u)], many))
                score = model.sums(np.concatenate((data[batch.column(2)[row].as_py() :], rest)), n_ids.astype(np.int64)) / LN10
                rows = len(size)
                none = pa.nulls(rows)
                columns = [
                    pa.array(np.full(rows, task, np.int32)),
                    pa.array(np.arange(number, number + rows, dtype=np.int32)),
                    batch.column(0)[row].values,
                    pa.array(np.arange(rows) >= batch.column(1)[row].as_py()),
                    pa.array(size),
                    pa.array(np.bincount(owner, found[words], rows).astype(np.int64)),
                    pa.array(np.bincount(owner, value[words], rows)),
                    pa.array(score.astype(np.float64)),
                    none.cast(pa.int32()),
                    none.cast(pa.binary()),
                ]
                number += rows
                yield pa.RecordBatch.from_arrays(columns, schema=shape)
                if sum(len(x[0]) for x in rare) > FLUSH_WORDS // 4:
                    yield flush()
                    rare = []
        if rare:
            yield flush()

    fields = [
        T.StructField("task", T.IntegerType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("key", key_type),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
    schema = T.StructType([*fields, T.StructField("range", T.IntegerType()), T.StructField("data", T.BinaryType())])
    names = schema.names
    kept = gathered.filter("keys is not null").select("keys", "known", "skip", "data", "rest", "n_ids", "words", "n_words", "distinct")
    out = materialise(kept.mapInArrow(run, schema), "scored")
    docs, rest = out.filter("range is null").select(*names[:8]), out.filter("range is not null")

    def look_up(frame):
        """Sums by text of one range's rare words, a row per task."""
        counted, h, c = frame["task"].isna(), np.zeros(0, "<u8"), np.zeros(0, "<i8")
        for blob in frame.loc[counted, "data"]:
            n = len(blob) // 16
            h, c = np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<i8", n, 8 * n)
        tasks, data = [], []
        for task, blob in zip(frame.loc[~counted, "task"], frame.loc[~counted, "data"]):
            raw = zlib.decompress(blob)
            n = len(raw) // 16
            word = np.frombuffer(raw, "<u8", n)
            doc, many = np.frombuffer(raw, "<i4", n, 8 * n), np.frombuffer(raw, "<i4", n, 12 * n)
            at = np.minimum(np.searchsorted(h, word), max(len(h) - 1, 0))
            count = np.where(h[at] == word, c[at], 0) if len(h) else np.zeros(n, np.int64)
            u, back = np.unique(doc, return_inverse=True)
            value = np.bincount(back, many * (np.log10(count + 0.1) - least), len(u))
            known = np.bincount(back, many * (count > 0), len(u))
            tasks.append(int(task))
            data.append(u.astype("<i4").tobytes() + known.astype("<i4").tobytes() + value.astype("<f8").tobytes())
        return pd.DataFrame({"task": tasks, "data": data})

    both = rest.select("range", "task", "data").unionByName(words.select("range", F.lit(None).cast("int").alias("task"), "data"))
    sums = both.groupBy("range").applyInPandas(look_up, "task int, data binary")

    def add(frame, sums):
        frame = frame.sort_values("number")
        first = int(frame["number"].iloc[0]) if len(frame) else 0
        base, known = frame["base_score"].to_numpy(copy=True), frame["n_known"].to_numpy(copy=True)
        for blob in sums["data"]:
            n = len(blob) // 16
            doc = np.frombuffer(blob, "<i4", n) - first
            known[doc] += np.frombuffer(blob, "<i4", n, 4 * n)
            base[doc] += np.frombuffer(blob, "<f8", n, 8 * n)
        return frame.assign(base_score=base, n_known=known)

    done = docs.groupBy("task").cogroup(sums.groupBy("task")).applyInPandas(add, T.StructType(fields))
    return done.select(
        "key", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score"
    )


def documents_query(docs, vocab):
    """op10: base and model score of all documents; learns where crc32(doc_id) mod 10 is not 0."""
    return scored(docs, vocab).withColumnRenamed("key", "doc_id")
