"""N-gram Jaccard join: rare-first prefix, length, positional and suffix filters, one check a pair.

Texts are sets of word shingles. All sets are put in one global order, rare shingles first (counts of
hash buckets over the whole table; any order is right, the counts only make it quick). Two sets that
reach the threshold share a shingle within their prefixes, so candidates meet on prefix shingles.

Components need not every pair. Texts with equal sets are one class from the start. In a first round
each member of a prefix shingle's group is paired with the most central one, in whose order the
shingle comes first: of near copies that is the least edited one. That joins large groups of near
copies in about one pair a member. A second round pairs all members whose components still differ. A
link is left out here only if its texts are connected anyway; nothing is capped.

All links lie within these components, so a third step finds them there: a component's members are cut
into chunks, every pair of chunks is a task's block, and a block's intersections are all taken exactly.
Components whose pairs are all known links already need no blocks.

A pair passes on its way: the length and positional filters where it is made, then the suffix filter
(the element-wise difference of two histograms over hash ranges is a lower bound of what differs), and
then the exact intersection.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import materialise, texts_of, tree_merge
from parley.llm.graph import components
from parley.llm.shingles import all_sets, fingerprint, in_chunks

SHARE = 75  # a link: 100 * intersection >= SHARE * union
WIDTH = 5
SKETCH_BITS = 21
BINS = 128
HOT = 20_000  # occurrences from which a shingle's group may be dealt over many tasks
FILTER_BITS = 23
PAIR_BLOCK = 1 << 20
BLOCK = 512  # members in a chunk of a component
BLOCK_ELEMENTS = 1 << 19  # and their elements
LINKS = "fp long, to long, links long"


def prefix_length(n, share=SHARE):
    """Two sets that link share one of the first ``prefix_length`` elements of each."""
    return n - (share * n + 99) // 100 + 1


def least_overlap(a, b, share=SHARE):
    """Smallest intersection with which sets of ``a`` and ``b`` elements link."""
    return (share * (a + b) + 99 + share) // (100 + share)


class Sketch:
    """Counts of shingles by hash bucket."""

    @staticmethod
    def bucket(h, bits):
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def pack(counts):
        return zlib.compress(np.asarray(counts, "<u4").tobytes(), 1)

    @staticmethod
    def unpack(data):
        return np.frombuffer(zlib.decompress(data), "<u4")


def described(df, key, text, width=WIDTH, bits=SKETCH_BITS):
    """Written (rows, counts): a row (key, n_shingles, fp) per text, and the bucket counts of all shingles.

    ``fp`` stands for the whole set; null for an empty one. Counts stop at 2^32 - 1.
    """
    step = 1 << min(16, bits)
    schema = T.StructType(
        [
            T.StructField("key", df.schema[key].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("fp", T.LongType()),
            T.StructField("range", T.IntegerType()),
            T.StructField("counts", T.BinaryType()),
        ]
    )

    def run(batches):
        counts, kind = np.zeros(1 << bits, np.int64), None
        for batch in batches:
            kind, sizes, prints = batch.schema.field(0).type, [], []
            for some in in_chunks(texts_of(batch.column(1))):
                sets = all_sets(some, width)
                sizes += map(len, sets)
                prints += [fingerprint(s) if len(s) else None for s in sets]
                counts += np.bincount(Sketch.bucket(np.concatenate(sets), bits), minlength=1 << bits)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())],
                names=schema.names,
            )
        if kind is not None:
            ranges = list(range(0, 1 << bits, step))
            none, keys = pa.nulls(len(ranges)), pa.nulls(len(ranges), kind)
            packed = [Sketch.pack(np.minimum(counts[r : r + step], 2**32 - 1)) for r in ranges]
            yield pa.RecordBatch.from_arrays(
                [keys, none.cast(pa.int64()), none.cast(pa.int64()), pa.array(range(len(ranges)), pa.int32()), pa.array(packed, pa.binary())],
                names=schema.names,
            )

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    out = materialise(out.withColumn("_task", F.spark_partition_id()), "described")

    def add(frame):
        total = np.zeros(step, np.int64)
        for data in frame["counts"]:
            total += Sketch.unpack(data)
        packed = Sketch.pack(np.minimum(total, 2**32 - 1))
        return pd.DataFrame({"range": [frame["range"].iloc[0]], "counts": [packed]})

    merged = tree_merge(out.filter("range is not null").select("range", "counts", "_task"), add, ["range"])
    counts = np.zeros(1 << bits, np.uint32)
    for row in merged.collect():  # 2^bits numbers, whatever the table's size
        counts[row["range"] * step : (row["range"] + 1) * step] = Sketch.unpack(row["counts"])
    return out.filter("range is null").select("key", "n_shingles", "fp"), counts


def class_rows(df, text, counts, width=WIDTH, share=SHARE, bits=SKETCH_BITS, hot=HOT):
    """A row per class and task: fp, n, histogram, prefix in global order and which of it may be hot."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(counts)  # 2^bits numbers
    schema = "fp long, n int, bins binary, prefix array<long>, hot array<boolean>"

    def run(batches):
        seen, freq = set(), sent.value
        for batch in batches:
            for some in in_chunks(texts_of(batch.column(0))):
                cols = [], [], [], [], []
                for s in all_sets(some, width):
                    if not len(s):
                        continue
                    fp = fingerprint(s)
                    if fp in seen:
                        continue
                    seen.add(fp)
                    c = freq[Sketch.bucket(s, bits)]
                    order = np.argsort(c, kind="stable")[: prefix_length(len(s), share)]
                    bins = np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
                    cols[0].append(fp)
                    cols[1].append(len(s))
                    cols[2].append(np.minimum(bins, 255).astype(np.uint8).tobytes())
                    cols[3].append(s[order].view(np.int64))
                    cols[4].append(c[order] >= hot)
                if cols[0]:
                    types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, types)], names=["fp", "n", "bins", "prefix", "hot"]
                    )

    return df.select(F.col(text).alias("text")).mapInArrow(run, schema)


def _whole_groups(batches):
    """Columns (shingle, fp, n, pos, extra...) of complete groups, from batches sorted by shingle."""
    rest = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        if not len(cols[0]):
            continue
        last = np.searchsorted(cols[0], cols[0][-1])
        if last:
            yield [c[:last] for c in cols]
        rest = [c[last:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _distinct(cols):
    """Drop rows that repeat shingle and fp of the row before, then groups of one."""
    shingle, fp = cols[0], cols[1]
    keep = np.ones(len(fp), bool)
    keep[1:] = (shingle[1:] != shingle[:-1]) | (fp[1:] != fp[:-1])
    cols = [c[keep] for c in cols]
    first = np.flatnonzero(np.diff(cols[0], prepend=cols[0][0] - 1) != 0)
    size = np.diff(first, append=len(cols[0]))
    keep = np.repeat(size > 1, size)
    cols = [c[keep] for c in cols]
    size = size[size > 1]
    return cols, np.cumsum(size) - size, size


def may_link(na, pa_, nb, pb, share=SHARE):
    """Length and positional filter of pairs that share an element at these places of their order."""
    need = least_overlap(na, nb, share)
    reach = 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (reach >= need) & (100 * np.minimum(na, nb) >= share * np.maximum(na, nb))


PAIRS = "a long, b long, na int, nb int"
STAR = PAIRS + ", shingle long, fp long, n int, pos int"


def _pair_arrays(fp, n, i, j):
    swap = fp[i] > fp[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    return fp[a], fp[b], n[a], n[b]


def _central(first, size, pos):
    """Index of each group's most central member: the shared shingle comes first in its order.

    What comes before it are rarer shingles, such as those of an edited copy.
    """
    key = (pos.astype(np.int64) << 32) | np.arange(len(pos))
    return np.minimum.reduceat(key, first) & ((1 << 32) - 1)


def star(postings, share=SHARE):
    """Pairs of a group's members with its most central one; and the rows of groups of over 2."""

    def run(batches):
        for cols in _whole_groups(batches):
            cols, first, size = _distinct(cols)
            if not len(size):
                continue
            shingle, fp, n, pos = cols
            i, j = np.repeat(_central(first, size, pos), size), np.arange(len(fp))
            ok = (i != j) & may_link(n[i], pos[i], n[j], pos[j], share)
            pairs = pd.DataFrame(dict(zip("a b na nb".split(), _pair_arrays(fp, n, i[ok], j[ok])))).drop_duplicates()
            big = np.repeat(size > 2, size)
            rows = pd.DataFrame({"shingle": shingle[big], "fp": fp[big], "n": n[big], "pos": pos[big]})
            table = pa.concat_tables(
                [pa.Table.from_pandas(pairs, preserve_index=False), pa.Table.from_pandas(rows, preserve_index=False)],
                promote_options="default",
            )
            yield from table.select([c.split()[0] for c in STAR.split(", ")]).to_batches()

    ordered = postings.repartition("shingle").sortWithinPartitions("shingle", "n", "fp")
    return ordered.select("shingle", "fp", "n", "pos").mapInArrow(run, STAR)


def cross(groups, share=SHARE):
    """Pairs of members of one group whose components differ, but for those that ``star`` has made."""

    def run(batches):
        for cols in _whole_groups(batches):
            cols, first, size = _distinct(cols)
            if not len(size):
                continue
            made = []
            for at, m, centre in zip(first, size, _central(first, size, cols[3])):
                fp, n, pos, root = (c[at : at + m] for c in cols[1:])
                if (root == root[0]).all():
                    continue
                centre -= at
                block = max(1, PAIR_BLOCK // m)
                for lo in range(1, m, block):
                    j, i = np.nonzero(root[lo : lo + block, None] != root[None, :])
                    j = j + lo
                    ok = (i < j) & (i != centre) & (j != centre)
                    i, j = i[ok], j[ok]
                    ok = may_link(n[i], pos[i], n[j], pos[j], share)
                    made.append(pd.DataFrame(dict(zip("a b na nb".split(), _pair_arrays(fp, n, i[ok], j[ok])))))
                if sum(map(len, made)) > PAIR_BLOCK:
                    yield from _batches(made)
                    made = []
            if made:
                yield from _batches(made)

    ordered = groups.repartition("shingle").sortWithinPartitions("shingle", "n", "fp")
    return ordered.select("shingle", "fp", "n", "pos", "root").mapInArrow(run, PAIRS)


def _batches(frames):
    frame = pd.concat(frames).drop_duplicates()
    return pa.Table.from_pandas(frame, preserve_index=False).to_batches()


def hot_pairs(postings, share=SHARE):
    """``star`` for shingles too frequent for one task: each member with the most central, by a join."""
    first = postings.groupBy("shingle").agg(F.min(F.struct("pos", "n", "fp")).alias("m"))
    first = first.select("shingle", "m.n", "m.fp", "m.pos").toDF("_s", "_n", "_fp", "_pos")
    return _passing(postings.join(first, F.col("shingle") == F.col("_s")), share).distinct()


def hot_cross(groups, share=SHARE):
    """Pairs within hot groups whose components differ, by a join that can be split on both sides."""
    right = groups.select(*[F.col(c).alias("_s" if c == "shingle" else f"_{c}") for c in ("shingle", "fp", "n", "pos", "root")])
    joined = groups.join(right, (F.col("shingle") == F.col("_s")) & (F.col("root") != F.col("_root")) & (F.col("fp") < F.col("_fp")))
    return _passing(joined, share).distinct()


def _passing(joined, share):
    na, nb = F.col("n"), F.col("_n")
    need = F.ceil((na + nb) * share / (100 + share))
    reach = 1 + F.least(na - F.col("pos") - 1, nb - F.col("_pos") - 1)
    ok = (F.col("fp") != F.col("_fp")) & (reach >= need) & (100 * F.least(na, nb) >= share * F.greatest(na, nb))
    swap = F.col("fp") > F.col("_fp")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return joined.filter(ok).select(
        pick("fp", "_fp").alias("a"), pick("_fp", "fp").alias("b"), pick("n", "_n").alias("na"), pick("_n", "n").alias("nb")
    )


def suffix_filter(pairs, classes, share=SHARE):
    """Pairs whose histograms leave room for enough overlap."""
    bins = classes.select(F.col("fp").alias("_fp"), "bins")
    with_a = pairs.join(bins, F.col("a") == F.col("_fp")).drop("_fp").withColumnRenamed("bins", "bins_a")
    both = with_a.join(bins, F.col("b") == F.col("_fp")).drop("_fp").withColumnRenamed("bins", "bins_b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for k in (4, 5))
            na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            ok = np.abs(x - y).sum(1) <= na + nb - 2 * least_overlap(na, nb, share)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in range(4)], names=["a", "b", "na", "nb"])

    return both.select("a", "b", "na", "nb", "bins_a", "bins_b").mapInArrow(run, PAIRS)


def sets_of(df, text, wanted, width=WIDTH):
    """(fp, elements) of the classes in ``wanted`` (a, b), once each.

    A bit map of the wanted fingerprints, of one size for any table, goes to the tasks; they send the
    sets that it may contain, and a semi-join leaves the right ones.
    """
    ids = wanted.select(F.col("a").alias("fp")).unionByName(wanted.select(F.col("b").alias("fp"))).distinct()
    ids = materialise(ids, "wanted")
    bits = FILTER_BITS

    def mark(frames):
        have = np.zeros(1 << (bits - 3), np.uint8)
        for frame in frames:
            h = frame["fp"].to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(have, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        yield pd.DataFrame({"bits": [zlib.compress(have.tobytes(), 1)]})

    def union(frame):
        have = np.zeros(1 << (bits - 3), np.uint8)
        for data in frame["bits"]:
            have |= np.frombuffer(zlib.decompress(data), np.uint8)
        return pd.DataFrame({"bits": [zlib.compress(have.tobytes(), 1)]})

    part = ids.mapInPandas(mark, "bits binary").withColumn("_task", F.spark_partition_id())
    found = [r["bits"] for r in tree_merge(part, union).collect()]
    if not found:
        return df.sparkSession.createDataFrame([], "fp long, elements binary")
    sent = df.sparkSession.sparkContext.broadcast(found[0])

    def run(batches):
        have, seen = np.frombuffer(zlib.decompress(sent.value), np.uint8), set()
        for batch in batches:
            for some in in_chunks(texts_of(batch.column(0))):
                fps, out = [], []
                for s in all_sets(some, width):
                    if not len(s):
                        continue
                    fp = fingerprint(s)
                    low = fp & ((1 << bits) - 1)
                    if have[low >> 3] >> (low & 7) & 1 and fp not in seen:
                        seen.add(fp)
                        fps.append(fp)
                        out.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(out, pa.binary())], names=["fp", "elements"])

    sets = df.select(F.col(text).alias("text")).mapInArrow(run, "fp long, elements binary")
    return sets.join(ids, "fp", "left_semi").dropDuplicates(["fp"])


def verified(pairs, df, text, width=WIDTH, share=SHARE):
    """The pairs that link, by exact intersection; ``pairs`` is a written table."""
    # Both joins read one exchange of the sets, dealt by fingerprint.
    sets = sets_of(df, text, pairs, width)
    left, right = sets.toDF("_a", "x"), sets.toDF("_b", "y")
    with_a = pairs.select("a", "b").join(left, F.col("a") == F.col("_a")).select("a", "b", "x")
    both = with_a.join(right, F.col("b") == F.col("_b")).select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= share * (len(both) - same))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def spanning(df, counts, text="text", width=WIDTH, share=SHARE, bits=SKETCH_BITS, hot=HOT):
    """Links (a, b) that connect all classes which links connect; not every link."""
    raw = materialise(class_rows(df, text, counts, width, share, bits, hot), "classes")
    classes = raw.select("fp", "bins").dropDuplicates(["fp"])
    postings = raw.select("fp", "n", F.posexplode(F.arrays_zip("prefix", "hot")).alias("pos", "e"))
    postings = postings.select(F.col("e.prefix").alias("shingle"), "fp", "n", "pos", F.col("e.hot").alias("hot"))
    made = materialise(star(postings.filter("not hot"), share), "star")
    often = materialise(postings.filter("hot").drop("hot").distinct(), "hot")
    groups = made.filter("fp is not null").select("shingle", "fp", "n", "pos")

    def linked(pairs):
        near = materialise(suffix_filter(pairs.distinct(), classes, share), "pairs")
        return materialise(verified(near, df, text, width, share), "links")

    def labelled(rows):
        known = rows.join(roots, F.col("fp") == F.col("node"), "left")
        return known.select("shingle", "fp", "n", "pos", F.coalesce("root", "fp").alias("root"))

    edges = linked(made.filter("a is not null").select("a", "b", "na", "nb").unionByName(hot_pairs(often, share)))
    roots = components(edges)
    more = cross(labelled(groups), share).unionByName(hot_cross(labelled(often), share))
    return edges.unionByName(linked(more))


def overlaps(sets, left, step=4096):
    """Sizes of the intersections of the first ``left`` sets with the others, or of all if ``left`` is 0."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(many[column] > 1)
    column = (np.cumsum(many > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[shared][order], column[order]
    out = np.zeros((left or m, m - left), np.int64)
    for lo in range(0, int((many > 1).sum()), step):
        a, b = np.searchsorted(column, (lo, lo + step))
        has = np.zeros((m, step), np.float32)
        has[owner[a:b], column[a:b] - lo] = 1
        out += (has[: left or m] @ has[left:].T).astype(np.int64)
    return out


def block_rows(fp, weight, sets, left, every, share=SHARE):
    """Columns (fp, to, links) of a block: the first ``left`` classes against the others, or all if it is 0.

    Rows with ``to`` are links: every one, or as many as connect what all of them do. The others sum the
    weights of the classes that a class links with.
    """
    m, n = len(fp), np.array([len(x) for x in sets])
    same = overlaps(sets, left)
    ok = 100 * same >= share * (n[: left or m, None] + n[None, left:] - same)
    if left:
        near = np.zeros((m, m), bool)
        near[:left, left:], near[left:, :left] = ok, ok.T
    else:
        near = ok
        np.fill_diagonal(near, False)
    if every:
        a, b = np.nonzero(np.triu(near))
    else:
        a, b, seen = [], [], np.zeros(m, bool)
        for start in range(m):
            todo, seen[start] = [] if seen[start] else [start], True
            while todo:
                x = todo.pop()
                new = np.flatnonzero(near[x] & ~seen)
                seen[new] = True
                a += [x] * len(new)
                b += new.tolist()
                todo += new.tolist()
    linked = np.flatnonzero(near.any(1))
    total = near[linked] @ weight
    lead, to = fp[np.asarray(a, np.int64)], fp[np.asarray(b, np.int64)]
    return (
        pa.array(np.concatenate((np.minimum(lead, to), fp[linked]))),
        pa.concat_arrays([pa.array(np.maximum(lead, to)), pa.nulls(len(linked), pa.int64())]),
        pa.concat_arrays([pa.nulls(len(lead), pa.int64()), pa.array(total)]),
    )


def links(df, edges, sizes, text="text", width=WIDTH, share=SHARE, block=BLOCK, every=False):
    """Written rows (fp, to, links) of all links between classes, see ``block_rows``.

    ``edges`` are spanning links, ``sizes`` has a row (fp, weight, n) per class.
    """
    roots = components(edges)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = roots.withColumnRenamed("node", "fp").join(sizes.select("fp", "weight", "n"), "fp")
    members = materialise(members, "classes-linked")
    known = edges.join(members.select(F.col("fp").alias("a"), "root"), "a")
    have = known.groupBy("root").agg(F.count(F.lit(1)).alias("have"))
    groups = members.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("elements")).join(have, "root")
    groups = materialise(groups, "groups")
    whole = F.col("have") * 2 >= F.col("k") * (F.col("k") - 1)

    complete = known.join(groups.filter(whole).select("root"), "root", "left_semi").select("a", "b")
    ends = complete.select("a", "b").unionByName(complete.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(members.select(F.col("fp").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("links"))
    ready = complete.select(F.col("a").alias("fp"), F.col("b").alias("to"), F.lit(None).cast("long").alias("links"))
    ready = ready.unionByName(ends.select(F.col("a").alias("fp"), F.lit(None).cast("long").alias("to"), "links"))

    chunks = F.greatest(F.ceil(F.col("k") / block), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    rest = members.join(groups.filter(~whole).select("root", chunks.alias("chunks")), "root")
    rest = materialise(rest.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")), "rest")
    sets = sets_of(df, text, rest.select(F.col("fp").alias("a"), F.col("fp").alias("b")), width)
    dealt = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).join(sets, "fp")
    low, high = F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high")
    dealt = dealt.select("root", low, high, "chunk", "fp", "weight", "elements")
    dealt = dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "chunk")

    def run(batches):
        now, held = None, []

        def block_of():
            chunk, fp, weight, some = zip(*held)
            left = chunk.count(now[1]) if now[1] < now[2] else 0
            if now[1] < now[2] and left in (0, len(fp)):  # nothing on one side
                return
            some = [np.frombuffer(x.as_buffer(), np.uint64) for x in some]
            columns = block_rows(np.array(fp), np.array(weight), some, left, every, share)
            yield pa.RecordBatch.from_arrays(list(columns), names=["fp", "to", "links"])

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)))
            values = zip(*(batch.column(k).to_pylist() for k in range(3, 6)), batch.column(6))
            for key, value in zip(keys, values):
                if key != now and held:
                    yield from block_of()
                    held = []
                now = key
                held.append(value)
        if held:
            yield from block_of()

    return materialise(ready.unionByName(dealt.mapInArrow(run, LINKS)), "all-links")


def class_sizes(rows):
    """A row per class: its smallest key, rows (``weight``) and elements (``n``)."""
    some = rows.filter("fp is not null").groupBy("fp")
    return some.agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("weight"), F.max("n_shingles").alias("n"))


def link_pairs(df, key="doc_id", text="text", width=WIDTH, share=SHARE, bits=SKETCH_BITS, hot=HOT, block=BLOCK):
    """(a, b) of all links between different sets, once each; a class stands as its smallest key."""
    rows, counts = described(df, key, text, width, bits)
    sizes = materialise(class_sizes(rows), "sizes")
    found = links(df, materialise(spanning(df, counts, text, width, share, bits, hot), "spanning"), sizes, text, width, share, block, every=True)
    name = lambda c: sizes.select(F.col("fp").alias(f"_{c}"), F.col("least").alias(c))
    pairs = found.filter("to is not null").join(name("a"), F.col("fp") == F.col("_a")).join(name("b"), F.col("to") == F.col("_b"))
    return pairs.select("a", "b")


def grouped(df, key="doc_id", text="text", width=WIDTH, share=SHARE, bits=SKETCH_BITS, hot=HOT, block=BLOCK):
    """key, n_shingles, component_id and n_links of every row.

    ``component_id`` is the smallest key reachable by links (null keys are larger than any other),
    ``n_links`` the number of other rows that link with the row, those with an equal set among them.
    A text without words links with nothing and is its own component; a null text counts as empty.
    """
    rows, counts = described(df, key, text, width, bits)
    sizes = materialise(class_sizes(rows), "sizes")
    edges = materialise(spanning(df, counts, text, width, share, bits, hot), "spanning")
    found = links(df, edges, sizes, text, width, share, block)
    roots = components(found.filter("to is not null").select(F.col("fp").alias("a"), F.col("to").alias("b")))
    many = found.filter("to is null").groupBy("fp").agg(F.sum("links").alias("links"))
    classes = sizes.join(many, "fp", "left").join(roots, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    known = rows.join(classes, F.col("fp") == F.col("_fp"), "left")
    known = materialise(known.select("key", "n_shingles", "root", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "members")
    least = known.filter("root is not null").groupBy("root").agg(F.min("key").alias("component_id"))
    joined = known.join(least.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root"), "left")
    own = F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return joined.select("key", "n_shingles", own.alias("component_id"), "n_links")


def representatives(df, key="doc_id", text="text", **options):
    """Rows of ``df`` that stay when of each component only the smallest key does, all columns as they are.

    A null key is larger than any other; of rows that share a key, null or not, the one whose text has the
    smaller hash stays. Rows that share key and text are one document: they stay or go together.
    """
    place = F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = df.select(place.alias("key"), F.col(text).alias("text"))
    found = materialise(grouped(rows, "key", "text", **options), "components")
    lost = found.filter(F.col("key") != F.col("component_id")).select("key").distinct()
    taken = "__lost"
    while taken in df.columns:
        taken = "_" + taken
    lost = lost.withColumnRenamed("key", taken)
    return df.join(lost, place == F.col(taken), "left_anti")


def documents_query(docs):
    """op9: size of the shingle set and component of every document."""
    return grouped(docs).select(F.col("key").alias("doc_id"), "n_shingles", "component_id")
