"""Best-fit packing of tokenised documents by exact-complement hashing.

Only the histogram of piece lengths is planned, of which there are at most ``capacity`` entries
whatever the number of documents. From the longest length down, the plan looks up the gap that a
sequence has left among the single lengths, the sums of two and the sums of three, and consumes each
combination that fills the gap exactly as often as the availability counts allow. What is left goes
best-fit decreasing, again many equal sequences at a time. Pieces then get the places of their length
by rank, in parallel.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import wordbpe
from parley.llm.common import materialise, number_within, texts_of

CAPACITY = 4096
END_ID = 1
RANK_BITS = 48  # of a rank within a length; a length takes the bits above


def pieces(df, vocab, key="doc_id", text="text", capacity=CAPACITY, end_id=END_ID, with_ids=False):
    """A row per piece: key, piece, start, length, ids_crc32 (and ids). Null text counts as empty.

    Every document ends with ``end_id``; only documents over ``capacity`` ids are cut.
    """
    fields = [
        T.StructField("key", df.schema[key].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches):
        bpe = wordbpe.load(vocab)
        for batch in batches:
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, ids in enumerate(bpe.encode(texts_of(batch.column(1)))):
                ids = np.append(ids, end_id).astype("<u4")
                for n, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    owner.append(k)
                    piece.append(n)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cut, T.StructType(fields))


class Plan:
    """Places for a histogram {length: count}: rows of (length, first rank, count, sequence, offset).

    A row says: the pieces of that length with ranks from ``first`` on, ``count`` of them, lie at
    ``offset`` in the sequences from ``sequence`` on, one in each. The number of rows depends on the
    capacity, not on the counts.
    """

    def __init__(self, histogram, capacity=CAPACITY):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.left = [0] * (capacity + 1)
        for length, n in histogram.items():
            if not 0 < length <= capacity:
                raise ValueError(f"length {length} is not in 1..{capacity}")
            self.left[length] += n
        self.used = [0] * (capacity + 1)
        self.have = self.mirror = 0  # bit sets of the lengths that are left, and of capacity - length
        for length, n in enumerate(self.left):
            if n:
                self._mark(length, True)
        self._exact()
        self._best_fit()

    def _mark(self, length, on):
        for name, bit in (("have", 1 << length), ("mirror", 1 << (self.capacity - length))):
            setattr(self, name, getattr(self, name) | bit if on else getattr(self, name) & ~bit)

    def _times(self, lengths):
        return min(self.left[x] // lengths.count(x) for x in set(lengths))

    def _consume(self, lengths, times):
        for x in lengths:
            self.left[x] -= times
        for x in set(lengths):
            if not self.left[x]:
                self._mark(x, False)

    def _close(self, lengths, times):
        offset = 0
        for x in lengths:
            self.rows.append((x, self.used[x], times, self.sequences, offset))
            self.used[x] += times
            offset += x
        self.sequences += times

    def _pair_bits(self, total):
        """Bit set of the lengths a that are left together with total - a."""
        if not 0 < total <= self.capacity:
            return 0
        return self.have & (self.mirror >> (self.capacity - total)) & ((1 << total) - 1)

    def _fillers(self, gap, parts):
        """Combinations of ``parts`` lengths that sum to ``gap``, longest first part first."""
        if parts == 1:
            if gap > 0 and self.left[gap]:
                yield (gap,)
        elif parts == 2:
            bits = self._pair_bits(gap) >> -(-gap // 2)
            while bits:
                top = bits.bit_length() - 1
                a = top + -(-gap // 2)
                yield (a, gap - a)
                bits &= (1 << top) - 1
        else:
            firsts = self.have & ((1 << max(gap - 1, 0)) - 1)
            while firsts:
                a = firsts.bit_length() - 1
                firsts &= (1 << a) - 1
                if 3 * a < gap:
                    return
                rest = gap - a
                bits = self._pair_bits(rest) & ((1 << (a + 1)) - 1)
                bits >>= -(-rest // 2)
                while bits and self.left[a]:
                    top = bits.bit_length() - 1
                    b = top + -(-rest // 2)
                    yield (a, b, rest - b)
                    bits &= (1 << top) - 1

    def _exact(self):
        if self.left[self.capacity]:
            times = self.left[self.capacity]
            self._consume([self.capacity], times)
            self._close([self.capacity], times)
        for parts in (1, 2, 3):
            for length in range(self.capacity - 1, 0, -1):
                if not self.left[length]:
                    continue
                if length * (parts + 1) < self.capacity:
                    break  # the longest of the combination comes first
                for filler in self._fillers(self.capacity - length, parts):
                    if filler[0] > length:
                        continue
                    lengths = [length, *filler]
                    times = self._times(lengths)
                    if times:
                        self._consume(lengths, times)
                        self._close(lengths, times)
                    if not self.left[length]:
                        break

    def _best_fit(self):
        """Open sequences by gap, as groups of equal ones: (lengths, how many)."""
        open_, gaps = {}, 0
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                fit = gaps >> length
                if fit:
                    gap = length + (fit & -fit).bit_length() - 1
                    lengths, many = open_[gap].pop()
                    if not open_[gap]:
                        gaps &= ~(1 << gap)
                    take = min(many, self.left[length])
                    if many > take:
                        open_[gap].append((lengths, many - take))
                        gaps |= 1 << gap
                    fresh = [((*lengths, length), take, gap - length)]
                    self.left[length] -= take
                else:
                    each = self.capacity // length
                    full, rest = divmod(self.left[length], each)
                    fresh = [((length,) * each, full, self.capacity - each * length)] if full else []
                    if rest:
                        fresh.append(((length,) * rest, 1, self.capacity - rest * length))
                    self.left[length] = 0
                for lengths, many, gap in fresh:
                    open_.setdefault(gap, []).append((lengths, many))
                    gaps |= 1 << gap
        for groups in open_.values():
            for lengths, many in groups:
                self._close(lengths, many)

    def arrays(self):
        """The rows sorted by (length, first rank), as columns."""
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return [np.ascontiguousarray(c) for c in rows.T]


def placed(parts, capacity=CAPACITY, buckets=1024):
    """Add ``sequence_id`` and ``offset`` to rows of (key, piece, start, length, ids_crc32).

    ``parts`` should be a written table: it is read twice. Repeated rows get places of their own.
    """
    counts = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    table = Plan({r["length"]: r["n"] for r in counts}, capacity).arrays()
    sent = parts.sparkSession.sparkContext.broadcast(table)  # its size depends on the capacity only
    ranked = number_within(parts, ["length"], ["key", "piece", "start", "ids_crc32"], buckets)

    def place(frames):
        length, first, _, sequence, offset = sent.value
        order = (length << RANK_BITS) + first
        for frame in frames:
            rank = frame["position"].to_numpy()
            row = np.searchsorted(order, (frame["length"].to_numpy() << RANK_BITS) + rank, "right") - 1
            frame = frame.drop(columns="position")
            frame["sequence_id"] = sequence[row] + rank - first[row]
            frame["offset"] = offset[row]
            yield frame

    schema = T.StructType(
        [
            *[f for f in ranked.schema.fields if f.name != "position"],
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    return ranked.mapInPandas(place, schema)


def packed(df, vocab, key="doc_id", text="text", capacity=CAPACITY):
    """All pieces of all texts with their places. An empty table gives no rows."""
    return placed(materialise(pieces(df, vocab, key, text, capacity), "pieces"), capacity)


def documents_query(docs, vocab):
    """op3: places of all documents' pieces in sequences of at most 4096 tokens."""
    return packed(docs, vocab).select(
        F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
