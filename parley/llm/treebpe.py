"""BPE encoding by tree concatenation, and decoding.

A long text is halved until its parts are short; all parts are encoded at once, in whatever task and
order. Two neighbours are then joined: a window of text around the cut is encoded anew, and grows
until it shows a token of the left part and a token of the right part at exactly the same place. The
joined ids are the left part up to its shared token, the window between, and the right part from its
shared token on.

Why that is exact: a sequence of tokens is the BPE encoding of its text if every two neighbours are
what BPE makes of their own text, and splitting into words has no memory at a token's end. Every two
neighbours of the joined sequence stand next to each other in one of the three encodings, because
the seams are shared tokens. The text is normalised first, so a window does not depend on it.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import wordbpe
from parley.llm.common import texts_of

LEAF = 16384
WINDOW = 48
SLICE = 2048  # texts encoded together
SPECIAL = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}
_SPACES = b" \t\n\x0b\x0c\r"


class Part:
    """Ids of text[lo:hi], with the place in ink (bytes that are not white space) where each ends."""

    __slots__ = ("lo", "hi", "ids", "ends")

    def __init__(self, lo, hi, ids, ends):
        self.lo, self.hi, self.ids, self.ends = lo, hi, ids, ends


class TreeEncoder:
    def __init__(self, vocab, leaf=LEAF, window=WINDOW):
        self.bpe = wordbpe.load(vocab)
        self.leaf, self.window = leaf, window

    def _boundary(self, text, at, step):
        """The next place from ``at`` on, in direction ``step``, where a UTF-8 character begins."""
        while 0 < at < len(text) and 0x80 <= text[at] < 0xC0:
            at += step
        return min(max(at, 0), len(text))

    def _cuts(self, text, lo, hi, out):
        """Halve text[lo:hi] until every part has at most ``leaf`` bytes; collects the inner cuts."""
        if hi - lo <= self.leaf:
            return
        mid = self._boundary(text, (lo + hi) // 2, 1)
        if not lo < mid < hi:
            return
        self._cuts(text, lo, mid, out)
        out.append(mid)
        self._cuts(text, mid, hi, out)

    def _ink(self, text):
        """Running count of bytes that are not ASCII white space: ink[i] of text[:i]."""
        b = np.frombuffer(text, np.uint8)
        ink = np.zeros(len(b) + 1, np.int64)
        np.cumsum(~((b == 32) | ((b >= 9) & (b <= 13))), out=ink[1:])
        return ink

    def _part(self, text, ink, lo, hi, ids):
        return Part(lo, hi, ids, ink[lo] + np.cumsum(self.bpe.width[ids], dtype=np.int64))

    def _seam(self, left, right, mid_ids, mid_ends, cut_ink):
        """Joined (ids, ends) if the window shares a token with either side of the cut, else None."""
        starts = mid_ends - self.bpe.width[mid_ids]
        a = None
        before = np.flatnonzero(mid_ends <= cut_ink)
        for k in before[::-1]:
            at = np.searchsorted(left.ends, mid_ends[k])
            if at < len(left.ids) and left.ends[at] == mid_ends[k] and left.ids[at] == mid_ids[k]:
                a = (at, k)
                break
        right_starts = right.ends - self.bpe.width[right.ids]
        b = None
        for k in np.flatnonzero(starts >= cut_ink):
            at = np.searchsorted(right_starts, starts[k])
            if at < len(right.ids) and right_starts[at] == starts[k] and right.ids[at] == mid_ids[k]:
                b = (at, k)
                break
        return a, b

    def _short(self, text):
        """Ids of a window; the library is quicker than the batch encoder on a few words."""
        text = text.decode("utf-8", "replace")
        return np.array(self.bpe.library.encode(text, add_special_tokens=False).ids, np.int32)

    def _join(self, text, ink, left, right):
        cut = left.hi
        if not len(left.ids) or not len(right.ids):
            return Part(left.lo, right.hi, np.concatenate((left.ids, right.ids)), np.concatenate((left.ends, right.ends)))
        size = self.window
        while True:
            lo = max(left.lo, self._boundary(text, max(cut - size, 0), -1))
            hi = min(right.hi, self._boundary(text, cut + size, 1))
            whole_left, whole_right = lo == left.lo, hi == right.hi
            mid = self._part(text, ink, lo, hi, self._short(text[lo:hi]))
            a, b = self._seam(left, right, mid.ids, mid.ends, ink[cut])
            if (a or whole_left) and (b or whole_right):
                # A window that reaches a part's outer end needs no token of it.
                i, k = (a[0] + 1, a[1] + 1) if a else (0, 0)
                j, m = (b[0], b[1]) if b else (len(right.ids), len(mid.ids))
                if k <= m:
                    ids = np.concatenate((left.ids[:i], mid.ids[k:m], right.ids[j:]))
                    ends = np.concatenate((left.ends[:i], mid.ends[k:m], right.ends[j:]))
                    return Part(left.lo, right.hi, ids, ends)
            size *= 2

    def _normal(self, text):
        """A text as the vocabulary's normaliser leaves it; ASCII is left to the encoder."""
        if text.isascii():
            return text
        return self.bpe.library.normalizer.normalize_str(text.decode("utf-8", "replace")).encode()

    def _segments(self, text):
        """Pieces between the special tokens' own strings: (text, id that follows or None)."""
        rest = text
        while True:
            found = [(rest.find(s.encode()), s) for s in SPECIAL]
            found = [x for x in found if x[0] >= 0]
            if not found:
                yield rest, None
                return
            at, name = min(found)
            yield rest[:at], SPECIAL[name]
            rest = rest[at + len(name) :]

    def encode(self, texts):
        """Ids of each text (UTF-8), all leaves of all texts encoded in one go."""
        plans, leaves = [], []
        for text in texts:
            segments = self._segments(text) if b"<|" in text else [(text, None)]
            plan = []
            for raw, follow in segments:
                segment, cuts = raw, []
                if len(raw) > self.leaf:
                    segment = self._normal(raw)
                    self._cuts(segment, 0, len(segment), cuts)
                edges = [0, *cuts, len(segment)]
                plan.append((segment, edges, follow))
                leaves += [segment[a:b] for a, b in zip(edges[:-1], edges[1:])]
            plans.append(plan)
        encoded = iter(self.bpe.encode(leaves))
        out = []
        for plan in plans:
            ids = []
            for segment, edges, follow in plan:
                if len(edges) == 2:
                    ids.append(next(encoded))
                else:
                    ink = self._ink(segment)
                    parts = [
                        self._part(segment, ink, a, b, next(encoded)) for a, b in zip(edges[:-1], edges[1:])
                    ]
                    while len(parts) > 1:  # neighbours, level by level
                        parts = [
                            self._join(segment, ink, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k]
                            for k in range(0, len(parts), 2)
                        ]
                    ids.append(parts[0].ids)
                if follow is not None:
                    ids.append(np.array([follow], np.int32))
            out.append(ids[0] if len(ids) == 1 else np.concatenate(ids))
        return out

    def decode(self, ids):
        """Text of an array of ids, special tokens kept.

        Without a decoder in the vocabulary file the library puts one space between tokens.
        """
        if self.bpe.library.decoder is None:
            return " ".join(self.bpe.tokens[ids].tolist())
        return self.bpe.library.decode(ids.tolist(), skip_special_tokens=False)


def encoded(df, vocab, key="doc_id", text="text", leaf=LEAF):
    """(key, ids, decoded) of every row; a null text counts as empty."""
    fields = [
        T.StructField("key", df.schema[key].dataType),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ]
    return _encode(df, key, text, vocab, leaf, fields, lambda ids, decoded: (pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)))


def digests(df, vocab, key="doc_id", text="text", leaf=LEAF):
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row."""
    fields = [
        T.StructField("key", df.schema[key].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def summary(ids, decoded):
        number = wordbpe.load(vocab).numbers
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([sha(" ".join(number[x].tolist())) for x in ids], pa.string()),
            pa.array([sha(x) for x in decoded], pa.string()),
        )

    return _encode(df, key, text, vocab, leaf, fields, summary)


def _encode(df, key, text, vocab, leaf, fields, columns):
    names = [f.name for f in fields]

    def run(batches):
        tree = TreeEncoder(vocab, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                ids = tree.encode(texts_of(some.column(1)))
                decoded = [tree.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns(ids, decoded)], names=names)

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields))


def documents_query(docs, vocab):
    """op8: digests of all documents' ids and decoded texts."""
    return digests(docs, vocab).withColumnRenamed("key", "doc_id")
