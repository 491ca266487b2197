"""Encoder for the word BPE vocabulary that encodes each distinct word of a batch once.

The tokenizers library spends most of its time per word on normalising and splitting. White space
never takes part in a token of this vocabulary, so a text's ids are the ids of its words in order.
``WordBpe`` splits a batch of texts into words and class runs with numpy, encodes the distinct ones
and gathers the ids. Words with anything but ASCII and the common Latin letters, with an apostrophe
or with ``<`` (special tokens) go to the library itself, as do very long runs.
"""

import json

import numpy as np

LONG_RUN = 24
CHUNK_BYTES = 2 << 20
NO_RANK = np.int32(1 << 30)


def _class_table():
    cls = np.full(256, 4, np.uint8)
    cls[0x21:0x7F] = 3
    cls[ord("0") : ord("9") + 1] = 2
    for first in (ord("a"), ord("A")):
        cls[first : first + 26] = 1
    cls[[9, 10, 11, 12, 13, 32]] = 0
    cls[[ord("'"), ord("<")]] = 4
    cls[0xC3] = 1
    return cls


def _byte_chars():
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    chars = {b: chr(b) for b in plain}
    return chars | {b: chr(256 + k) for k, b in enumerate(other)}


class PairTable:
    """Open-addressing table from a pair of ids to (rank, id of the merged token)."""

    def __init__(self, left, right, merged, bits=19):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NO_RANK, np.int32)
        self.new = np.zeros(1 << bits, np.int32)
        key = (left.astype(np.int64) << 16) | right
        slots, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            at = slots[todo]
            free = self.keys[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            where = at[put]
            self.keys[where], self.rank[where], self.new[where] = key[todo[put]], todo[put], merged[todo[put]]
            todo = todo[~put]
            slots[todo] = np.where(self.keys[slots[todo]] >= 0, (slots[todo] + 1) & self.mask, slots[todo])

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left, right):
        """Slot of each pair, or that of an empty entry, whose rank is NO_RANK."""
        key = (left.astype(np.int64) << 16) | right
        at = self._slot(key)
        seen = self.keys[at]
        off = np.flatnonzero((seen != key) & (seen >= 0))
        while len(off):
            at[off] = (at[off] + 1) & self.mask
            seen = self.keys[at[off]]
            off = off[(seen != key[off]) & (seen >= 0)]
        return at


class WordBpe:
    def __init__(self, path):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, chars = model["vocab"], _byte_chars()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable(
            np.array([vocab[a] for a, _ in pairs]),
            np.array([vocab[b] for _, b in pairs]),
            np.array([vocab[a + b] for a, b in pairs]),
        )
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[chars[b] + "</w>"] for b in range(256)], np.int32)
        #: Bytes of normalised text that a token covers; special tokens cover none.
        self.width = np.zeros(self.library.get_vocab_size(), np.int32)
        for token, i in vocab.items():
            self.width[i] = len(token.removesuffix("</w>"))
        size = len(self.width)
        self.tokens = np.array([self.library.id_to_token(i) for i in range(size)], object)
        self.numbers = np.array([str(i) for i in range(size)], object)
        rng = np.random.default_rng(20240607)
        self.mult = rng.integers(1, 1 << 63, LONG_RUN + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        self.cls = _class_table()
        low = np.arange(256, dtype=np.uint8)
        low[ord("A") : ord("Z") + 1] += 32
        self.low = low

    def _runs(self, sym, length):
        """Token ids of runs given as rows of symbols: (flat ids, ids per row)."""
        n, width = sym.shape
        out, counts = np.zeros((n, width), np.int32), length.copy()
        col = np.arange(width)
        rank = np.full((n, max(width - 1, 1)), NO_RANK, np.int32)
        row, at = np.nonzero(col[None, : width - 1] < (length - 1)[:, None])
        if len(row):
            rank[row, at] = self.pairs.rank[self.pairs.find(sym[row, at], sym[row, at + 1])]
        live = np.arange(n)
        while len(live):
            best = rank.argmin(1)
            low = rank[np.arange(len(live)), best]
            done = low == NO_RANK
            if done.any():
                out[live[done]] = sym[done]
                counts[live[done]] = length[done]
                keep = ~done
                live, sym, rank, length, best = live[keep], sym[keep], rank[keep], length[keep], best[keep]
                if not len(live):
                    break
            rows = np.arange(len(live))
            merged = self.pairs.new[self.pairs.find(sym[rows, best], sym[rows, best + 1])]
            take = col[None, :] + (col[None, :] > best[:, None])
            np.minimum(take, width - 1, out=take)
            sym = np.take_along_axis(sym, take, 1)
            sym[rows, best] = merged
            rank = np.take_along_axis(rank, np.minimum(take[:, : width - 1], width - 2), 1)
            length = length - 1
            # Entries past the end are stale after the shift; the pairs beside the merge are new.
            rank[col[None, : width - 1] >= (length - 1)[:, None]] = NO_RANK
            for shift in (-1, 0):
                p = best + shift
                ok = np.flatnonzero((p >= 0) & (p < length - 1))
                r, q = rows[ok], p[ok]
                rank[r, q] = self.pairs.rank[self.pairs.find(sym[r, q], sym[r, q + 1])]
        flat = out[col[None, :] < counts[:, None]]
        return flat, counts

    def _library(self, words):
        ids = [e.ids for e in self.library.encode_batch(words, add_special_tokens=False)] if words else []
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.array([i for x in ids for i in x], np.int32), counts

    def _chunk(self, texts):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = b"\n".join(texts) + b"\n"
        b = np.frombuffer(raw, np.uint8)
        first = np.concatenate(([0], np.cumsum(size + 1)[:-1])) if len(texts) else size
        cls, low = self.cls[b], self.low[b]
        high = np.flatnonzero(b >= 0x80)
        if len(high):
            value, before = b[high], b[np.maximum(high - 1, 0)]
            letter = (value < 0xC0) & (before == 0xC3) & (value != 0x97) & (value != 0xB7)
            cls[high[letter]] = 1
            up = high[letter & (value < 0x9F)]
            low[up] += 0x20
        odd_at = np.flatnonzero(cls == 4)
        odd_start = odd_end = np.zeros(0, np.int64)
        if len(odd_at):
            space = np.flatnonzero(cls == 0)
            k = np.searchsorted(space, odd_at)
            odd_start, odd_end = np.where(k > 0, space[np.maximum(k - 1, 0)] + 1, 0), space[k]
            odd_start, keep = np.unique(odd_start, return_index=True)
            odd_end = odd_end[keep]
            step = np.zeros(len(b) + 1, np.int8)
            step[odd_start] += 1
            step[odd_end] -= 1
            cls[np.cumsum(step[:-1], dtype=np.int8) > 0] = 0
        inside = cls > 0
        change = np.empty(len(b) + 1, bool)
        change[0], change[-1] = True, True
        np.not_equal(cls[1:], cls[:-1], out=change[1:-1])
        digit = cls == 2
        start = np.flatnonzero(inside & (change[:-1] | digit))
        end = np.flatnonzero(inside & (change[1:] | digit)) + 1
        length = end - start
        # Runs beyond LONG_RUN go to the library, as whole words would.
        long = np.flatnonzero(length > LONG_RUN)
        odd = [raw[s:e].decode("utf-8", "replace") for s, e in zip(odd_start, odd_end)]
        odd += [raw[start[i] : end[i]].decode("utf-8", "replace") for i in long]
        odd_pos = np.concatenate((odd_start, start[long]))
        if len(long):
            keep = length <= LONG_RUN
            start, length = start[keep], length[keep]
        ids, counts, ref = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(start):
            ends = np.cumsum(length)
            local = np.arange(ends[-1]) - np.repeat(ends - length, length)
            chars = low[np.repeat(start, length) + local]
            key = np.add.reduceat(self.mult[local] * (chars.astype(np.uint64) + np.uint64(1)), ends - length)
            key ^= key >> np.uint64(29)
            _, pick, ref = np.unique(key, return_index=True, return_inverse=True)
            length_u = length[pick]
            order = np.argsort(length_u, kind="stable")  # rows of one width at a time
            parts, sizes = [], np.zeros(len(pick), np.int64)
            cut = np.searchsorted(length_u[order], [0, 5, 9, 13, LONG_RUN + 1])
            for lo, hi in zip(cut[:-1], cut[1:]):
                if lo == hi:
                    continue
                rows = order[lo:hi]
                n = length_u[rows]
                col = np.arange(max(int(n.max()), 2))
                at = np.minimum(start[pick[rows]][:, None] + col[None, :], len(b) - 1)
                byte = low[at]
                sym = np.where(col[None, :] == (n - 1)[:, None], self.last[byte], self.inner[byte])
                flat, c = self._runs(sym, n)
                parts.append((rows, flat))
                sizes[rows] = c
            offset = np.concatenate(([0], np.cumsum(sizes)))
            ids = np.zeros(offset[-1], np.int32)
            for rows, flat in parts:
                c = sizes[rows]
                e = np.cumsum(c)
                ids[np.repeat(offset[rows] - (e - c), c) + np.arange(len(flat))] = flat
            counts = sizes
        if odd:
            names = list(dict.fromkeys(odd))
            number = {w: k for k, w in enumerate(names)}
            more, n = self._library(names)
            ref = np.concatenate((ref, len(counts) + np.fromiter(map(number.__getitem__, odd), np.int64, len(odd))))
            ids, counts = np.concatenate((ids, more)), np.concatenate((counts, n))
            start = np.concatenate((start, odd_pos))
            order = np.argsort(start, kind="stable")
            start, ref = start[order], ref[order]
        offset = np.concatenate(([0], np.cumsum(counts)))
        c = counts[ref] if len(ref) else np.zeros(0, np.int64)
        e = np.cumsum(c)
        total = int(e[-1]) if len(e) else 0
        flat = ids[np.repeat(offset[ref] - (e - c), c) + np.arange(total)] if total else np.zeros(0, np.int32)
        before = np.concatenate(([0], e))
        edge = before[np.searchsorted(start, np.concatenate((first, [len(b)])))] if len(texts) else np.zeros(1, int)
        return flat, edge

    def encode(self, texts):
        """Ids of each text (bytes in UTF-8), as the library gives them without special tokens."""
        out, batch, size = [], [], 0
        for k, text in enumerate(texts):
            batch.append(text)
            size += len(text) + 1
            if size >= CHUNK_BYTES or k == len(texts) - 1:
                flat, edge = self._chunk(batch)
                out += np.split(flat, edge[1:-1])
                batch, size = [], 0
        return out


_LOADED = {}


def load(path):
    """The encoder for a vocabulary file, read once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
