"""Word shingles of whole texts as 64-bit hashes, a batch of texts at a time."""

import numpy as np

CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STATE = {"mult": np.zeros(0, np.uint64)}


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(n):
    """A fixed odd number for each place in a word."""
    if len(_STATE["mult"]) < n:
        i = np.arange(1, max(n, 1024) + 1, dtype=np.uint64)
        _STATE["mult"] = mix(i * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _STATE["mult"]


def word_hashes(texts):
    """(hash of each word, edge) of a list of texts; words of text k are edge[k] to edge[k + 1].

    Words are runs of bytes other than ASCII white space; A to Z are lower-cased.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    first = np.concatenate(([0], np.cumsum(size + 1)))
    ink = np.flatnonzero(~_SPACE[b])
    if not len(ink):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(np.diff(ink, prepend=-2) > 1)  # where words begin, within ink
    length = np.diff(at, append=len(ink))
    local = np.arange(len(ink)) - np.repeat(at, length)
    value = _LOWER[b[ink]].astype(np.uint64) + np.uint64(1)
    h = np.add.reduceat(_multipliers(int(length.max()))[local] * value, at)
    return mix(h + length.astype(np.uint64)), np.searchsorted(ink[at], first)


def shingle_sets(texts, width=5):
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    words, edge = word_hashes(texts)
    place = mix(np.arange(11, 11 + width, dtype=np.uint64)) | np.uint64(1)
    run = len(words) - width + 1
    if run > 0:
        total = words[:run] * place[0]
        for k in range(1, width):
            total += words[k : k + run] * place[k]
        total = mix(total)
    out = []
    for a, b in zip(edge[:-1], edge[1:]):
        n = b - a
        if n >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif n:
            out.append(mix((words[a:b] * place[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def in_chunks(texts, size=CHUNK):
    """Consecutive groups of texts of about ``size`` bytes; a longer text is one group."""
    first, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= size or k == len(texts) - 1:
            yield texts[first : k + 1]
            first, total = k + 1, 0


def all_sets(texts, width=5):
    return [s for some in in_chunks(texts) for s in shingle_sets(some, width)]


def fingerprint(s):
    """One number for a whole set, as a signed long; equal sets have equal ones."""
    return int(mix(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0])
