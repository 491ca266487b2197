"""A small causal self-attention model over subword ids, in numpy.

One attention layer with learned distance biases, one hidden layer, and a two-level softmax: the
``CLUSTERS * SIZE`` most frequent ids lie in clusters of ``SIZE`` by rank, all others in a tail whose
ids have fixed shares. The first level chooses a cluster, the second an id within it, so a token costs
two short softmaxes and not one over the vocabulary.

Texts are scored in windows of ``SPAN`` inputs of which the last ``FRESH`` are scored; the others overlap
the window before, so each token is scored once, with SPAN - FRESH to SPAN inputs before it. All
windows of a batch of texts go through one masked attention.
"""

import functools
import math

import numpy as np

SPAN = 24
FRESH = 16
DIM = 16
HIDDEN = 32
CLUSTERS = 31
SIZE = 24
NAMED = CLUSTERS * SIZE
TAIL = NAMED  # input number of the rare ids
STEP = 256  # windows scored in one go
BATCH = 128  # windows of a training step; the arrays of larger ones cost page faults
SAFE = 60.0  # exponents below this need no maximum taken off
F32 = np.float32


class Vocabulary:
    """Numbers of ids by frequency and the shares of the rare ones."""

    def __init__(self, counts, end_id):
        counts = np.asarray(counts, np.float64)
        order = np.argsort(-counts, kind="stable")
        named = order[:NAMED]
        if end_id not in named:
            named[-1] = end_id
        self.number = np.full(len(counts), TAIL, np.int32)
        self.number[named] = np.arange(len(named))
        rare = self.number == TAIL
        share = np.where(rare, counts + 0.5, 0)
        self.log_share = np.where(rare, np.log(np.maximum(share, 1e-30) / max(share.sum(), 1e-30)), 0).astype(F32)
        self.named_counts = np.zeros(NAMED)
        self.named_counts[: len(named)] = counts[named]
        self.tail_count = counts[rare].sum()
        self.end_id = end_id
        #: What stands before a text: the end of another one.
        self.start = int(self.number[end_id])


def initial(vocabulary, seed=7):
    """Weights that predict the ids' frequencies whatever the context."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(F32)
    inside = vocabulary.named_counts.reshape(CLUSTERS, SIZE) + 0.1
    cluster = np.append(inside.sum(1), vocabulary.tail_count + 0.5)
    return {
        "emb": normal(NAMED + 1, DIM, scale=0.3),
        "wq": normal(DIM, DIM, scale=DIM**-0.5),
        "wk": normal(DIM, DIM, scale=DIM**-0.5),
        "wv": normal(DIM, DIM, scale=0.5 * DIM**-0.5),
        "near": (-0.1 * np.arange(SPAN)).astype(F32),
        "w1": normal(DIM, HIDDEN, scale=DIM**-0.5),
        "b1": np.zeros(HIDDEN, F32),
        "w2": normal(HIDDEN, DIM, scale=0.5 * HIDDEN**-0.5),
        "top": normal(DIM, CLUSTERS + 1, scale=0.05),
        "top0": np.log(cluster / cluster.sum()).astype(F32),
        "in": normal(CLUSTERS, DIM, SIZE, scale=0.05),
        "in0": np.log(inside / inside.sum(1, keepdims=True)).astype(F32),
    }


def pack(weights):
    return np.concatenate([weights[k].ravel() for k in sorted(weights)]).astype("<f4")


def unpack(flat, like):
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[at : at + n].reshape(like[k].shape).astype(F32)
        at += n
    return out


@functools.cache
def _mask(rows, cols):
    """Distance of each key to each query (rows are the last inputs), and where the key is later."""
    distance = (np.arange(cols - rows, cols)[:, None] - np.arange(cols)[None, :]).astype(np.int64)
    return np.clip(distance, 0, SPAN - 1), distance < 0


def _log_sums(s, bound):
    """Log of the sums of exp(s) along the last axis; ``s`` is used up."""
    top = 0
    if bound > SAFE:
        top = s.max(-1)
        s -= top[:, None]
    np.exp(s, out=s)
    return np.log(s @ np.ones(s.shape[1], F32)) + top


class Room:
    """Arrays that are used again, by each step and within it; fresh ones of this size would cost page faults."""

    def __init__(self):
        self.held = {}

    def __call__(self, name, shape, kind):
        """An array with whatever was in it before."""
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size or self.held[name].dtype != kind:
            self.held[name] = np.empty(size, kind)
        return self.held[name][:size].reshape(shape)


class Scorer:
    """Natural log probabilities of texts' ids."""

    def __init__(self, weights, vocabulary):
        self.w, self.v, self.room = weights, vocabulary, Room()
        scale = F32(DIM**-0.5)
        self.q, self.k = weights["emb"] @ weights["wq"] * scale, weights["emb"] @ weights["wk"]
        # The column of ones sums the attention weights up.
        ones = np.ones((len(weights["emb"]), 1), F32)
        self.val = np.concatenate((weights["emb"] @ weights["wv"], ones), 1)
        distance, later = _mask(FRESH, SPAN)
        self.bias = np.where(later, F32(-1e9), weights["near"][distance]).astype(F32)
        norm = lambda x: float(np.linalg.norm(x, axis=-1).max())
        self.attention_bound = norm(self.q) * norm(self.k) + float(np.abs(weights["near"]).max())
        self.top_norm, self.top_bias = norm(weights["top"].T), float(np.abs(weights["top0"]).max())
        self.in_norm, self.in_bias = norm(weights["in"].transpose(0, 2, 1)), float(np.abs(weights["in0"]).max())

    def __call__(self, texts):
        """Sum over each text's ids, the end id appended."""
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        return self.sums(np.concatenate([np.zeros(0, np.int32), *(part for t in texts for part in (t, [self.v.end_id]))]), size)

    def sums(self, flat, size):
        """The same for texts that stand one after another, each of ``size`` ids with its end id."""
        v = self.v
        flat = flat.astype(np.int32)
        blocks = -(-size // FRESH)
        first = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        if not total:
            return np.zeros(0)
        # Inputs are the targets moved by one place; a text's first input is the end id.
        begin = np.cumsum(size) - size
        at = np.repeat(first * FRESH - begin, size) + np.arange(len(flat))
        target = np.full(total * FRESH, -1, np.int32)
        target[at] = flat
        inputs = np.full(total * FRESH, v.start, np.int32)
        inputs[1:] = np.where(target[:-1] >= 0, v.number[target[:-1]], v.start)
        inputs[first * FRESH] = v.start
        inputs = inputs.reshape(total, FRESH)
        opening = np.zeros(total, bool)
        opening[first] = True
        logs = np.zeros(total * FRESH, np.float64)
        back = SPAN - FRESH
        for lo in range(0, total, STEP):
            hi = min(lo + STEP, total)
            before = np.concatenate((inputs[max(lo - 1, 0)][None], inputs[lo : hi - 1]))[:, FRESH - back :]
            window = np.concatenate((before, inputs[lo:hi]), 1)
            logs[lo * FRESH : hi * FRESH] = self._windows(window, opening[lo:hi], target[lo * FRESH : hi * FRESH])
        return np.add.reduceat(logs, first * FRESH)

    def _windows(self, window, opening, target):
        w = self.w
        own = window[:, SPAN - FRESH :]
        # Products of many small matrices are several times faster with a copy than with a transposed second one.
        n = len(window)
        k = self.room("k", (n, DIM, SPAN), F32)
        np.copyto(k, self.k[window].transpose(0, 2, 1))
        s = np.matmul(self.q[own], k, out=self.room("s", (n, FRESH, SPAN), F32))
        s += self.bias
        s[opening, :, : SPAN - FRESH] = -1e9
        if self.attention_bound > SAFE:
            s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        z = np.matmul(s, self.val[window])
        z = z[..., :DIM] / z[..., DIM:]
        z += w["emb"][own]
        want = np.flatnonzero(target >= 0)
        cluster = self.v.number[target[want]] // SIZE
        order = np.argsort(cluster.astype(np.int8), kind="stable")
        want, cluster = want[order], cluster[order]
        ids = target[want]
        z, number = z.reshape(-1, DIM)[want], self.v.number[ids]
        a = z @ w["w1"]
        a += w["b1"]
        np.maximum(a, 0, out=a)
        h = z + a @ w["w2"]
        longest = float(np.sqrt(np.einsum("ij,ij->i", h, h).max())) if len(h) else 0.0
        top = h @ w["top"]
        top += w["top0"]
        value = top[np.arange(len(want)), cluster] + self.v.log_share[ids]
        value -= _log_sums(top, longest * self.top_norm + self.top_bias)
        edge = np.searchsorted(cluster, np.arange(CLUSTERS + 1))
        named = edge[CLUSTERS]
        inside = self.room("inside", (named, SIZE), F32)
        for c in range(CLUSTERS):
            lo, hi = edge[c], edge[c + 1]
            if lo < hi:
                np.matmul(h[lo:hi], w["in"][c], out=inside[lo:hi])
                inside[lo:hi] += w["in0"][c]
        value[:named] += inside.ravel()[np.arange(named) * SIZE + number[:named] % SIZE]
        value[:named] -= _log_sums(inside, longest * self.in_norm + self.in_bias)
        out = np.zeros(len(target), F32)
        out[want] = value
        return out


def _shares(s):
    """Softmax along the last axis, in place; the sums are products with ones."""
    if s.size and (s.max() > SAFE or s.min() < -SAFE):
        s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    s *= (1 / (s @ np.ones(s.shape[-1], s.dtype)))[..., None]
    return s


def _sums_by(number, rows, size):
    """Sum of the rows of each number below ``size``."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    order = np.argsort(number.astype(np.int16), kind="stable")
    number = number[order]
    at = np.flatnonzero(np.diff(number, prepend=-1))
    out[number[at]] = np.add.reduceat(rows[order], at, axis=0)
    return out


def gradients(w, x, y, room=None):
    """Mean loss and gradients for windows: inputs x and targets y of shape (windows, SPAN).

    Inputs have their queries, keys and values from one table. Behind the attention the tokens stand in
    the order of their targets' clusters, so that each cluster's share of every array is a slice.
    """
    room = room or Room()
    n, span = x.shape
    many = n * span
    kind = w["emb"].dtype
    scale = kind.type(DIM**-0.5)
    new = lambda name, *shape: room(name, shape, kind)
    inputs, number = x.ravel(), y.ravel()
    cluster = np.minimum(number // SIZE, CLUSTERS).astype(np.int8)
    order = np.argsort(cluster, kind="stable")
    number, cluster = number[order], cluster[order]
    edge = np.searchsorted(cluster, np.arange(CLUSTERS + 1))
    rows, named = np.arange(many), edge[CLUSTERS]

    # Columns: input vector, query, key, value, and a one that adds the attention weights up.
    project = np.concatenate((w["wq"] * scale, w["wk"], w["wv"]), 1)
    table = np.concatenate((w["emb"], w["emb"] @ project, np.ones((len(w["emb"]), 1), kind)), 1)
    seen = np.take(table, inputs, axis=0, out=new("seen", many, 4 * DIM + 1), mode="clip")
    both = seen.reshape(n, span, -1)
    q, k, v1 = both[..., DIM : 2 * DIM], both[..., 2 * DIM : 3 * DIM], both[..., 3 * DIM :]
    # Copies, as in the scorer.
    turned = new("turned", n, 2 * DIM + 1, span)
    np.copyto(turned, both[..., 2 * DIM :].transpose(0, 2, 1))
    p = np.matmul(q, turned[:, :DIM], out=new("p", n, span, span))
    # Later inputs get no share; each row keeps its own input, so no sum is 0.
    distance, later = _mask(span, span)
    far = max(p.max(), -p.min()) + np.abs(w["near"]).max()
    p += np.where(later, kind.type(-1e9), w["near"][distance])
    if not far < SAFE:
        p -= p.max(-1, keepdims=True)
    np.exp(p, out=p)
    mixed = np.matmul(p, v1, out=new("mixed", n, span, DIM + 1))
    part = 1 / mixed[..., DIM:]
    mixed = np.multiply(mixed[..., :DIM], part, out=mixed[..., :DIM])

    # A column of ones takes the biases along in the products.
    z = new("z", many, DIM + 1)
    z[:, DIM] = 1
    np.add(both[..., :DIM], mixed, out=z[:, :DIM].reshape(n, span, DIM))
    z = np.take(z, order, axis=0, out=new("z in order", many, DIM + 1), mode="clip")
    r = np.matmul(z, np.concatenate((w["w1"], w["b1"][None])), out=new("r", many, HIDDEN))
    np.maximum(r, 0, out=r)
    h = new("h", many, DIM + 1)
    h[:, DIM] = 1
    np.matmul(r, w["w2"], out=h[:, :DIM])
    h[:, :DIM] += z[:, :DIM]

    g = {}
    t = _shares(np.matmul(h, np.concatenate((w["top"], w["top0"][None])), out=new("wide", many, CLUSTERS + 1)))
    at = rows * (CLUSTERS + 1) + cluster
    loss = -np.log(t.ravel()[at] + kind.type(1e-30)).sum()
    t.ravel()[at] -= 1
    add = h.T @ t
    g["top"], g["top0"] = add[:-1], add[-1]
    dh = np.matmul(t, w["top"].T, out=new("dh", many, DIM))
    inside = np.concatenate((w["in"], w["in0"][:, None]), 1)
    back = np.ascontiguousarray(w["in"].transpose(0, 2, 1))
    parts = [(c, edge[c], edge[c + 1]) for c in range(CLUSTERS) if edge[c] < edge[c + 1]]
    t = new("wide", named, SIZE)
    for c, lo, hi in parts:
        np.matmul(h[lo:hi], inside[c], out=t[lo:hi])
    _shares(t)
    at = rows[:named] * SIZE + number[:named] % SIZE
    loss -= np.log(t.ravel()[at] + kind.type(1e-30)).sum()
    t.ravel()[at] -= 1
    add, more = np.zeros_like(inside), new("more", many, DIM)
    for c, lo, hi in parts:
        np.matmul(h[lo:hi].T, t[lo:hi], out=add[c])
        np.matmul(t[lo:hi], back[c], out=more[lo:hi])
    g["in"], g["in0"] = add[:, :-1], add[:, -1]
    dh[:named] += more[:named]

    g["w2"] = r.T @ dh
    dr = np.matmul(dh, w["w2"].T, out=new("wide", many, HIDDEN))
    dr *= np.greater(r, 0, out=room("active", r.shape, bool))
    add = z.T @ dr
    g["w1"], g["b1"] = add[:-1], add[-1]
    dh += np.matmul(dr, w["w1"].T, out=more)

    de, dqkv = new("z", many, DIM), new("r", n, span, 3 * DIM)
    de[order] = dh
    dz = new("h", n, span, DIM + 1)
    np.multiply(de.reshape(n, span, DIM), part, out=dz[..., :DIM])
    np.negative(np.einsum("nij,nij->ni", dz[..., :DIM], mixed), out=dz[..., DIM])
    ds = np.matmul(dz, turned[:, DIM:], out=new("wide", n, span, span))
    ds *= p
    g["near"] = np.bincount(distance.ravel(), np.where(later, 0, ds.sum(0)).ravel(), SPAN).astype(kind)
    np.matmul(ds, k, out=dqkv[..., :DIM])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., DIM : 2 * DIM])
    np.matmul(p.transpose(0, 2, 1), dz[..., :DIM], out=dqkv[..., 2 * DIM :])
    dqkv = dqkv.reshape(many, 3 * DIM)
    add = seen[:, :DIM].T @ dqkv
    g["wq"], g["wk"], g["wv"] = add[:, :DIM] * scale, add[:, DIM : 2 * DIM], add[:, 2 * DIM :]
    de += np.matmul(dqkv, project.T, out=more)
    g["emb"] = _sums_by(inputs, de, len(table))
    return loss / many, {name: g[name] / kind.type(many) for name in w}


class Adam:
    """``w`` are views of one flat vector, in the order of ``pack``."""

    def __init__(self, weights, rate):
        self.rate, self.t, self.room = rate, 0, Room()
        self.flat = pack(weights).astype(F32)
        self.w, at = {}, 0
        for k in sorted(weights):
            self.w[k] = self.flat[at : at + weights[k].size].reshape(weights[k].shape)
            at += weights[k].size
        self.m, self.s, self.root = (np.zeros_like(self.flat) for _ in range(3))

    def step(self, x, y):
        loss, g = gradients(self.w, x, y, self.room)
        d = np.concatenate([g[k].ravel() for k in self.w])
        self.t += 1
        warm = min(1.0, self.t / 10)
        self.m *= F32(0.9)
        self.m += F32(0.1) * d
        self.s *= F32(0.98)
        d *= d
        d *= F32(0.02)
        self.s += d
        np.sqrt(self.s, out=self.root)
        self.root *= F32((1 - 0.98**self.t) ** -0.5)
        self.root += F32(1e-6)
        np.divide(self.m, self.root, out=self.root)
        self.root *= F32(self.rate * warm / (1 - 0.9**self.t))
        self.flat -= self.root
        return loss


def in_parts(blocks, most=1 << 18):
    """Blocks of windows put together to parts of about ``most`` windows."""
    held, n = [], 0
    for block in blocks:
        held.append(block.astype(np.int16))  # numbers go up to TAIL
        n += len(block)
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def train(weights, blocks, rate, steps=200, seed=0):
    """(weights, number of windows): one pass over blocks of windows of numbers, shape (n, SPAN + 1).

    Starts from copies of the weights. Blocks are read one after another; windows are mixed within
    parts of bounded size. A part has at least about ``steps`` steps, of 16 to ``BATCH`` windows each; the
    rate falls to a twentieth over a part.
    """
    adam, rng, n = Adam({k: v.copy() for k, v in weights.items()}, rate), np.random.default_rng(seed), 0
    for windows in in_parts(blocks):
        batch = min(max(len(windows) // steps, 16), BATCH)
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            some = windows[order[at : at + batch]].astype(np.int64)
            adam.rate = rate * (1 - 0.95 * at / len(order))
            adam.step(some[:, :-1], some[:, 1:])
        n += len(windows)
    return adam.w, n
