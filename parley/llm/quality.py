"""Quality rules with risk-controlled cutoffs.

A document that fails the base rules goes. Every further rule compares one number per text with a cutoff,
and labelled texts set the cutoffs of each stratum (by default: each language) in two steps:

* One half of the labelled texts, chosen by a hash of the text, proposes: starting without any rule,
  cutoffs are tightened one at a time, always where most bad texts go for the fewest good ones. That
  is a path of ever stricter rule sets.
* The other half, the holdout, tests: along the path, the share of good texts that a rule set rejects
  is held against ``alpha`` by an exact binomial test, up to the first rule set that fails it.

Stopping at the first failure keeps the error level of one test for the whole path (fixed-sequence
testing), and strata share ``delta`` (Bonferroni). So with probability 1 - delta, in all strata at once,
under ``alpha`` of the good texts that pass the base rules are rejected. Copies of a text are one draw.
A stratum with too few good holdout texts to show that rejects nothing.

Cutoffs, path and test count all labelled texts, in Spark: only numbers by stratum, rule and cutoff come to the driver.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import materialise, texts_of

ALPHA = 0.02  # largest share of good texts that may be rejected by mistake
DELTA = 0.05  # probability that the share is higher in any stratum
MAX_STRATA = 64
LEVELS = 24
MIN_WORDS = 20
MAX_REPEAT = 30  # percent of words
WINDOW = 8
ROWS = 512  # of a batch whose texts are copied at a time

#: A rule rejects what is above its cutoff; all numbers are integers. Names of columns of ``measured``.
RULES = {
    "symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "duplicate_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeated_words": "1000 * n_repeat_words div greatest(n_words, 1)",
    "unvaried_words": "1000 * (n_words - n_distinct) div greatest(n_words, 1)",
    "capitals": "1000 * n_capitals div greatest(word_chars, 1)",
    "long_words": "1000 * word_chars div greatest(n_words, 1)",
    "short_words": "-(1000 * word_chars div greatest(n_words, 1))",
}
NEVER = (1 << 63) - 1

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals"]
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_NOT_CHARS = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))  # white space and all but the first byte of a character
_MULT = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated(ids, window=WINDOW):
    """Number of places that lie in a window of ``window`` numbers found twice or more, the first included."""
    runs = len(ids) - window + 1
    if runs < 2:
        return 0
    h = np.zeros(runs, np.uint64)
    for k in range(window):
        h += ids[k : k + runs].astype(np.uint64) * _MULT[k % WINDOW]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    # Windows with equal sums are compared number by number.
    at = np.sort(order[np.append(same, False) | np.append(False, same)])
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, window)[at])
    _, inverse, n = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[n[inverse.ravel()] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def counts(text):
    """The numbers in ``COUNTS`` of one text (UTF-8). Words are runs without ASCII white space."""
    words = text.split()
    number = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    lines, seen, twice = 0, set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            twice += line in seen
            seen.add(line)
    return (
        len(words),
        len(text.translate(None, _NOT_CHARS)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        twice,
        repeated(np.array(ids, np.int64)) if len(number) < len(words) else 0,
        lines,
        len(number),
        len(text) - len(text.translate(None, _CAPITALS)),
    )


def measured(df, key="doc_id", text="text", stratum="lang"):
    """(key, stratum, ``COUNTS``, digest of the text) of every row; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                some = batch.slice(first, ROWS)
                texts = texts_of(some.column(2))
                columns = zip(*map(counts, texts))
                marks = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), *[pa.array(c, pa.int64()) for c in columns], marks],
                    names=["key", "stratum", *COUNTS, "digest"],
                )

    rows = df.select(F.col(key).alias("key"), F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text"))
    fields = [*rows.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("digest", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType(fields))


def base_failed(min_words=MIN_WORDS, max_repeat=MAX_REPEAT):
    """Too few words, or too many inside repeated windows."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def labelled_texts(rows, labels, key, label):
    """(stratum, good, fit, one value per rule) of every distinct labelled text that passes the base rules.

    Labels other than 0 and 1 are left out. A text is good if any label of its rows in the stratum is 1.
    """
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__good"))
    known = known.filter("__key is not null and __good in (0, 1)").groupBy("__key").agg(F.max("__good").alias("__good"))
    values = [F.expr(v).cast("long").alias(n) for n, v in RULES.items()]
    texts = rows.filter(~base_failed()).select("key", "stratum", "digest", *values)
    # Copies are counted once; equal texts have equal values.
    texts = texts.join(known, F.col("key") == F.col("__key")).groupBy("stratum", "digest")
    texts = texts.agg(F.max("__good").alias("good"), *[F.max(n).alias(n) for n in RULES])
    return texts.select("stratum", "good", (F.pmod(F.xxhash64("digest"), F.lit(2)) == 0).alias("fit"), F.col("digest"), *RULES)


def levels_below(texts, at, levels=LEVELS):
    """{(stratum number, rule number): cutoffs, rising} of the good texts in ``texts``: exact quantiles, by counting.

    Cutoffs are order statistics of the values, from the 90th percentile to the largest. A (stratum, rule, value) has one row.
    """
    values = F.posexplode(F.array(*RULES)).alias("rule", "value")
    found = texts.filter("good = 1").select(at.alias("at"), values).groupBy("at", "rule", "value").agg(F.count(F.lit(1)).alias("n"))
    group = W.partitionBy("at", "rule")
    upto = F.sum("n").over(group.orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    found = found.withColumns({"upto": upto, "all": F.sum("n").over(group)})
    shares = F.array(*[F.lit(float(1 - x)) for x in np.linspace(0, 1, levels) ** 2 * 0.1])
    place = lambda q: F.ceil((F.col("all") - 1) * q)
    picked = F.exists(shares, lambda q: (place(q) < F.col("upto")) & (place(q) >= F.col("upto") - F.col("n")))
    grid = {}
    for r in found.filter(picked).select("at", "rule", "value").collect():
        grid.setdefault((r["at"], r["rule"]), []).append(r["value"])
    return {k: np.sort(np.array(v, np.int64)) for k, v in grid.items()}


def _over(levels, bound):
    """How many texts lie over each of the first ``bound`` cutoffs, from the numbers of texts by level."""
    return levels[::-1].cumsum()[::-1][1 : bound + 1]


def _move(good, bad, n_good, n_bad, have, grid):
    """(rule, place of the cutoff) that rejects the largest share of bad texts for the fewest good ones, or None."""
    best = None
    for r, cutoffs in enumerate(grid):
        for i, (g, b) in enumerate(zip(_over(good[r], have[r]), _over(bad[r], have[r]))):
            lost, caught = g / n_good, b / n_bad
            if caught > lost:
                worth = (caught / (lost + 0.5 / n_good), -r, int(cutoffs[i]))
                if best is None or worth > best[0]:
                    best = (worth, r, i)
    return best and best[1:]


def _fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz method)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            c = 1 + t / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            return out
    raise ArithmeticError("no convergence")


def at_most(k, n, p):
    """Probability of at most ``k`` hits in ``n`` draws of probability ``p``."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p  # regularised incomplete beta function of x
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log) * _fraction(a, b, x) / a
    return 1 - math.exp(log) * _fraction(b, a, 1 - x) / b


def upper_bound(k, n, level):
    """Exact (Clopper-Pearson) upper confidence bound of a share after ``k`` hits in ``n`` draws."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at_most(k, n, mid) > level else (lo, mid)
    return hi


def certified(steps, n, alpha, level):
    """How many moves of a path hold: ``steps[i]`` of ``n`` good texts are first rejected by move i."""
    lost = 0
    for i, more in enumerate(steps):
        lost += more
        if not n or at_most(lost, n, alpha) > level:
            return i
    return len(steps)


class Cutoffs:
    """Cutoffs of each stratum, with their certificates. ``other`` stands for all strata not named."""

    def __init__(self, names, cutoffs, certificates):
        self.names, self.cutoffs, self.certificates = names, cutoffs, certificates

    def frame(self, spark):
        """(stratum, rule, cutoff, good texts, rejected ones, upper bound): at most MAX_STRATA + 1 times the rules."""
        schema = "stratum string, pooled boolean, rule string, cutoff long, n_good long, n_rejected long, upper_bound double"
        return spark.createDataFrame(self.certificates, schema)

    def applied(self, rows):
        """``rows`` of ``measured`` with ``rejected_by``: the first rule above its cutoff, else null."""
        spark = rows.sparkSession
        table = spark.createDataFrame(
            [(name, *map(int, c)) for name, c in zip(self.names, self.cutoffs)],
            "__stratum string, " + ", ".join(f"__{r} long" for r in RULES),
        )
        out = rows.join(F.broadcast(table), F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
        out = out.withColumn("__named", F.col(f"__{next(iter(RULES))}").isNotNull())
        reason = F.lit(None).cast("string")
        for k, (name, value) in reversed(list(enumerate(RULES.items()))):
            cutoff = F.when(F.col("__named"), F.col(f"__{name}")).otherwise(F.lit(int(self.cutoffs[-1][k])))
            reason = F.when((cutoff < NEVER) & (F.expr(value) > cutoff), F.lit(name)).otherwise(reason)
        return out.withColumn("rejected_by", reason).select(*rows.columns, "rejected_by")


def fit(rows, labels, key="doc_id", label="quality", alpha=ALPHA, delta=DELTA, max_strata=MAX_STRATA):
    """Cutoffs for rows of ``measured``, a written table.

    The ``max_strata`` strata with the most labelled texts are set apart, all others together are one.
    """
    texts = materialise(labelled_texts(rows, labels, key, label), "labelled")
    sizes = texts.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.orderBy(F.desc("n"), F.col("stratum").asc_nulls_first()).limit(max_strata).collect()
    names = [r["stratum"] for r in sizes]
    number = {name: k for k, name in enumerate(names)}
    pooled = len(names)
    at = F.lit(pooled)
    for k, name in enumerate(names):
        at = F.when(F.col("stratum").eqNullSafe(F.lit(name).cast("string")), k).otherwise(at)
    grid = levels_below(texts.filter("fit"), at)
    none = np.zeros(0, np.int64)
    grids = [[grid.get((k, r), none) for r in range(len(RULES))] for k in range(pooled + 1)]
    deep = 1 + max((len(g) for mine in grids for g in mine), default=0)

    def to_levels(frames):
        for frame in frames:
            where = frame["at"].to_numpy(np.int64)
            out = {}
            for r, rule in enumerate(RULES):
                level = np.zeros(len(frame), np.int64)
                for k in np.unique(where):
                    mine = where == k
                    level[mine] = np.searchsorted(grids[k][r], frame[rule].to_numpy(np.int64)[mine], "left")
                out[rule] = level
            yield frame.assign(**out)

    # Kinds: good and bad texts that propose, good ones of the holdout. Texts that lie between the same cutoffs are one row.
    kind = F.when(F.col("fit"), 1 - F.col("good")).otherwise(2).cast("int")
    cells = texts.filter("fit or good = 1").select(at.cast("int").alias("at"), kind.alias("kind"), *RULES)
    cells = cells.mapInPandas(to_levels, cells.schema).groupBy("at", "kind", *RULES).agg(F.count(F.lit(1)).alias("n"))
    cells = materialise(cells, "cells")
    have = [[len(g) for g in mine] for mine in grids]

    def tally():
        """Texts that the moves so far have left: by stratum, kind, rule and level."""

        def run(frames):
            bounds = np.array(have)
            for frame in frames:
                where, of, n = (frame[c].to_numpy(np.int64) for c in ("at", "kind", "n"))
                level = frame[list(RULES)].to_numpy(np.int64).reshape(-1, len(RULES))
                left = np.flatnonzero((level <= bounds[where]).all(axis=1))
                shape = (pooled + 1, 3, len(RULES), deep)
                sums = np.zeros(shape, np.int64)
                for r in range(len(RULES)):
                    np.add.at(sums, (where[left], of[left], r, level[left, r]), n[left])
                place = np.flatnonzero(sums)
                yield pd.DataFrame({"place": place, "n": sums.ravel()[place]})

        out = np.zeros((pooled + 1) * 3 * len(RULES) * deep, np.int64)
        # At most a number per stratum, kind, rule and level.
        for r in cells.mapInPandas(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
            out[r["place"]] = r["n"]
        return out.reshape(pooled + 1, 3, len(RULES), deep)

    now = tally()
    total = now[:, :, 0].sum(axis=2)  # by stratum and kind

    def propose(k):
        return _move(now[k, 0], now[k, 1], total[k, 0], total[k, 1], have[k], grids[k]) if total[k, 0] and total[k, 1] else None

    first = [propose(k) for k in range(pooled + 1)]
    level = delta / max(1, sum(m is not None for m in first))
    held, lost, moves = [0] * (pooled + 1), [0] * (pooled + 1), first
    # One job a move, for all strata together. A path ends with the first move that fails the test.
    while any(moves):
        for k, move in enumerate(moves):
            if move:
                r, i = move
                more = int(_over(now[k, 2, r], i + 1)[i])
                if not total[k, 2] or at_most(lost[k] + more, int(total[k, 2]), alpha) > level:
                    moves[k] = None
                else:
                    lost[k], held[k], have[k][r] = lost[k] + more, held[k] + 1, i
        if any(moves):
            now = tally()
            moves = [move and propose(k) for k, move in enumerate(moves)]
    cutoffs, certificates = [], []
    for k in range(pooled + 1):
        mine = [int(g[i]) if i < len(g) else NEVER for g, i in zip(grids[k], have[k])]
        cutoffs.append(mine)
        n = int(total[k, 2])
        bound = float(upper_bound(lost[k], n, level)) if held[k] else None
        name = names[k] if k < pooled else None
        for r, rule in enumerate(RULES):
            certificates.append((name, k == pooled, rule, mine[r] if mine[r] < NEVER else None, n, lost[k], bound))
    return Cutoffs(names, cutoffs, certificates)


def documents_query(docs, labels):
    """op12: counts and verdict of every document.

    Nulls and empty texts have no words and fail the base rules. A null language is a stratum of its own.
    Rows that repeat a doc_id are judged each by its own text. ``rejected_by`` names what decided.
    """
    rows = materialise(measured(docs), "measured")
    out = fit(rows, labels).applied(rows)
    reason = F.when(base_failed(), F.lit("base")).otherwise(F.col("rejected_by"))
    return out.select(
        F.col("key").alias("doc_id"),
        *COUNTS[:5],
        base_failed().alias("base_failed"),
        reason.isNull().alias("kept"),
        reason.alias("rejected_by"),
    )
