import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from parley.llm import quality as Q
from tests.llm.conftest import edge_rows

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places, seen = {}, set()
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(8)}
    twice = 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(inside)


def odd_texts():
    rng = random.Random(3)
    some = [rng.choice("ab") for _ in range(4000)]
    run = " ".join(f"w{k}" for k in range(9))
    return [
        run + " " + run,
        " ".join(["x"] * 16),
        " ".join(["x"] * 8),
        " ".join(["x"] * 9),
        " ".join(some[:30]),
        " ".join(some),
        "é ü 日本 | a\0b\0 #<>\n \n \né ü\n|\n|\n | \n",
        "\x1c\x1d \x85   x",
        "a\r\nb\r\na\r\n\na",
    ]


def test_counts():
    for text in odd_texts() + [r[1] for r in edge_rows()]:
        assert Q.counts((text or "").encode())[:5] == plain_counts(text), repr(text)[:80]


def corpus(n=3000, seed=1):
    """Every fifth text is bad: symbols, or the same words again and again. Good ones hold a symbol at times."""
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(rng.randrange(25, 80))]
        bad = k % 5 == 0
        if bad and k % 2:
            words = [w + rng.choice(["%%%", "$$$"]) for w in words]
        elif bad:
            words = [rng.choice(words[:4]) for _ in words]
        elif rng.random() < 0.1:
            words[3] += "%"
        docs.append((k, " ".join(words), ["en", "de", None][k % 3]))
        labels.append((k, int(not bad), 0))
    return docs, labels


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_bad_texts_go_and_good_ones_stay(spark):
    docs, labels = corpus()
    got = {r["doc_id"]: r for r in Q.documents_query(*tables(spark, docs, labels[:2400])).collect()}
    assert len(got) == len(docs)
    for key, text, _ in docs:
        r = got[key]
        want = plain_counts(text)
        assert tuple(r[1:6]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    unseen = range(2400, 3000)
    assert np.mean([got[k]["kept"] for k in unseen if k % 5]) > 0.97
    assert np.mean([got[k]["kept"] for k in unseen if k % 5 == 0]) < 0.05


def test_cutoffs_against_brute_force(spark):
    """Verdicts follow from the certified cutoffs, and those hold on the holdout by an exact test."""
    docs, labels = corpus(1500, 4)
    documents, known = tables(spark, docs, labels)
    rows = Q.materialise(Q.measured(documents), "rows")
    cutoffs = Q.fit(rows, known)
    table = cutoffs.frame(spark).collect()
    texts = Q.labelled_texts(rows, known, "doc_id", "quality").collect()
    level = Q.DELTA / 3
    for name in ("en", "de", None):
        rules = {r["rule"]: r["cutoff"] for r in table if r["stratum"] == name and not r["pooled"]}
        holdout = [t for t in texts if t["stratum"] == name and not t["fit"] and t["good"]]
        lost = sum(any(c is not None and t[r] > c for r, c in rules.items()) for t in holdout)
        one = next(r for r in table if r["stratum"] == name and not r["pooled"])
        assert (one["n_good"], one["n_rejected"]) == (len(holdout), lost)
        a = Fraction(Q.ALPHA).limit_denominator(1000)
        tail = sum(math.comb(len(holdout), i) * a**i * (1 - a) ** (len(holdout) - i) for i in range(lost + 1))
        assert any(c is not None for c in rules.values()) == (tail <= level)
    strata = {name: k for k, name in enumerate(cutoffs.names)}
    for r in cutoffs.applied(rows).collect():
        values = dict(zip(Q.COUNTS, [r[c] for c in Q.COUNTS]))
        n, chars = max(values["n_words"], 1), max(values["word_chars"], 1)
        have = [
            1000 * values["n_symbols"] // n,
            1000 * values["n_dup_lines"] // max(values["n_lines"], 1),
            1000 * values["n_repeat_words"] // n,
            1000 * (values["n_words"] - values["n_distinct"]) // n,
            1000 * values["n_capitals"] // chars,
            1000 * values["word_chars"] // n,
            -(1000 * values["word_chars"] // n),
        ]
        mine = cutoffs.cutoffs[strata[r["stratum"]]]
        over = [rule for rule, v, c in zip(Q.RULES, have, mine) if c < Q.NEVER and v > c]
        assert r["rejected_by"] == (over[0] if over else None)


def test_too_few_labels_reject_nothing(spark):
    docs, labels = corpus(300)
    for known in ([], labels[:60], [(k, 1, 0) for k, _, _ in labels], [(k, 0, 0) for k, _, _ in labels]):
        got = Q.documents_query(*tables(spark, docs, known)).collect()
        assert all(r["kept"] != r["base_failed"] for r in got)


def test_small_strata_are_pooled(spark):
    docs, labels = corpus(2000)
    docs = [(k, t, "big" if k < 500 else f"l{k}") for k, t, _ in docs]
    documents, known = tables(spark, docs, labels)
    rows = Q.materialise(Q.measured(documents), "rows")
    cutoffs = Q.fit(rows, known, max_strata=1)
    assert cutoffs.names == ["big"]
    gone = {r["key"] for r in cutoffs.applied(rows).filter("rejected_by is not null").collect()}
    bad = [k for k in range(500, 2000) if k % 10 == 5]
    assert len(gone.intersection(bad)) > 0.9 * len(bad) and len([k for k in gone if k % 5]) < 0.05 * 2000


def test_copies_count_once(spark):
    """A thousand copies of one good text with symbols do not carry the test."""
    docs, labels = corpus(1500, 2)
    odd = docs[1][1] + " %%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%"
    copies = [(10_000 + k, odd, "en") for k in range(1000)]
    rows = Q.measured(tables(spark, docs + copies, labels)[0])
    texts = Q.labelled_texts(rows, tables(spark, [], labels + [(k, 1, 0) for k, _, _ in copies])[1], "doc_id", "quality")
    assert texts.count() == len({(t, lang) for k, t, lang in docs + copies[:1] if not failed(t)})


def failed(text):
    n, *_, repeat = plain_counts(text)
    return n < 20 or 100 * repeat > 30 * n


def test_odd_rows(spark, edge_docs, clashing, no_docs):
    known = spark.createDataFrame([(1, 1, 0), (3, None, 1), (None, 0, 0), (6, 7, 0), (13, 0, 0), (13, 1, 1)], LABELS)
    got = Q.documents_query(edge_docs, known).collect()
    want = sorted((r[0] is not None, r[0] or 0, *plain_counts(r[1])) for r in edge_rows())
    assert sorted((r[0] is not None, r[0] or 0, *r[1:6]) for r in got) == want
    assert sorted(map(str, Q.documents_query(clashing, known).collect())) == sorted(map(str, got))
    assert Q.documents_query(no_docs, known).count() == 0


@pytest.mark.parametrize("n, p", [(1, 0.02), (30, 0.02), (217, 0.02), (500, 0.3), (40, 0.97)])
def test_exact_binomial(n, p):
    share = Fraction(p).limit_denominator(1000)
    total = Fraction(0)
    for k in range(n):
        total += math.comb(n, k) * share**k * (1 - share) ** (n - k)
        assert abs(Q.at_most(k, n, p) - float(total)) < 1e-10
        if k < 5:
            bound = Q.upper_bound(k, n, 0.01)
            assert bound == 1 or abs(Q.at_most(k, n, bound) - 0.01) < 1e-9
    assert Q.at_most(n, n, p) == 1


def test_false_rejection_is_held():
    """Over many random holdouts the true rate passes alpha more rarely than the level says."""
    rng = np.random.default_rng(0)
    rates = np.array([0.002, 0.006, 0.008, 0.02, 0.02, 0.05])  # of the moves of a path
    wrong = 0
    for _ in range(2000):
        steps = rng.multinomial(1500, [*rates, 1 - rates.sum()])[:-1]
        held = Q.certified(list(steps), 1500, 0.02, 0.05)
        wrong += rates[:held].sum() > 0.02
    assert wrong / 2000 < 0.06


def plain_path(good, bad, levels=Q.LEVELS):
    """Moves (rule, cutoff), each making the rule set stricter, from rows of values of good and bad texts.

    Candidates are quantiles of the good texts' values, from the largest down to the 90th percentile. A
    move is taken as long as it rejects a larger share of the bad texts than of the good ones.
    """
    if not len(good) or not len(bad):
        return []
    shares = np.linspace(0, 1, levels) ** 2 * 0.1
    grid = [np.unique(np.quantile(good[:, r], 1 - shares, method="higher"))[::-1] for r in range(good.shape[1])]
    have = [Q.NEVER] * good.shape[1]
    good, bad, n_good, n_bad = good.copy(), bad.copy(), len(good), len(bad)
    moves = []
    while True:
        best = None
        for r, cutoffs in enumerate(grid):
            g, b = np.sort(good[:, r]), np.sort(bad[:, r])
            for cutoff in cutoffs:
                if cutoff >= have[r]:
                    continue
                lost = (len(g) - np.searchsorted(g, cutoff, "right")) / n_good
                caught = (len(b) - np.searchsorted(b, cutoff, "right")) / n_bad
                if caught > lost:
                    worth = (caught / (lost + 0.5 / n_good), -r, cutoff)
                    if best is None or worth > best[0]:
                        best = (worth, r, int(cutoff))
        if best is None:
            return moves
        _, r, cutoff = best
        have[r] = cutoff
        moves.append((r, cutoff))
        good, bad = good[good[:, r] <= cutoff], bad[bad[:, r] <= cutoff]


def test_all_labelled_texts_count(spark):
    """Cutoffs are those of a plain search over every proposing text."""
    docs, labels = corpus(3000, 1)
    documents, known = tables(spark, docs, labels)
    rows = Q.materialise(Q.measured(documents), "rows")
    assert "max_fit" not in Q.fit.__code__.co_varnames
    cutoffs = Q.fit(rows, known)
    texts = Q.labelled_texts(rows, known, "doc_id", "quality").collect()
    paths = {}
    for name in cutoffs.names:
        mine = [t for t in texts if t["stratum"] == name]
        value = lambda some: np.array([[t[r] for r in Q.RULES] for t in some], np.int64).reshape(-1, len(Q.RULES))
        paths[name] = (*[value([t for t in mine if t["fit"] and t["good"] == g]) for g in (1, 0)], value([t for t in mine if not t["fit"] and t["good"]]))
    moves = {name: plain_path(good, bad) for name, (good, bad, _) in paths.items()}
    level = Q.DELTA / sum(bool(m) for m in moves.values())
    for name, have in zip(cutoffs.names, cutoffs.cutoffs):
        left, steps = paths[name][2], []
        for r, cutoff in moves[name]:
            steps.append(int((left[:, r] > cutoff).sum()))
            left = left[left[:, r] <= cutoff]
        want = [Q.NEVER] * len(Q.RULES)
        for r, cutoff in moves[name][: Q.certified(steps, len(paths[name][2]), Q.ALPHA, level)]:
            want[r] = cutoff
        assert have == want
    assert any(c < Q.NEVER for have in cutoffs.cutoffs for c in have)
