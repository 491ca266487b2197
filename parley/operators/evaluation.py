"""Scoring predictions against references, and the summaries of the scores."""

from pyspark.sql import functions as F

from parley import model as M
from parley.functions import repeats as R
from parley.functions import tagged as G
from parley.functions.distance import edit_distance
from parley.functions.text import truncate_text

SCOPES = {"overall": [], "file": ["file"], "rank": ["rank"]}


def prepare(results, cleanup=True, **options):
    """Predictions with repeats removed, the raw ones kept beside them."""
    out = results.withColumn("pred_raw", F.col("pred"))
    if cleanup:
        out = R.clean_prediction(out, "pred", **options)
    return out.withColumns(
        {
            "cleanup_changed": F.col("pred") != F.col("pred_raw"),
            "chars_before": F.length("pred_raw"),
            "chars_after": F.length("pred"),
        }
    )


def score_cer(df):
    """Edit distance per speaker and over both. Columns edits_X, ref_chars_X, cer_X, cer."""
    texts = {f"__{side}_{s}": G.speaker_text(side, s) for side in ("pred", "ref") for s in M.SPEAKERS}
    out = df.withColumns(texts)
    out = out.withColumns(
        {
            **{
                f"edits_{s}": edit_distance(f"__pred_{s}", f"__ref_{s}")
                for s in M.SPEAKERS
            },
            **{f"ref_chars_{s}": F.length(f"__ref_{s}") for s in M.SPEAKERS},
        }
    ).drop(*texts)
    out = out.withColumns(
        {f"cer_{s}": G.cer(F.col(f"edits_{s}"), F.col(f"ref_chars_{s}")) for s in M.SPEAKERS}
    )
    both = lambda n: sum((F.col(f"{n}_{s}") for s in M.SPEAKERS[1:]), F.col(f"{n}_A"))
    return out.withColumns({"edits": both("edits"), "ref_chars": both("ref_chars")}).withColumn(
        "cer", G.cer(F.col("edits"), F.col("ref_chars"))
    )


def score_special(df):
    """Event-token sequence scores with matches by longest common subsequence."""
    out = df.withColumns({f"{side}_tokens": G.special_tokens(side) for side in ("pred", "ref")})
    out = out.withColumn("tp", G.lcs_length("pred_tokens", "ref_tokens"))
    n_pred, n_ref = F.size("pred_tokens"), F.size("ref_tokens")
    p, r, f1 = G.prf(F.col("tp"), n_pred, n_ref)
    return out.withColumns(
        {"fp": n_pred - F.col("tp"), "fn": n_ref - F.col("tp"), "precision": p, "recall": r, "f1": f1}
    )


def score(df):
    return score_special(score_cer(df))


def _token_columns():
    cols = {}
    for token in M.SPECIAL_TOKENS:
        kind = token.strip("<>")
        pred, ref = G.token_count("pred_tokens", token), G.token_count("ref_tokens", token)
        cols[f"pred_{kind}"], cols[f"ref_{kind}"] = pred, ref
        cols[f"match_{kind}"] = F.least(pred, ref)
    return cols


def _presum(scored, sums):
    """Sums per (file, rank, sample): few rows are left for the grouping sets to repeat."""
    rank = F.coalesce(F.col("rank").cast("string"), F.lit("unknown"))
    return (
        scored.withColumn("rank", rank)
        .groupBy("file", "rank", "sample_id")
        .agg(
            F.count(F.lit(1)).alias("turns"),
            *[F.sum(c).alias(n) for n, c in sums.items()],
        )
    )


def _totals(scored, sums):
    """One row per scope and key with all sums, the number of turns and of distinct samples."""
    pre = _presum(scored, sums)
    sets = [[F.col(c) for c in cols] for cols in SCOPES.values()]
    out = pre.groupingSets(sets, F.col("file"), F.col("rank")).agg(
        F.grouping_id().alias("__g"),
        F.sum("turns").alias("turns"),
        F.count_distinct("sample_id").alias("samples"),
        *[F.sum(n).alias(n) for n in sums],
    )
    scope = F.when(F.col("__g") == 3, "overall").when(F.col("__g") == 1, "file").otherwise("rank")
    return out.select(
        scope.alias("scope"),
        F.coalesce(F.col("file").cast("string"), F.col("rank"), F.lit("all")).alias("key"),
        "turns",
        "samples",
        *sums,
    )


def cer_summary(scored):
    """Micro and macro error rates overall, by file and by rank."""
    sums = {}
    for s in M.SPEAKERS:
        for n in (f"edits_{s}", f"ref_chars_{s}", f"cer_{s}"):
            sums[n] = F.col(n)
    out = _totals(scored, sums)
    turns = F.greatest(F.col("turns"), F.lit(1))
    edits, chars = F.col("edits_A") + F.col("edits_B"), F.col("ref_chars_A") + F.col("ref_chars_B")
    return out.select(
        "scope",
        "key",
        "turns",
        "samples",
        *[c for s in M.SPEAKERS for c in (f"edits_{s}", f"ref_chars_{s}")],
        *[
            c
            for s in M.SPEAKERS
            for c in (
                G.cer(F.col(f"edits_{s}"), F.col(f"ref_chars_{s}")).alias(f"micro_cer_{s}"),
                (F.col(f"cer_{s}") / turns).alias(f"macro_cer_{s}"),
            )
        ],
        edits.alias("edits"),
        chars.alias("ref_chars"),
        G.cer(edits, chars).alias("micro_cer"),
    )


def f1_summary(scored):
    sums = {n: F.col(n) for n in ("tp", "fp", "fn")}
    sums |= {f"sum_{n}": F.col(n) for n in ("precision", "recall", "f1")}
    out = _totals(scored, sums)
    p, r, f1 = G.prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))
    turns = F.greatest(F.col("turns"), F.lit(1))
    return out.select(
        "scope",
        "key",
        "turns",
        "tp",
        "fp",
        "fn",
        p.alias("precision"),
        r.alias("recall"),
        f1.alias("f1"),
        *[(F.col(f"sum_{n}") / turns).alias(f"macro_{n}") for n in ("precision", "recall", "f1")],
    )


def token_counts(scored):
    """Counts per event token with per-record multiset matches; absent tokens show as zero."""
    out = _totals(scored, _token_columns())
    kinds = [t.strip("<>") for t in M.SPECIAL_TOKENS]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"<{k}>").alias("token"),
                    F.col(f"pred_{k}").alias("pred"),
                    F.col(f"ref_{k}").alias("ref"),
                    F.col(f"match_{k}").alias("matched"),
                )
                for k in kinds
            ]
        )
    )
    out = out.select("scope", "key", rows.alias("r")).select("scope", "key", "r.*")
    p, r, f1 = G.prf(F.col("matched"), F.col("pred"), F.col("ref"))
    return out.withColumns({"precision": p, "recall": r, "f1": f1})


def cleanup_stats(prepared):
    sums = {
        "changed_turns": F.col("cleanup_changed").cast("long"),
        "chars_before": F.col("chars_before"),
        "chars_after": F.col("chars_after"),
    }
    out = _totals(prepared, sums)
    return out.withColumn("chars_removed", F.col("chars_before") - F.col("chars_after"))


def worst_examples(scored, k=10, max_chars=0):
    """The k worst turns by error rate, then by missing event tokens."""
    texts = {c: truncate_text(c, max_chars) for c in ("pred", "ref")} if max_chars else {}
    return (
        scored.orderBy(
            F.desc("cer"), F.desc(1 - F.col("f1")), "sample_id", "turn_id", "rank", "file"
        )
        .limit(k)
        .withColumns(texts)
    )


def summary_document(scored, k=10):
    """All summaries as JSON texts, one row per (section, scope, key)."""
    parts = {
        "speaker_cer": cer_summary(scored),
        "special_token_f1": f1_summary(scored),
        "special_token_counts": token_counts(scored),
    }
    if "cleanup_changed" in scored.columns:
        parts["repeat_cleanup"] = cleanup_stats(scored)
    parts["files"] = scored.groupBy(F.lit("file").alias("scope"), F.col("file").alias("key")).agg(
        F.count(F.lit(1)).alias("turns")
    )
    out = None
    for name, part in parts.items():
        body = F.to_json(F.struct(*[c for c in part.columns if c not in ("scope", "key")]))
        rows = part.select(F.lit(name).alias("section"), "scope", "key", body.alias("body"))
        out = rows if out is None else out.unionByName(rows)
    if k > 0:
        worst = worst_examples(scored, k)
        cols = ["sample_id", "turn_id", "rank", "file", "cer", "f1", "pred", "ref"]
        cols += [c for c in ("pred_raw", "cleanup_changed") if c in scored.columns]
        rows = worst.select(
            F.lit("worst_examples").alias("section"),
            F.lit("overall").alias("scope"),
            F.lit("all").alias("key"),
            F.to_json(F.struct(*cols)).alias("body"),
        )
        out = out.unionByName(rows)
    return out


# --- rounds -----------------------------------------------------------------------------------


def joined_rounds(rounds, by=("sample_idx",), idx="chunk_idx"):
    """Reference and prediction of a sample: its rounds' texts in order."""
    items = F.sort_array(F.collect_list(F.struct(idx, "ref", "pred")))
    return (
        rounds.groupBy(*by)
        .agg(items.alias("r"))
        .select(
            *by,
            F.array_join(F.col("r.ref"), "").alias("ref"),
            F.array_join(F.col("r.pred"), "").alias("pred"),
        )
    )


def round_cer(rounds, by=("sample_idx",), idx="chunk_idx"):
    """Mean error rate of the rounds that have a reference, and that of the joined sample."""
    per_round = F.when(
        F.col("ref") != "", G.cer(edit_distance("ref", "pred"), F.length("ref"))
    )
    means = rounds.groupBy(*by).agg(
        F.avg(per_round).alias("mean_round_cer"), F.count(per_round).alias("scored_rounds")
    )
    whole = joined_rounds(rounds, by, idx).select(
        *by, G.cer(edit_distance("ref", "pred"), F.length("ref")).alias("sample_cer")
    )
    return means.join(whole, list(by))


def score_rounds(rounds, by=("sample_idx",), idx="chunk_idx"):
    """(rounds with scores, samples with scores on the joined texts)."""
    return score(rounds), score(joined_rounds(rounds, by, idx))


def explode_rounds(results):
    """Rows per round of nested streaming results."""
    return results.select("sample_idx", "rank", F.explode("rounds").alias("r")).select(
        "sample_idx", "rank", "r.*"
    )
