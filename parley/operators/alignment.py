"""Tables around forced alignment: clip plans, characters, words and sentences.

Groups here are one line of text or one utterance, so plain windows inside them are safe.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.text import char_array, strip
from parley.operators.lookup import lookup_join
from parley.operators.scan import Run, dealt, running

NO_SPACES = ("ja", "zh")
CELL = 64


def clip_plan(utts, manifest, sample_rate, on="path"):
    """Sample range of each clip, clamped to the audio; an empty clip gets one sample."""
    lo = F.greatest(F.col("start_ms"), F.lit(0))
    hi = F.least(F.col("end_ms"), F.col("duration_ms"))
    out = lookup_join(utts, manifest.select(on, "duration_ms"), on).withColumns({"__lo": lo, "__hi": hi})

    def sample(ms):
        return F.bround(ms * sample_rate / 1000).cast("long")

    first, total = sample(F.col("__lo")), sample(F.col("duration_ms"))
    last = F.when(F.col("__hi") <= F.col("__lo"), F.least(first + 1, total)).otherwise(
        sample(F.col("__hi"))
    )
    return out.withColumns({"start_sample": first, "end_sample": last}).drop("__lo", "__hi")


def with_audio(segments, manifest, on="path"):
    """(segments whose audio exists, paths without audio)."""
    have = manifest.select(on).distinct()
    wanted = segments.select(on).distinct()
    return lookup_join(segments, have, on, "left_semi"), wanted.join(have, on, "left_anti")


def flag_alignable(segments, manifest, on="path"):
    """Why a segment cannot be aligned (``no_text``, ``past_end``), or ``ok``."""
    out = lookup_join(segments, manifest.select(on, "duration_ms"), on, "left")
    return out.withColumn(
        "alignable",
        F.when(strip("text") == "", "no_text")
        .when(F.col("start_ms") >= F.col("duration_ms"), "past_end")
        .otherwise("ok"),
    )


def frames_to_time(df, frame="frame", n_frames="n_frames"):
    """Milliseconds of a frame index, from the span of the segment."""
    ratio = (F.col("end_ms") - F.col("start_ms")) / (F.col(n_frames) - 1)
    return df.withColumn(
        "time_ms", F.bround(F.col(frame) * ratio + F.col("start_ms")).cast("long")
    )


def explode_chars(df, text="text", keep=()):
    """One row per character with ``char_idx``."""
    return df.select(*keep, F.posexplode(char_array(text)).alias("char_idx", "char"))


def word_index(chars, by, lang="en"):
    """Word number of each character (column ``word_idx``)."""
    if lang in NO_SPACES:
        return chars.withColumn("word_idx", F.col("char_idx").cast("long"))
    after = F.lead("char").over(W.partitionBy(*by).orderBy("char_idx"))
    ends = (after.isNull() | (after == " ")).cast("long")
    out = chars.withColumn("__ends", ends)
    runs = {"word_idx": Run("sum", F.col("__ends"), inclusive=False)}
    return running(out, by, ["char_idx"], runs, split=False).drop("__ends")


def _cell(at):
    return F.floor(at / CELL).cast("long")


def chars_in_sentences(chars, spans, by):
    """Sentence of each character; borders are shared and the later sentence keeps them.

    Sentences are cut at cells of ``CELL`` characters, and each character looks up its cell. A cell keeps one sentence,
    the latest, per range of it that is covered, so however many sentences overlap, few are left to look at.
    """
    by, at = list(by), F.col("char_idx")
    begin, end = F.least("span_start", "span_end"), F.greatest("span_start", "span_end")
    known = spans.where(F.col("span_start").isNotNull() & F.col("span_end").isNotNull())
    cells = F.sequence(_cell(begin), _cell(end))
    pieces = known.select(*by, "span_idx", begin.alias("__lo"), end.alias("__hi"), F.explode(cells).alias("__cell"))
    first = F.col("__cell") * CELL
    pieces = pieces.withColumns({"__lo": F.greatest("__lo", first), "__hi": F.least("__hi", first + CELL - 1)})
    latest = pieces.groupBy(*by, "__cell", "__lo", "__hi").agg(F.max("span_idx").alias("span_idx"))
    inside = latest.groupBy(*by, "__cell").agg(F.collect_list(F.struct("__lo", "__hi", "span_idx")).alias("__spans"))
    # The size of the cells is guessed before they are made: never a broadcast.
    out = chars.withColumn("__cell", _cell(at)).join(inside.hint("merge"), by + ["__cell"], "left")
    over = F.filter("__spans", lambda s: (s["__lo"] <= at) & (at <= s["__hi"]))
    best = F.array_max(F.transform(over, lambda s: s["span_idx"])).alias("span_idx")
    names = [c for c in chars.columns if c not in by and c != "char_idx"]
    return out.select(*by, "char_idx", *names, best)


def rollup_words(chars, by):
    """Words from timed characters: earliest start, latest end, mean score to 3 digits."""
    solid = F.col("char") != " "
    items = F.sort_array(F.collect_list(F.struct("char_idx", "char")))
    word = strip(F.array_join(F.transform(items, lambda i: i["char"]), ""))
    return (
        chars.groupBy(*by, "word_idx")
        .agg(
            word.alias("word"),
            F.min(F.when(solid, F.col("start_ms"))).alias("start_ms"),
            F.max(F.when(solid, F.col("end_ms"))).alias("end_ms"),
            F.round(F.avg(F.when(solid, F.col("score"))), 3).alias("score"),
        )
        .where(F.col("word") != "")
    )


def fill_times(df, by, cols=("start_ms", "end_ms"), order="idx"):
    """Fill gaps from the nearest known row (the earlier one on a tie), at the ends from the only
    side there is."""
    back = W.partitionBy(*by).orderBy(F.col(order).desc())
    ahead = W.partitionBy(*by).orderBy(order)
    out = df
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("v")))
        out = out.withColumn(f"__p_{c}", F.last(known, True).over(ahead))
        out = out.withColumn(f"__n_{c}", F.last(known, True).over(back))
    filled = {}
    for c in cols:
        p, n = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        use_next = (n["at"] - F.col(order)) < (F.col(order) - p["at"])
        filled[c] = F.when(p.isNull() | F.coalesce(use_next, F.lit(False)), n["v"]).otherwise(p["v"])
    return out.withColumns(filled).drop(*[f"__{k}_{c}" for c in cols for k in "pn"])


def merge_equal_spans(df, by, lang="ja", idx="idx"):
    """Sentences of one segment with the same span, joined in order; null spans stay a group."""
    gap = "" if lang in NO_SPACES else " "
    items = F.sort_array(F.collect_list(F.struct(idx, "text", "words")))
    return (
        df.groupBy(*by, "start_ms", "end_ms")
        .agg(items.alias("i"))
        .select(
            *by,
            "start_ms",
            "end_ms",
            F.array_join(F.col("i.text"), gap).alias("text"),
            F.flatten(F.col("i.words")).alias("words"),
        )
    )


def collapse_runs(frames, by, time="time_index", token="token_index", rows=None):
    """Segments of equal token on a frame path: first frame, last frame + 1, mean score.

    ``rows`` is the number of frames, for frames that are not dealt by ``by`` yet.
    """
    frames = dealt(frames, by, rows)
    before = F.lag(token).over(W.partitionBy(*by).orderBy(time))
    changed = (before.isNull() | (before != F.col(token))).cast("long")
    out = frames.withColumn("__changed", changed)
    out = running(out, by, [time], {"run_idx": Run("sum", F.col("__changed"))}, split=False)
    return out.groupBy(*by, "run_idx", token).agg(
        F.min(time).alias("start"),
        (F.max(time) + 1).alias("end"),
        F.avg("score").alias("score"),
    )


def merge_words(segments, by, separator="|", label="label", idx="run_idx"):
    """Words between separators: joined labels and the length-weighted mean score."""
    is_gap = F.col(label) == separator
    runs = {"word_idx": Run("sum", is_gap.cast("long"))}
    out = running(segments, by, [idx], runs, split=False).where(~is_gap)
    size = F.col("end") - F.col("start")
    items = F.sort_array(F.collect_list(F.struct(F.col(idx), F.col(label).alias("label"))))
    return out.groupBy(*by, "word_idx").agg(
        F.array_join(F.transform(items, lambda i: i["label"]), "").alias("word"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.sum(F.col("score") * size) / F.sum(size)).alias("score"),
    )


def best_rendition(paths, path="path"):
    """Best media file per folder: the audio file with the highest bit rate, without one the video
    with most pixels. Unreadable names rank lowest; the smaller path wins a tie."""
    p = F.col(path)
    name = F.regexp_extract(p, "[^/]*$", 0)
    number = lambda pattern, g: F.expr(
        f"try_cast(regexp_extract(__name, '{pattern}', {g}) as bigint)"
    )
    out = paths.select(
        F.regexp_extract(p, "^(.*)/[^/]*$", 1).alias("dir"), p.alias("path"), name.alias("__name")
    )
    is_audio = F.col("__name").rlike("^audio.*[.]mp4$")
    is_video = F.col("__name").rlike("^video.*[.]mp4$")
    size = "^video_([0-9]+)x([0-9]+)_.*[.]mp4$"
    quality = F.when(is_audio, number("_([0-9]+)[.]mp4$", 1)).otherwise(
        number(size, 1) * number(size, 2)
    )
    out = out.where(is_audio | is_video).withColumns(
        {"quality": F.coalesce(quality, F.lit(-1)), "media": F.when(is_audio, "audio").otherwise("video")}
    )
    # min picks: audio before video, highest quality, smallest path
    rank = F.min(F.struct("media", (-F.col("quality")).alias("q"), "path"))
    return (
        out.groupBy("dir")
        .agg(rank.alias("b"))
        .select("dir", "b.media", (-F.col("b.q")).alias("quality"), "b.path")
    )
