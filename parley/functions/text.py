"""Column functions over single texts, paths and token arrays. All of them are JVM expressions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley import model as M

EDGE_SPACE = r"(?U)^\s+|\s+$"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def bind(value, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def strip(c) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(_col(c), EDGE_SPACE, "")


def char_array(c) -> Column:
    return F.split(_col(c), "")


# --- paths and names ------------------------------------------------------------------------


def infer_speaker(path, mode="channel") -> Column:
    """Speaker from an audio path: channel suffix ``_a.wav``, or a pseudo-label folder."""
    path = _col(path)
    if mode == "channel":
        return F.when(path.contains("_a.wav"), "A").otherwise("B")
    if mode == "pseudo":
        return F.when(path.contains("A_gd"), "A").when(path.contains("B_gd"), "B").otherwise("UNK")
    raise ValueError(f"unknown mode {mode!r}")


def relativize_path(path, marker) -> Column:
    """The path from the first occurrence of ``marker`` on; unchanged without one."""
    path = _col(path)
    at = F.instr(path, marker)
    return F.when(at > 0, F.substring(path, at, F.length(path))).otherwise(path)


def drop_name_parts(name, k) -> Column:
    """Drop the first k parts of an underscore-separated name."""
    parts = F.split(_col(name), "_")
    return F.array_join(F.slice(parts, k + 1, F.greatest(F.size(parts) - k, F.lit(0))), "_")


def stem_with_suffix(path, suffix) -> Column:
    """Same folder and stem, another suffix."""
    return F.regexp_replace(_col(path), r"\.[^./]*$", suffix)


# --- cleaning -------------------------------------------------------------------------------


def clean_generated(c) -> Column:
    c = _col(c)
    for mark in M.GENERATION_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(""))
    return strip(c)


def clean_text(c) -> Column:
    """Transcript text without noise marks; null where nothing is left to keep."""
    c = _col(c)
    kept = c
    for mark in M.NOISE_MARKS:
        kept = F.replace(kept, F.lit(mark), F.lit(""))
    kept = strip(F.replace(kept, F.lit("。"), F.lit(" ")))
    return F.when(strip(c).isin(M.NOISE_MARKS) | (kept == ""), None).otherwise(kept)


def strip_final_punct(tokens) -> Column:
    """Token array without its last token if that is punctuation (one token at most)."""
    tokens = _col(tokens)
    last = F.try_element_at(tokens, F.lit(-1))
    cut = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.when(last.isin(M.FINAL_PUNCTUATION), cut).otherwise(tokens)


def truncate_text(c, n) -> Column:
    c = _col(c)
    if n <= 0:
        return c
    note = F.concat(
        F.substring(c, 1, n),
        F.lit("... <truncated "),
        (F.length(c) - n).cast("string"),
        F.lit(" chars>"),
    )
    return F.when(F.length(c) > n, note).otherwise(c)


def mask_oov(c, vocab, lang="ja") -> Column:
    """Lower-cased, trimmed text with every character outside ``vocab`` shown as ``*``.

    Outside ja/zh a space stands for the word separator ``|`` before the lookup.
    """
    text = F.lower(strip(c))
    if lang not in ("ja", "zh"):
        text = F.replace(text, F.lit(" "), F.lit("|"))
    single = sorted({v for v in vocab if len(v) == 1})
    if not single:
        return F.regexp_replace(text, r"(?s).", "*")
    return F.regexp_replace(text, "[^" + "".join("\\" + v if not v.isalnum() else v for v in single) + "]", "*")


# --- tagged text ----------------------------------------------------------------------------


def open_tag(speaker) -> Column:
    return F.concat(F.lit("<speaker_"), _col(speaker), F.lit(">"))


def close_tag(speaker) -> Column:
    return F.concat(F.lit("</speaker_"), _col(speaker), F.lit(">"))


def tag_utterance(speaker, text, flags=None) -> Column:
    """``<speaker_X>text</speaker_X>`` plus event tokens; null for blank text.

    ``flags`` maps kind -> boolean column; tokens follow in the order ts, bc, pause, silence, te.
    """
    body = strip(text)
    parts = [open_tag(speaker), body, close_tag(speaker)]
    for kind in ("ts", "bc", "pause", "silence", "te"):
        if flags and kind in flags:
            shown = F.coalesce(_col(flags[kind]), F.lit(False))
            parts.append(F.when(shown, M.KIND_TOKEN[kind]).otherwise(""))
    return F.when(body != "", F.concat(*parts))


def split_placeholders(c, placeholders=None) -> Column:
    """Ordered pieces of a text as structs (piece, id); the id is null for plain text."""
    ids = placeholders or M.PLACEHOLDER_IDS
    alt = "|".join(re.escape(p) for p in ids)
    pieces = F.filter(F.split(_col(c), f"(?<={alt})|(?={alt})"), lambda p: p != "")

    def as_struct(p):
        number = F.lit(None).cast("int")
        for mark, value in ids.items():
            number = F.when(p == mark, F.lit(value)).otherwise(number)
        return F.struct(p.alias("piece"), number.alias("id"))

    return F.transform(pieces, as_struct)


# --- backchannel text rules -----------------------------------------------------------------


def is_short_response(text, duration_ms, max_duration=1000, max_chars=8, lexicon=None) -> Column:
    """Looks like a listener response by lexicon, or by being short in time and text."""
    text, duration = F.lower(strip(text)), _col(duration_ms)
    size = F.length(text)
    return (size > 0) & (
        (text.isin(lexicon or M.BC_LEXICON) & (duration <= max_duration))
        | ((duration <= 800) & (size <= 4))
        | ((duration <= max_duration) & (size <= max_chars))
    )


def lexicon_tokens(text, lexicon=None) -> Column:
    """Words of a listener response; a repeated cue inside a longer word counts once per copy."""
    words = F.filter(
        F.split(F.regexp_replace(_col(text), "[。、！？…]", " "), r"(?U)\s+"), lambda w: w != ""
    )

    def expand(w):
        out = F.array(w)
        for cue in reversed(M.REPEATABLE):
            times = F.size(F.split(w, cue)) - 1
            out = F.when(times > 0, F.array_repeat(F.lit(cue), times)).otherwise(out)
        return F.when(w.isin(lexicon or M.BC_LEXICON), F.array(w)).otherwise(out)

    return F.flatten(F.transform(words, expand))


def low_density_tokens(tokens, lexicon=None) -> Column:
    """Mostly cue words, few different ones, many repeated. False without tokens."""

    def judge(ordered):
        total = F.size(ordered)
        share = F.greatest(total, F.lit(1))
        cues = F.size(F.filter(ordered, lambda t: t.isin(lexicon or M.BC_LEXICON)))
        unique = F.size(F.array_distinct(ordered))

        def alone(t, i):
            before, after = F.get(ordered, i - 1), F.get(ordered, i + 1)
            return F.coalesce(before != t, F.lit(True)) & F.coalesce(after != t, F.lit(True))

        single = F.size(F.filter(ordered, alone))
        return (
            (total > 0)
            & (cues / share >= 0.6)
            & (unique / share <= 0.6)
            & ((total - single) / share >= 0.3)
        )

    return bind(F.array_sort(_col(tokens)), judge)


def low_information_density(text, lexicon=None) -> Column:
    return low_density_tokens(lexicon_tokens(text, lexicon), lexicon)


def is_candidate(text, duration_ms) -> Column:
    """Worth asking a classifier about."""
    body = strip(text)
    return (body != "") & (is_short_response(text, duration_ms) | low_information_density(body))


def is_brief_segment(text, duration_ms, threshold_ms=500) -> Column:
    return (_col(duration_ms) < threshold_ms) & (F.length(F.lower(_col(text))) < 5)


def parse_label(response) -> Column:
    """Label named by a classifier's answer; the default for an empty or unclear one."""
    text = F.lower(strip(response))
    line = F.regexp_replace(strip(F.regexp_extract(text, r"^[^\r\n]*", 0)), "[.:]", "")
    found = F.lit(M.DEFAULT_LABEL)
    for label in reversed(M.LABEL_SEARCH_ORDER):
        found = F.when(text.rlike(rf"(?U)\b{label}\b"), label).otherwise(found)
    return F.when(line.isin(M.LABELS), line).otherwise(F.coalesce(found, F.lit(M.DEFAULT_LABEL)))


def classification_prompt(text, system_text) -> Column:
    """Chat messages for a classifier: a system text and the utterance."""
    return F.struct(
        F.lit(system_text).alias("system"),
        F.concat(F.lit("Utterance: "), _col(text)).alias("user"),
    )


# --- dialogue text rules --------------------------------------------------------------------


def is_complete(text) -> Column:
    """Semantic completion of an utterance judged by its last words."""
    body = strip(text)
    ends = lambda words: body.rlike("(" + "|".join(words) + r")\z")
    short = (F.length(body) <= M.SHORT_REPLY_CHARS) & body.isin(M.SHORT_REPLIES)
    return F.when((body == "") | ends(M.NONFINAL_SUFFIXES), False).otherwise(
        ends(M.FINAL_SUFFIXES) | short
    )


# --- training labels ------------------------------------------------------------------------


def assistant_loss_mask(ids, im_start, assistant, im_end) -> Column:
    """Token ids inside assistant turns, -100 elsewhere.

    A turn runs from a start mark to the end mark of the same rank; its text begins three
    positions after the start mark and includes the end mark.
    """
    ids = _col(ids)
    where = lambda mark: F.filter(
        F.transform(ids, lambda x, i: F.when(x == mark, i)), lambda i: i.isNotNull()
    )
    starts, ends = where(im_start), where(im_end)
    both = F.least(F.size(starts), F.size(ends))
    spans = F.filter(
        F.arrays_zip(F.slice(starts, 1, both).alias("s"), F.slice(ends, 1, both).alias("e")),
        lambda p: F.get(ids, p["s"] + 1) == assistant,
    )

    def labels(turns):
        inside = lambda i: F.exists(
            turns, lambda p: (i >= p["s"] + 3) & (i <= p["e"])
        )
        return F.transform(ids, lambda x, i: F.when(inside(i), x).otherwise(M.IGNORE_INDEX))

    return bind(spans, labels)
