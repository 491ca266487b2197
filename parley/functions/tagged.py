"""Tagged transcripts: parsing, speaker text, edit distance and sequence overlap.

A tagged transcript mixes text with speaker tags and event tokens, as in
``<speaker_A>hello</speaker_A><ts><speaker_B>hi</speaker_B>``.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley import model as M
from parley.functions.text import _col, bind, strip

SPEAKER_TAG = "</?speaker_[AB]>"
SPECIAL = "<(?:ts|te|bc|silence|pause)>"
WORD_BITS = 62


def tagged_parts(c) -> Column:
    """The text cut before and after every tag, nothing dropped, no empty pieces."""
    known = f"{SPEAKER_TAG}|{SPECIAL}"
    return F.filter(F.split(_col(c), f"(?<={known})|(?={known})"), lambda p: p != "")


def special_tokens(c) -> Column:
    """Event tokens in order."""
    return F.regexp_extract_all(_col(c), F.lit(f"({SPECIAL})"), F.lit(1))


def _speaker_runs(c):
    """Pieces that each start at a speaker tag (but for an untagged head)."""
    return F.split(_col(c), f"(?={SPEAKER_TAG})")


def speaker_text(c, speaker) -> Column:
    """All text of one speaker: pieces between tags, trimmed and joined. Untagged text is not
    counted."""
    tag = f"<speaker_{speaker}>"
    own = F.filter(_speaker_runs(c), lambda p: p.startswith(tag))
    body = F.transform(
        own,
        lambda p: strip(
            F.regexp_replace(F.substr(p, F.lit(len(tag) + 1)), rf"(?U)\s*{SPECIAL}\s*", "")
        ),
    )
    return F.array_join(body, "")


def parse_events(c) -> Column:
    """Array of structs (kind, speaker, value): text pieces and event tokens in order."""

    def run_events(run):
        tag = F.regexp_extract(run, f"^{SPEAKER_TAG}", 0)
        speaker = F.when(tag.rlike("^<s"), F.regexp_extract(tag, "speaker_[AB]", 0))
        body = F.substr(run, F.length(tag) + 1)
        pieces = F.split(body, f"(?<={SPECIAL})|(?={SPECIAL})")
        return F.filter(
            F.transform(
                pieces,
                lambda p: F.when(
                    p.rlike(f"^{SPECIAL}$"),
                    F.struct(
                        F.lit("special").alias("kind"),
                        F.lit(None).cast("string").alias("speaker"),
                        p.alias("value"),
                    ),
                ).otherwise(
                    F.struct(
                        F.lit("text").alias("kind"), speaker.alias("speaker"), strip(p).alias("value")
                    )
                ),
            ),
            lambda e: e["value"] != "",
        )

    return F.flatten(F.transform(_speaker_runs(c), run_events))


def cer(edits, ref_chars) -> Column:
    return edits / F.greatest(ref_chars, F.lit(1))


def lcs_length(a, b) -> Column:
    """Length of the longest common subsequence of two token arrays.

    Bit-parallel: the columns of the match table are kept as bits of 62-bit words, one pass over
    ``a`` updates them, so the work per token is size(b) / 62 and no table is built.
    """
    pair = F.struct(_col(a).alias("a"), _col(b).alias("b"))
    return bind(pair, lambda p: _lcs(p["a"], p["b"]))


def _lcs(a, b):
    full = F.lit((1 << WORD_BITS) - 1).cast("long")
    zero = F.lit(0).cast("long")
    words = F.ceil(F.size(b) / WORD_BITS).cast("int")
    numbers = F.when(words > 0, F.sequence(F.lit(0), words - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def match_words(token):
        return F.transform(
            numbers,
            lambda k: F.aggregate(
                F.transform(
                    F.slice(b, k * WORD_BITS + 1, WORD_BITS),
                    lambda t, i: F.when(
                        t == token, F.call_function("shiftleft", F.lit(1).cast("long"), i)
                    ).otherwise(zero),
                ),
                zero,
                lambda acc, bit: acc.bitwiseOR(bit),
            ),
        )

    masks = F.map_from_entries(
        F.transform(F.array_distinct(b), lambda t: F.struct(t, match_words(t)))
    )
    start = F.transform(numbers, lambda k: full)

    def step(state, masks_, token):
        match = F.try_element_at(masks_, token)

        def word(acc, k):
            v = F.get(state, k)
            m = F.get(match, k)
            total = v + v.bitwiseAND(m) + acc["carry"]
            kept = v.bitwiseAND(full.bitwiseXOR(m))
            return F.struct(
                F.concat(acc["out"], F.array(total.bitwiseAND(full).bitwiseOR(kept))).alias("out"),
                F.shiftright(total, WORD_BITS).alias("carry"),
            )

        empty = F.struct(
            F.array().cast("array<bigint>").alias("out"), zero.alias("carry")
        )
        return F.when(match.isNull(), state).otherwise(
            F.aggregate(numbers, empty, word, lambda acc: acc["out"])
        )

    bits = bind(masks, lambda m: F.aggregate(a, start, lambda state, t: step(state, m, t)))
    ones = F.aggregate(
        F.transform(bits, lambda v: F.bit_count(v)), F.lit(0), lambda s, n: s + n
    )
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(
        words * WORD_BITS - ones
    )


def prf(tp, n_pred, n_ref):
    """Precision, recall and F1 from counts."""
    p = tp / F.greatest(n_pred, F.lit(1))
    r = tp / F.greatest(n_ref, F.lit(1))
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-8))
    return p, r, f1


def token_count(tokens, token) -> Column:
    return F.size(F.filter(_col(tokens), lambda t: t == token))


# --- building tagged text -------------------------------------------------------------------

MODES = {
    # spoken kinds get speaker tags, marks are shown bare, the rest is skipped
    "full": (("asr",), ("bc", "silence", "pause", "ts", "te"), None),
    "two_state": (("asr",), ("ts", "te"), "asr"),
    "events_only": (("bc",), ("ts", "te", "silence", "pause"), "bc"),
}


def serialise(events, mode="full") -> Column:
    """Tagged text of an ordered event array (kind, speaker, token).

    A tag opens when the speaker changes and closes before another speaker, before an event
    token and at the end. Some modes leave the text blank unless a needed kind occurs.
    """
    spoken, marks, needed = MODES[mode]
    shown = F.filter(events, lambda e: e["kind"].isin(*spoken, *marks))

    def text(all_events):
        def piece(e, i):
            before, after = F.get(all_events, i - 1), F.get(all_events, i + 1)
            says = e["kind"].isin(*spoken)

            def same(o):
                return F.coalesce(
                    o["kind"].isin(*spoken) & (o["speaker"] == e["speaker"]), F.lit(False)
                )

            said = F.concat(
                F.when(same(before), "").otherwise(
                    F.concat(F.lit("<speaker_"), e["speaker"], F.lit(">"))
                ),
                F.when(e["kind"] == "bc", M.KIND_TOKEN["bc"]).otherwise(e["token"]),
                F.when(same(after), "").otherwise(
                    F.concat(F.lit("</speaker_"), e["speaker"], F.lit(">"))
                ),
            )
            mark = F.concat(F.lit("<"), e["kind"], F.lit(">"))
            return F.when(says, said).otherwise(mark)

        joined = F.array_join(F.transform(all_events, piece), "")
        if needed:
            return F.when(F.exists(all_events, lambda e: e["kind"] == needed), joined).otherwise("")
        return joined

    return bind(shown, text)
