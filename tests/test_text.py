import random
import time

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import repeats as P
from parley.functions import tagged as G
from parley.functions import text as X
from parley.functions import udtf
from parley.functions.distance import bit_distance, bit_distances, edit_distance
from parley.operators import evaluation as E
from tests import model as R


def column(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.out for r in df.select("i", fn("v").alias("out")).orderBy("i").collect()]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc", max_size=40), st.integers(2, 4), st.integers(1, 6))
def test_squeeze_takes_the_best_unit(text, least, longest):
    assert P.squeeze(text, least, longest) == R.squeeze(text, least, longest)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abé", max_size=90), st.text(alphabet="abé", max_size=90))
def test_bit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        old, row[0] = row[:], i + 1
        for j, y in enumerate(b):
            row[j + 1] = min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y))
    assert bit_distance(a, b) == row[-1]


def test_edit_distance_over_the_size_limit(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcé ") for _ in range(n))
    rows = [(word(n), word(m)) for n, m in [(0, 0), (3, 4), (90, 90), (150, 120), (400, 900), (0, 9)]]
    df = spark.createDataFrame(rows + [(None, "a")], "a string, b string")
    out = df.select(edit_distance("a", "b").alias("x"), F.levenshtein("a", "b").alias("y")).collect()
    assert all(r.x == r.y for r in out) and len(out) == 7


def test_squeeze_examples():
    assert P.squeeze("aababab") == "aab"
    assert P.squeeze("aaaaaa") == "a"  # one-character unit on equal savings
    assert P.squeeze("ababab" * 2) == "ab"
    assert P.squeeze("abab") == "abab"
    assert P.squeeze("x" * 5000) == "x"
    assert P.squeeze("aaa", keep=3) == "aaa"


PHRASES = {
    "a、a、a": "a",
    "a、a、a、b": "a、b",
    "a, a,a，b": "a，b",
    "a、a、a、": "a",
    "a、a、b、": "a、a、b、",
    "b、a、a、a、c、c、c": "b、a、c",
    "a、、a、a、a": "a、、a、a、a",
    "、a、a、a": "、a、a、a",
    " 、 、 、x": " 、 、 、x",
    "": "",
    "、": "、",
    "a、a": "a、a",
}


def test_collapse_phrases(spark):
    assert column(spark, [*PHRASES, None], P.collapse_phrases) == [*PHRASES.values(), None]
    assert column(spark, ["a、a、b"], lambda c: P.collapse_phrases(c, 2)) == ["a、b"]


def test_collapse_phrases_of_a_long_text(spark):
    """Work grows with the number of phrases, not with a power of it."""
    began = time.time()
    text = "、".join(f"語{k // 3}" for k in range(6000))
    assert column(spark, [text], P.collapse_phrases) == ["、".join(f"語{k}" for k in range(2000))]
    assert time.time() - began < 20


def test_clean_prediction_leaves_tags(spark):
    texts = ["<ts><ts><ts><ts>", "<speaker_A>はいはいはい</speaker_A><te>", "ab", None, "x、x、x、y", "<speaker_A>x、x、x</speaker_A><ts>、y"]
    want = ["<ts><ts><ts><ts>", "<speaker_A>はい</speaker_A><te>", "ab", None, "x、y", "<speaker_A>x</speaker_A><ts>、y"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    assert [r.v for r in P.clean_prediction(df, "v").orderBy("i").collect()] == want


def test_lcs_against_table(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(150):
        size = rnd.choice([0, 1, 5, 62, 63, 130])
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, size))]
        b = [rnd.choice("abcdx") for _ in range(rnd.randint(0, size))]
        rows.append((a, b, R.lcs(a, b)))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, want int")
    assert df.where(G.lcs_length("a", "b") != F.col("want")).count() == 0


TAGGED = "x<speaker_A> he <ts> llo </speaker_A>< 3<speaker_B>y<o</speaker_B><te>  <speaker_A>z"


def test_speaker_text_and_specials(spark):
    assert column(spark, [TAGGED, "", "plain"], lambda c: G.speaker_text(c, "A")) == ["helloz", "", ""]
    assert column(spark, [TAGGED], lambda c: G.speaker_text(c, "B")) == ["y<o"]
    assert column(spark, [TAGGED, ""], G.special_tokens) == [["<ts>", "<te>"], []]


def test_parse_events_and_udtf_agree(spark):
    long = "<speaker_B>" + "word < " * 20000 + "</speaker_B><bc>"
    df = spark.createDataFrame([(1, TAGGED), (2, ""), (3, long)], "i int, s string")
    rows = df.select("i", F.posexplode(G.parse_events("s")).alias("pos", "e"))
    have = sorted((r.i, r.pos, r.e.kind, r.e.speaker or "", r.e.value) for r in rows.collect())
    assert [h[2:] for h in have if h[0] == 1] == [
        ("text", "", "x"),
        ("text", "speaker_A", "he"),
        ("special", "", "<ts>"),
        ("text", "speaker_A", "llo"),
        ("text", "", "< 3"),
        ("text", "speaker_B", "y<o"),
        ("special", "", "<te>"),
        ("text", "speaker_A", "z"),
    ]
    udtf.register(spark)
    df.createOrReplaceTempView("tagged_rows")
    out = spark.sql("SELECT i, e.* FROM tagged_rows r, LATERAL tagged_events(r.s) e").collect()
    assert sorted((r.i, r.pos, r.kind, r.speaker or "", r.value) for r in out) == have


def test_scores_of_empty_and_long_texts(spark):
    a = "<speaker_A>été</speaker_A>"
    rows = [(1, "", ""), (2, a, "<speaker_A>ete</speaker_A><ts>"), (3, "", a + "<te>"), (4, a, "")]
    df = spark.createDataFrame(rows, "i int, pred string, ref string")
    got = {r.i: r for r in E.score(df).collect()}
    assert (got[1].edits, got[1].cer, got[1].f1) == (0, 0.0, 0.0)
    assert (got[2].edits_A, got[2].ref_chars, got[2].fn) == (2, 3, 1)
    assert (got[3].edits, got[3].cer, got[3].tp) == (3, 1.0, 0)
    assert (got[4].edits, got[4].cer) == (3, 3.0)


def test_label_parsing(spark):
    texts = ["Continuer.", "assessment: yes\nmore", "", None, "a continuer or an assessment", "continuers", "\n non_backchannel"]
    want = ["continuer", "assessment", "non_backchannel", "non_backchannel", "assessment", "non_backchannel", "non_backchannel"]
    assert column(spark, texts, X.parse_label) == want


def test_backchannel_rules(spark):
    rows = [("はい", 1000), ("はい", 1001), ("abcd", 800), ("abcde", 801), ("abcdefgh", 1000), ("abcdefghi", 900), (" ", 100)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d long")
    out = df.select("i", X.is_short_response("t", "d").alias("f")).orderBy("i").collect()
    assert [r.f for r in out] == [True, False, True, True, True, False, False]
    assert column(spark, ["うんうんうん。はい うん", "", "なるほど、そうですね"], X.lexicon_tokens) == [
        ["うん", "うん", "うん", "はい", "うん"],
        [],
        ["なるほど", "そう"],
    ]
    flags = column(spark, ["うん うん うん", "うん はい", "", "やま やま やま"], X.low_information_density)
    assert flags == [True, False, False, False]


def test_small_functions(spark):
    assert column(spark, ["ab", "abcdef"], lambda c: X.truncate_text(c, 3)) == [
        "ab",
        "abc... <truncated 3 chars>",
    ]
    assert column(spark, ["a_b_c", "a", ""], lambda c: X.drop_name_parts(c, 2)) == ["c", "", ""]
    assert column(spark, ["/x/zoo/y.wav", "/q"], lambda c: X.relativize_path(c, "zoo")) == ["zoo/y.wav", "/q"]
    assert column(spark, ["●", " 〓", "●a。b", "。"], X.clean_text) == [None, None, "a b", None]
    assert column(spark, [" Ab-c "], lambda c: X.mask_oov(c, list("ab") + ["<pad>"], "en")) == ["ab**"]
    assert column(spark, ["/p/a.b.txt"], lambda c: X.stem_with_suffix(c, ".wav")) == ["/p/a.b.wav"]
    pieces = column(spark, ["<A>x<B><A>"], X.split_placeholders)[0]
    assert [(p.piece, p.id) for p in pieces] == [("<A>", -201), ("x", None), ("<B>", -202), ("<A>", -201)]
    assert column(spark, [["a", "。", "。"], ["a"], []], X.strip_final_punct, "array<string>") == [["a", "。"], ["a"], []]


def test_loss_mask(spark):
    # start=1, assistant=6, end=2; the first turn is a user turn
    ids = [[1, 5, 9, 7, 2, 1, 6, 9, 8, 8, 2], [], [3, 3]]
    want = [[-100] * 8 + [8, 8, 2], [], [-100, -100]]
    assert column(spark, ids, lambda c: X.assistant_loss_mask(c, 1, 6, 2), "array<int>") == want


def test_serialise_modes(spark):
    ev = [("asr", "A", "x"), ("overlap", "A", "y"), ("asr", "A", "z"), ("bc", "A", "<bc>"), ("bc", "B", "<bc>"), ("ts", "A", "<ts>")]
    df = spark.createDataFrame([(ev,)], "e array<struct<kind:string,speaker:string,token:string>>")
    out = df.select(*[G.serialise(F.col("e"), m) for m in ("full", "two_state", "events_only")]).collect()[0]
    assert list(out) == [
        "<speaker_A>xz</speaker_A><bc><bc><ts>",
        "<speaker_A>xz</speaker_A><ts>",
        "<speaker_A><bc></speaker_A><speaker_B><bc></speaker_B><ts>",
    ]
    quiet = spark.createDataFrame([([("ts", "A", "<ts>")],)], df.schema)
    assert quiet.select(G.serialise(F.col("e"), "two_state")).collect()[0][0] == ""


def test_distances_of_many_pairs():
    """Pairs taken together, in words of 64 places, give what each gives alone."""
    rnd = random.Random(12)
    pairs = [("", ""), ("", "abc"), ("a" * 64, "a" * 64), ("a" * 65, "b" * 200), ("é😀" * 40, "é" * 80), ("\ud800x", "x")]
    for n in (1, 5, 63, 64, 65, 128, 300, 700):
        for letters in ("ab", "あいうえおかき😀", "x"):
            for _ in range(9):
                a = [rnd.choice(letters) for _ in range(n)]
                b = [c if rnd.random() < 0.9 else rnd.choice(["", "zz", letters[0]]) for c in a]
                pairs.append(("".join(a), "".join(b)))
    rnd.shuffle(pairs)
    assert bit_distances(*zip(*pairs)) == [bit_distance(a, b) for a, b in pairs]
    assert bit_distances([], []) == []


def test_squeeze_of_many_texts():
    """Texts looked at together do not run into each other."""
    rnd = random.Random(3)
    texts = ["", "a", "aa", "\0\0\0\0", "a\0a\0a\0"] + ["".join(rnd.choice("ab\0") for _ in range(rnd.randrange(40))) for _ in range(800)]
    for least, longest, keep in ((3, 20, 1), (2, 5, 1), (4, 3, 2), (3, 20, 0)):
        assert P.squeeze_all(texts, least, longest, keep) == [R.squeeze(t, least, longest, keep) for t in texts]
    assert P.squeeze_tagged(["ab" * 9 + "<ts>" + "ab" * 9, ""]) == ["ab<ts>ab", ""]
    with pytest.raises(ValueError):
        P.squeeze("aaa", 1)
