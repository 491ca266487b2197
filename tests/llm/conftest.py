import random

import pytest
from pyspark.sql import types as T

VOCAB = __import__("public_tokenizers").path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice(["the", "and", "thing", "over", "Über", "nation,", "tion", "or", "st", "ing."]) + str(rng.randrange(90)) for _ in range(n)]


@pytest.fixture(scope="session")
def vocab():
    return VOCAB


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, copies, near copies and repeated rows."""
    rng = random.Random(4)
    base = words(rng, 60)
    near = [*base[:30], "changed", *base[31:]]
    rows = [
        (1, "", "en", "a", 0),
        (2, None, "en", "a", None),
        (3, "one two", None, None, 7),
        (4, "One TWO", "en", "b", 7),
        (5, " \n\t ", "de", "b", 4),
        (6, " ".join(base), "en", "b", 9),
        (7, " ".join(near), "en", "b", 9),
        (8, " ".join(base).upper(), "en", "b", 9),
        (9, "  ".join(base), "en", "b", 9),
        (10, "x" * 70_000, "en", "b", 70_000),
        (11, " ".join(words(rng, 12_000)), "en", "b", 1),
        (12, "é́ 日本語 <|endoftext|> don't 'store 3.14   😀", "fr", "b", 1),
        (13, "one two", "en", "c", 7),
        (13, "one two", "en", "c", 7),
        (13, "three", "en", "c", 5),
        (None, "no key", "en", "c", 6),
        (None, "no key", "en", "c", 6),
        (-4, "one two", "en", "c", 7),
    ]
    return rows + [(100 + k, " ".join(words(rng, rng.randrange(1, 40))), "en", "d", 1) for k in range(40)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Edge rows with columns whose names the operators use themselves."""
    names = "key digest keep_id group_size kept shard slot size crc fp n score label task data range number".split()
    schema = T.StructType([*T._parse_datatype_string(DOCS).fields, *(T.StructField(c, T.StringType()) for c in names)])
    return spark.createDataFrame([(*r, *names) for r in edge_rows()], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
