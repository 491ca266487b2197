"""A training-data pipeline over ``documents``: toxic texts go, then copies, then near copies; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as
the next stage's ``docs``. All but the last keep the columns of ``documents``.
"""

from pyspark.sql import functions as F

from parley.llm import exactdedup, jaccard, packing, toxicity
from parley.llm.common import materialise
from parley.llm.queries import table, vocab_path

#: From this probability on a text is rejected: what op6 predicts as toxic.
TOXIC = toxicity.THRESHOLD


def drop_toxic(spark, docs, sf_dir):
    """Rows that the classifier finds toxic go. It learns from the labelled rows among ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, score="__score").filter(F.col("__score") < TOXIC).select(*docs.columns)


def drop_copies(spark, docs, sf_dir):
    """Of rows with equal texts the one with the largest doc_id stays."""
    return exactdedup.deduplicated(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of each component of near copies the row with the smallest doc_id stays."""
    return jaccard.representatives(docs)


def pack(spark, docs, sf_dir):
    """All documents as pieces in sequences of at most 4096 tokens."""
    return packing.documents_query(docs, vocab_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("packing", pack),
]

#: SQL cannot train the classifier of the first stage; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
