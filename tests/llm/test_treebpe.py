import random
from hashlib import sha256

import pytest
from tokenizers import Tokenizer

from parley.llm import treebpe, wordbpe

PARTS = ["a", "the", "'s", "é", "!", "'", "s", "t", " ", "\n", "3", "日", "İ", "<|endoftext|>", "ß", "ing", " ", "😀", "̣", "Σ", "'ll", "-", "\x1c", "\u0085", "×", " "]


def samples():
    rng = random.Random(3)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(150))) for _ in range(300)]
    out += ["".join(rng.choice("abcdeth'") for _ in range(rng.randrange(100, 900))) for _ in range(40)]
    return out + ["", " " * 300, "a" * 2000, "!" * 900, "'s" * 400, "thing" * 300, "e" + "́" * 200, "<|startoftext|>" * 3]


@pytest.mark.parametrize("leaf, window", [(40, 2), (64, 16), (32768, 48)])
def test_tree_equals_library(vocab, leaf, window):
    texts, library = samples(), Tokenizer.from_file(vocab)
    tree = treebpe.TreeEncoder(vocab, leaf, window)
    for text, ids in zip(texts, tree.encode([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert tree.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_word_encoder_equals_library(vocab):
    texts, library = samples(), Tokenizer.from_file(vocab)
    for text, ids in zip(texts, wordbpe.load(vocab).encode([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_against_the_library(edge_docs, vocab):
    library = Tokenizer.from_file(vocab)
    want = []
    for r in edge_docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        sha = [sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((str(r["doc_id"]), len(ids), *sha))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in treebpe.documents_query(edge_docs, vocab).collect()]
    assert sorted(got) == sorted(want)


def test_empty_and_clashing(no_docs, clashing, vocab):
    assert treebpe.documents_query(no_docs, vocab).count() == 0
    rows = treebpe.encoded(clashing.filter("doc_id = 3"), vocab).collect()
    assert rows[0]["decoded"] == "one</w> two</w>"
