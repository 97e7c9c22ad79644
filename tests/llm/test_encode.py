import random

import pytest

from actlens.llm import encode as E

ALPHABET = ["a", "B", "é", "中", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "1", "22", "...", "🙂", "\xa0", "\r\n", "xyz" * 30, " " * 50, "=-" * 40, "the", "<|endoftext|>"]


@pytest.fixture(scope="module")
def direct():
    return E.encoding()[0].encode_ordinary


def _text(r, most):
    return "".join(r.choice(ALPHABET) for _ in range(r.randint(0, most)))


def test_tree_equals_direct(direct):
    r = random.Random(1)
    bare = E.encoding()[1]
    for _ in range(1500):
        t = _text(r, 100)
        want = direct(t)
        assert E.encode_text(t, leaf=32) == want
        ids, word = [], []
        for leaf, data in E.pieces(t, piece=20, leaf=32):
            if leaf:
                word.append(E._bpe(bare, data))
            else:
                ids, word = ids + E.join_all(bare, word) + (direct(data.decode()) if data else []), []
        assert ids == want and not word


def test_long_unsplit_words():
    r = random.Random(2)
    whole, bare = E.encoding()
    for alphabet in ("a", "ab", "aA=+/0", "é", " "):
        word = "".join(r.choice(alphabet) for _ in range(20_000)).encode()
        assert E.encode_word(bare, word, 64) == E._bpe(bare, word)


def test_agrees_with_the_other_library(direct):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    r = random.Random(3)
    texts = [_text(r, 80) for _ in range(300)]
    assert [x.ids for x in t.encode_batch(texts, add_special_tokens=False)] == [direct(x) for x in texts]


def test_corpus(spark, direct):
    r = random.Random(4)
    texts = [None, "", " ", "word", _text(r, 3000), "x" * 5000, "\n" * 3000, _text(r, 50) + "y" * 4000 + _text(r, 50)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(4, texts[4], 0), (None, "null id", 0), (None, "q" * 2000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    for long in (10**9, 1000, 0):
        got = sorted((repr(r.doc_id), list(r.ids)) for r in E.encode_corpus(df, long=long).collect())
        assert got == sorted((repr(i), direct(t or "")) for i, t, _ in rows)
    assert E.encode_corpus(df.limit(0)).count() == 0
