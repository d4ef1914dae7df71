import random

import pytest

from emoloom.llm import common, tokenize as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    t = tokenizers.Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return T.Encoder(T.load_ranks()), t


def test_against_the_library(both):
    own, library = both
    rng = random.Random(7)
    alphabet = ["a", "B", " ", "  ", "\n", "আ", "মি", "্", "।", "😂", "'s", "'LL", "1", "২", "\t", " ", "!", "é", "\x1c", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += ["x" * 3000, "ab" * 700 + "ñ" * 300, "I'm we'll DON'T", "   ", "আমি বাংলায় গান গাই", "　 x"]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(t) == want.ids, ascii(t)


def test_long_words_by_the_heap_are_those_by_the_scan(both):
    own, _ = both
    rng = random.Random(8)
    for _ in range(50):
        word = bytes(rng.choice(b"abcde ") for _ in range(rng.randrange(2, 120)))
        assert own._merge_long(word) == own.merge(word) or word in own.ranks


def test_table(spark, both):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "hello আমি"), (5, "word " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as ids")
    got = {r.doc_id: r.ids for r in T.encoded(df).collect()}
    assert got == {i: both[0].encode(t) for i, t in rows} and got[1] == [] and got[2] == [] and got[3] != []
    assert T.encoded(df.limit(0)).collect() == []
    n = {r[0]: r[1] for r in df.select("doc_id", T.token_count(spark, df.text)).collect()}
    assert n == {i: len(x) for i, x in got.items()}
