import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from emoloom.functions import lexicons as L, text as T

CASES = [
    None, "", "   ", "\t\n", "এটা দেখুন http://example.com ভালো", "www.youtube.com/watch?v=abc123 মজার ভিডিও", "https://x.y", "@someone", "কি!!! কেন???? আচ্ছা....", "<b>bold</b> &amp; &#39; text",
    "@admin https://t.co/xyz <br> না চাই!!! খুব ভালো &nbsp; ।।।।", "বাড়ি বাড়ি নয় নয় হতো", "a b c", "zero​width", "१२३ ১২৩ 123", "😂😂 #ট্যাগ xwww.foo bar", "mail a@b.c end",
]


def model(t, empty=""):
    """The cleaning chain in plain Python."""
    if t is None or not t.strip():
        return empty
    t = re.sub(r"(?:https?://|ftp://|www\.)\S+", " ", t, flags=re.I)
    t = re.sub(r"@\S+", " ", t)
    t = re.sub(r"&(?:[a-zA-Z]+|#[0-9]+);", " ", re.sub(r"<[^>]+>", " ", t))
    t = " ".join(t.split())
    for c in "​‌⁠﻿":
        t = t.replace(c, "")
    for two, one in L.COMPOSED:
        t = t.replace(two, one)
    t = re.sub(r"([?!.,;:\-_।])\1{2,}", r"\1\1", t)
    return " ".join(t.split()) or empty


def column(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in df.select("i", make(F.col("t"))).orderBy("i").collect()]


def test_cleaning(spark):
    assert column(spark, CASES, T.cleaned) == [model(t) for t in CASES]
    assert column(spark, [None, " "], lambda c: T.cleaned(c, "<empty>")) == ["<empty>"] * 2


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aZ .!?।@#<>&;/:wht়ডযোকি​  \n\t😂")), max_size=40), min_size=20, max_size=60))
def test_random_texts(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or pytest.skip("no session")
    assert column(spark, texts, T.cleaned) == [model(t) for t in texts]
    assert column(spark, texts, T.tokens) == [t.split() for t in texts]


def test_tokens_and_keys(spark):
    assert column(spark, [None, "", " a  b　c "], T.tokens) == [[], [], ["a", "b", "c"]]
    assert column(spark, [None, "é  x "], T.comparison_key) == ["", "é x"]
    assert column(spark, [None, " AbC\n"], T.simple_key) == ["", "abc"]
    import hashlib

    assert column(spark, ["ক"], T.short_hash) == [hashlib.sha1("ক".encode()).hexdigest()[:12]]


def test_preserved_words(spark):
    df = spark.createDataFrame([("না খুব ভালো", "না ভালো"), (None, "x"), ("", "")], "a string, b string")
    rows = df.select(*(c.alias(k) for k, c in T.preserved(df.a, df.b, ["না", "খুব", "বেশ"]).items())).collect()
    assert rows[0] == (["না"], ["খুব"], False) and rows[1] == ([], [], True) and rows[2] == ([], [], True)


def test_lexicon_forms():
    assert "\u09a8\u09af\u09bc" in L.lexicon(L.NEGATIONS) and "\u09a8\u09df" in L.lexicon(L.NEGATIONS, "normalized")
    assert all("়" not in w for w in L.lexicon(L.NEGATIONS, "normalized"))
    assert len(L.NEGATIONS) >= 25 and len(L.INTENSIFIERS) >= 30
    with pytest.raises(ValueError):
        L.lexicon(L.NEGATIONS, "other")
    assert L.precomposed(unicodedata.normalize("NFD", "হতো")) == "হতো"
