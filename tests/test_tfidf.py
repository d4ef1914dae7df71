import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emoloom.operators import compose, tfidf

TRAIN = [(1, "আমি ভালো আছি ভালো"), (2, "Ami valo NAI"), (3, "খুব খারাপ লাগছে আজ"), (4, ""), (5, None), (6, "a bc def 😂 😂"), (7, "ভালো ভালো ভালো"), (8, "আজ আমি")]


def word_terms(t):
    w = (t or "").lower().split()
    return w + [" ".join(p) for p in zip(w, w[1:])]


def char_terms(t):
    out = []
    for w in (t or "").lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            if len(w) <= n:
                out.append(w)
                break
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


def model(rows, terms, limit):
    tf = {i: Counter(terms(t)) for i, t in rows}
    total, df = Counter(), Counter()
    for c in tf.values():
        total.update(c)
        df.update(c.keys())
    vocab = sorted(sorted(total, key=lambda x: (-total[x], x))[:limit])
    at = {w: k for k, w in enumerate(vocab)}
    out = {}
    for i, c in tf.items():
        v = {at[w]: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in c.items() if w in at}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        out |= {(i, k): x / norm for k, x in v.items()}
    return out, len(vocab)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(TRAIN, "doc long, text string")


def test_against_plain_python(spark, df):
    x = tfidf.TfIdf({"max_features": 12}, {"max_features": 30})
    got = {(r.doc, r.idx): r.value for r in x.fit_transform(df, "doc", "text").collect()}
    a, n = model(TRAIN, word_terms, 12)
    b, m = model(TRAIN, char_terms, 30)
    want = a | {(i, k + n): v for (i, k), v in b.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert x.shape() == (len(TRAIN), n + m) and x.names().count() == n + m and x.summary()["word_features"] == n


def test_new_texts_dont_change_the_vocabulary(spark, df, tmp_path):
    x = tfidf.TfIdf({"max_features": 12}, {"max_features": 30}).fit(df, "doc", "text")
    before = x.shape()
    new = spark.createDataFrame([(1, "নতুন ভালো শব্দ"), (2, "zzz")], "doc long, text string")
    first = sorted(tuple(r) for r in x.transform(new, "doc", "text").collect())
    assert x.shape() == before and {d for d, *_ in first} == {1}
    x.save(str(tmp_path / "t"))
    again = tfidf.TfIdf.load(spark, str(tmp_path / "t"), word={"max_features": 12}, char={"max_features": 30})
    assert sorted(tuple(r) for r in again.transform(new, "doc", "text").collect()) == first
    with pytest.raises(FileNotFoundError):
        tfidf.TfIdf.load(spark, str(tmp_path / "none"))
    with pytest.raises(RuntimeError):
        tfidf.TfIdf().transform(df, "doc", "text")


def test_settings():
    x = tfidf.TfIdf({"max_features": 5})
    assert x.word == {"ngram_range": (1, 2), "max_features": 5} and x.char["max_features"] == 15_000


def test_extractors(spark):
    rows = spark.createDataFrame([(k, f"raw {t or ''} 😂 #x", t or "") for k, t in TRAIN], "doc long, raw string, clean string")
    small = {"word": {"max_features": 10}, "char": {"max_features": 10}, "emoji_least": 2}
    widths = {}
    for name in ("E6", "E8", "champion"):
        x = compose.extractor(name, **small).fit(rows, "doc", "raw", "clean")
        out = x.transform(rows, "doc", "raw", "clean").collect()
        widths[name] = x.width()
        assert len(out) == len(TRAIN) and {r.features.size for r in out} == {x.width()} and len(x.names()) == x.width()
        assert all(math.isfinite(v) for r in out for v in r.features.toArray())
    assert widths["E8"] == widths["E6"] + 10
    with pytest.raises(ValueError):
        compose.extractor("E5")
    with pytest.raises(ValueError):
        compose.Extractor(())
    with pytest.raises(RuntimeError):
        compose.extractor("E1").transform(rows, "doc", "raw", "clean")


def test_max_abs(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-4.0, 0.0)], "a double, b double")
    assert [tuple(r) for r in compose.max_abs(df, ["a", "b"]).collect()] == [(0.25, 0.0), (-1.0, 0.0)]
    assert df.select(tfidf.idf(3, F.lit(1))).first()[0] == pytest.approx(math.log(2) + 1)
