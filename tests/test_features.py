import math
import re

from pyspark.sql import functions as F

from emoloom.functions import features as X, lexicons as L, text as T

TEXTS = [
    None, "", "   ", "আমি না খুব ভালো আছি", "কখনো না কখনো না মোটেই না ভালো", "না না খুব রাগ আর ভয় নেই", "হাআআআআআ খুব মজা!!!! কি???", "দারুণ সুন্দর কিন্তু জঘন্য বাজে", "কিন্তু", "ভালো কিন্তু",
    "GOOD day HAHAHA 123 ১২৩ आज", "#tag one #দুই !!", "আমি ভালো আছি and I love it", "খুব ভীষণ রাগ ভয় আনন্দ", "একটু একটু ভালো মনে হয়", "আমি গেলাম এবং দেখলাম করছে যাব", "😂😂 👍🏽 👨‍👩‍👧 🇧🇩 ❤️ 1️⃣", "এক দুই তিন চার পাঁচ", "এক এক এক এক এক", "না করি না হয়", "... … ?? ?!",
]


def get(spark, make):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").withColumn("tok", T.tokens(F.col("t")))
    return [r[1:] for r in df.select("i", *(c.alias(k) for k, c in make(F.col("t"), F.col("tok")).items())).orderBy("i").collect()]


def same(got, want):
    for t, a, b in zip(TEXTS, got, want):
        assert len(a) == len(b) and all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(map(float, a), map(float, b))), (t, a, b)


def words(t):
    return (t or "").split()


def greedy(tok, entries):
    n, i = 0, 0
    while i < len(tok):
        width = next((k for k in (3, 2, 1) if i + k <= len(tok) and " ".join(tok[i : i + k]) in entries), 0)
        n, i = n + (width > 0), i + max(width, 1)
    return n


def around(tok, i):
    return tok[max(0, i - 3) : i] + tok[i + 1 : i + 4]


def test_expressive(spark):
    def one(t):
        t, w = t or "", words(t)
        n = max(len(t), 1)
        return [
            t.count("!"), t.count("?"), len(re.findall("!{3,}", t)), len(re.findall(r"\?{3,}", t)), len(re.findall(r"([?!.,;:\-_।])\1{2,}", t)), sum(bool(re.search(r"(.)\1{2,}", x)) for x in w), len(t), len(w),
            sum(map(len, w)) / len(w) if w else 0, sum(c.isupper() for c in t) / n, len(re.findall(r"\d", t)), sum("ঀ" <= c <= "৿" for c in t) / n, sum(x.isupper() for x in w),
        ]

    same(get(spark, X.expressive), map(one, TEXTS))
    assert len(X.expressive(F.lit(""), F.array())) == 13


def test_negation_basic(spark):
    neg, ints, dims, verbs = set(L.NEGATIONS), set(L.INTENSIFIERS), set(L.DIMINISHERS), set(L.VERBS)

    def one(t):
        w = words(t)
        a, b, c = greedy(w, neg), greedy(w, ints), greedy(w, dims)
        v = sum(x in neg and bool(verbs & set(w[i + 1 : i + 4])) for i, x in enumerate(w))
        m = sum(x in neg and bool(ints & set(around(w, i))) for i, x in enumerate(w))
        return [a, a > 0, b, b > 0, c, c > 0, v, m, a + b + c, (a + b + c) / max(len(w), 1)]

    same(get(spark, lambda t, tok: X.negation_basic(tok)), map(one, TEXTS))


def test_sentiment_and_lexicon(spark):
    pos, neg = set(L.POSITIVE), set(L.NEGATIVE)

    def one(t):
        w = words(t)
        p, g, n = sum(x in pos for x in w), sum(x in neg for x in w), max(len(words(t)), 1)
        return [p, g, p - g, p / n, g / n, abs(p - g), (p > g) - (p < g), p > 0, g > 0, p > 0 and g > 0]

    def two(t):
        w, n = words(t), max(len(words(t)), 1)
        c = [sum(x in L.EMOTIONS[e] for x in w) for e in X.EMOTIONS]
        return [*c, *(x / n for x in c), *(x > 0 for x in c)]

    same(get(spark, lambda t, tok: X.sentiment(tok)), map(one, TEXTS))
    same(get(spark, lambda t, tok: X.emotion_lexicon(tok)), map(two, TEXTS))


def test_negation_scope(spark):
    neg, ints = set(L.NEGATIONS), set(L.INTENSIFIERS)

    def one(t):
        w = words(t)
        n, a, b = max(len(w), 1), sum(x in neg for x in w), sum(x in ints for x in w)
        at = [i for i, x in enumerate(w) if x in neg]
        near = sum(bool(ints & set(around(w, i))) for i in at)
        scope = [sum(x in L.EMOTIONS[e] for i in at for x in around(w, i)) for e in X.EMOTIONS]
        s = sum(scope)
        return [a, a > 0, b, b > 0, near, s, *scope, a / n, b / n, s / n, (a + b) / n]

    same(get(spark, lambda t, tok: X.negation_scope(tok)), map(one, TEXTS))


def test_small_groups(spark):
    def elong(t):
        w = words(t)
        e = sum(bool(re.search(r"(.)\1{2,}", x)) for x in w)
        return [e, e > 0, len(re.findall(r"(.)\1{2,}", t or "")), e / max(len(w), 1)]

    def tags(t):
        x = re.findall(r"#\S+", t or "")
        return [len(x), len(x) > 0, sum(map(len, x)) / max(len(t or ""), 1)]

    def mix(t):
        t = t or ""
        n, b, l = max(len(t), 1), sum("ঀ" <= c <= "৿" for c in t), len(re.findall("[a-zA-Z]", t))
        return [b / n, l / n, len(re.findall(r"\d", t)) / n, b >= 3 and l >= 3]

    def stats(t):
        t, w = t or "", words(t)
        m = max(len(w), 1)
        return [len(set(w)) / m, len(t) / m / 15, math.log1p(len(t)) / 10, math.log1p(len(w)) / 6]

    same(get(spark, X.elongation), map(elong, TEXTS))
    same(get(spark, lambda t, tok: X.hashtags(t)), map(tags, TEXTS))
    same(get(spark, lambda t, tok: X.code_mix(t)), map(mix, TEXTS))
    same(get(spark, X.text_stats), map(stats, TEXTS))


def test_verb_endings(spark):
    def one(t):
        t, n = t or "", max(len(words(t)), 1)
        c = [len(re.findall(rf"\b\S+({p})\b", t)) for p in ("লাম|ছিল|লেন", "ছে|ছেন|ছি", "ব|বে|বেন")]
        return [*(x / n for x in c), sum(c) > 0]

    same(get(spark, X.verb_endings), map(one, TEXTS))


def test_questions_contrast_intensified(spark):
    wh, con, ints = set(L.QUESTION_WORDS), set(L.CONNECTIVES), set(L.INTENSIFIERS)
    bad = {w for e in ("disgust", "anger", "fear", "sadness") for w in L.EMOTIONS[e]}
    emo = {e: set(v) for e, v in L.EMOTIONS.items()}

    def ask(t):
        t, q = t or "", sum(x in wh for x in words(t))
        m = len(re.findall(r"\?+", t))
        return [q, q > 0, m / max(len(t), 1) * 10, m > 0, "!" in t, bool(re.search("[?!]{2,}", t)), bool(re.search(r"\?{2,}", t)), bool(re.search(r"\.{3,}|…", t))]

    def but(t):
        w = words(t)
        c = sum(x in con for x in w)
        at = next((i for i, x in enumerate(w) if x in con), None)
        a, b = (set(w[:at]), set(w[at + 1 :])) if at is not None and at + 1 < len(w) else (set(), set())
        return [c, c > 0, bool(bad & b), bool(emo["joy"] & a and bad & b), *(bool(emo[e] & b) for e in ("disgust", "anger", "sadness")), sum(x in emo["disgust"] for x in w), sum(x in bad for x in w), c / max(len(w), 1)]

    def very(t):
        w = words(t)
        c = [sum(y in emo[e] for i, x in enumerate(w) if x in ints for y in w[i + 1 : i + 3]) for e in X.EMOTIONS]
        return [*c, *(x > 0 for x in c)]

    same(get(spark, X.questions), map(ask, TEXTS))
    same(get(spark, lambda t, tok: X.contrast(tok)), map(but, TEXTS))
    same(get(spark, lambda t, tok: X.intensified(tok)), map(very, TEXTS))


def test_emoji(spark):
    df = spark.createDataFrame([(TEXTS[16],), ("",), (None,), ("no emoji 12#",)], "t string")
    assert [r[0] for r in df.select(X.emoji_list(F.col("t"))).collect()] == [["😂", "😂", "👍🏽", "👨‍👩‍👧", "🇧🇩", "❤️", "1️⃣"], [], [], []]
    base = df.select(*(c.alias(k) for k, c in X.emoji_base(F.col("t")).items())).first()
    assert base[:3] == (7.0, 6.0, 1.0) and base[4] == 1.0
    assert [r[0] for r in df.select(*X.emoji_indicators(F.col("t"), ["🇧🇩"]).values()).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_divergence_and_error_flags(spark):
    df = spark.createDataFrame([("a b c", "a x"), (None, None), ("", "a")], "a string, b string")
    rows = df.select(*X.divergence(T.tokens(df.a), T.tokens(df.b)).values()).collect()
    assert [tuple(r) for r in rows] == [(2.0, 1.0, 2 / 3), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]
    flags = df.select(*(c.alias(k) for k, c in X.error_patterns(df.a, df.b, T.tokens(df.a)).items())).collect()
    assert flags[0].short_text and not flags[1].has_negation
