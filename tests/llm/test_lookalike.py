import random

from emoloom.llm import lookalike as L


def form(text, words=()):
    return L.Canonicaliser(list(words)).text(text)


def test_equal_looking_texts_get_one_form():
    base = "আমার বাড়ি ঢাকায়, আসলে চমৎকার cafe"
    for other in (
        base.replace("ড়", "ড়"), base.replace("আ", "অা"), base.replace("ৎ", "ত্‍"), base.replace("c", "с"), base.replace("a", "ɑ"),
        base.replace(" ", " "), "﻿" + base, base[:4] + "​" + base[4:], base.replace("cafe", "ｃａｆｅ"), base.replace(",", "，"), base + "⁠",
    ):
        assert form(other) == form(base), ascii(other)


def test_what_looks_different_stays_different():
    for a, b in (("It's", "It’s"), ("Abc", "abc"), ("cafe", "café"), ("ক খ", "কখ"), ("ra্‌", "ra্"), ("👨‍👩", "👨👩"), ("১", "1")):
        assert form(a) != form(b)


def test_the_vocabulary_doesnt_change_what_is_equal():
    words = ["প্রোগ্রাম", "hello", "বাড়ি"]
    for t in ("hеllo", "বাড়ি", "he​llo", "অচেনা", "xаy"):
        assert form(t, words) == form(t)


def test_automaton_counts_edits():
    a = L.Automaton(["hello", "help", "house"])
    assert a.match("hеllo") == "hello"
    assert a.match("hxllo") is None
    assert a.match("hxllo", most=1) == "hello"
    assert a.match("hel", most=1) == "help"
    assert a.match("", most=1) is None


def test_forms_are_stable():
    rng = random.Random(3)
    alphabet = "aAоаɑ​ড়ড়য়কিা ্অে‍‌﻿ｘ"
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert form(form(t)) == form(t)


def test_pairs(spark):
    rows = [
        (1, "one two three four"), (2, "one two three fоur"), (3, "one  two\nthree four "), (4, "one two three"), (5, "one twо three"), (6, None),
        (7, ""), (8, "   "), (9, "One two three four"), (10, "!! ?? ,, .."), (11, "one two three four"), (12, "one two three four"), (13, "x " * 3000),
    ]
    df = spark.createDataFrame(rows, "internal_id long, text string").withColumnsRenamed({}).selectExpr("*", "'x' as look", "1 as id", "2 as code")
    got = {tuple(r) for r in L.lookalike_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (2, 11), (2, 12), (1, 11), (3, 11), (11, 12)}
    empty = spark.createDataFrame([], "internal_id long, text string")
    assert L.lookalike_pairs(empty).collect() == []


def test_canonical_column(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " a  b "), (4, "hеy")], "internal_id long, text string").selectExpr("*", "9 as canonical_text")
    got = {r.internal_id: r.canonical_text for r in L.canonical_text(df).collect()}
    assert got == {1: None, 2: "", 3: "a b", 4: "hey"}


def test_confusables(spark):
    table = L.confusables(spark)
    assert table["օ"] == ("o",) and table["ѵ"] == ("v",) and table["𝐚"] == ("a",) and table["ﬁ"] == ("fi",)
    assert table["І"] == ("I", "l") and table["Ɩ"][0] == "I" and "é" not in table
    to = L.Canonicaliser((), table).text
    assert to("gօօd ѵery 𝐚nd ﬁne") == "good very and fine"


def test_the_vocabulary_chooses_between_looks(spark):
    """A capital that looks like I and l: the trie's word decides, else the table's first choice."""
    table = {"І": ("I", "l")}
    assert L.Canonicaliser({"love": 3}, table).word("Іove") == "love"
    assert L.Canonicaliser({"love": 3, "Iove": 1}, table).word("Іove") == "Iove"  # the first choice before the more frequent
    assert L.Canonicaliser((), table).word("Іove") == "Iove"
    rows = [(1, "so much love here"), (2, "so much Іove here"), (3, "so much love there"), (4, "so much Іlove here"), (5, None)]
    df = spark.createDataFrame(rows, "internal_id long, text string").selectExpr("*", "1 as forms", "2 as _key")
    assert {tuple(r) for r in L.lookalike_pairs(df).collect()} == {(1, 2)}
    got = {r.internal_id: r.canonical_text for r in L.canonical_text(df).collect()}
    assert got == {1: "so much love here", 2: "so much love here", 3: "so much love there", 4: "so much Ilove here", 5: None}
    assert {tuple(r) for r in L.lookalike_members(df).collect()} == {(1, 1, 1), (2, 1, 2)}
