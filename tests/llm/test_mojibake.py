import itertools

from emoloom.llm.lookalike import counted
from emoloom.llm.mojibake import BYTES, Channel, from_glyphs, garbled, restored, tables

BN = "আমার ভাই খুব ভালো গান গায় আজ"
COUNTS = dict.fromkeys("আমার ভাই খুব ভালো গান গায় আজ সবাই থেকে বলছি স্টেশন".split(), 5)


def broken(text, name):
    return "".join(bytes([b]).decode(name, "replace") if name != "cp1252" else (bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b)) for b in text.encode())


def test_wrong_decoders():
    c = Channel(COUNTS)
    for name in ("cp1252", "latin-1", "mac_roman", "cp437"):
        assert c.restore(broken(BN, name)) == (BN, True), name
    assert c.restore(broken(broken(BN, "cp1252"), "cp1252")) == (BN, True)
    assert c.restore("It" + broken("’", "cp1252") + "s not fair") == ("It’s not fair", True)
    assert c.restore("so " + broken("😂", "cp1252")) == ("so 😂", True)
    assert c.restore("আমার " + broken("ভাই খুব", "cp1252") + " ভালো") == ("আমার ভাই খুব ভালো", True)


def test_author_s_signs_stay():
    c = Channel(COUNTS)
    for t in ("São Tomé is nice", "Déjà vu, naïve piñata über", "costs £5 – “really”…", "what is this????", "আমার ভাই???? ভালো", "X's 'Story'???? yes", "https://a.example/watch?v=12", "", "  "):
        assert c.restore(t) == (t, False), t


def test_lost_letters():
    c = Channel(COUNTS)
    assert c.restore("আমার স্ট�?�শন থেকে বলছি") == ("আমার স্টেশন থেকে বলছি", True)
    assert c.restore("???? ??? ????? ????")[1] and c.restore("���� ��� ����")[1]


def test_legacy_font():
    assert from_glyphs("Avgvi") == "আমার"
    assert from_glyphs("‡ek") == "বেশ" and from_glyphs("Kwe") == "কবি" and from_glyphs("mnKg©x") == "সহকর্মী" and from_glyphs("ci¨b&Z") == "পর্যন্ত"


def test_tables(spark):
    df = spark.createDataFrame([(1, broken(BN, "cp1252")), (2, BN), (3, None), (4, ""), (5, "???? ??? ????"), (6, "x" * 5000)], "internal_id long, text string").selectExpr("*", "1 as garbled", "'z' as restored_text")
    assert {(r.internal_id, r.restored_text) for r in garbled(df).collect()} == {(1, BN)}  # three words are too few
    got = {r.internal_id: (r.restored_text, r.garbled) for r in restored(df).collect()}
    assert got[1] == (BN, True) and got[2] == (BN, False) and got[3] == (None, False) and got[4] == ("", False)
    assert garbled(df.limit(0)).collect() == []


def test_rare_words_count_too(spark):
    """A lost letter is found by a word that more than 20,000 others exceed."""
    letters = [chr(c) for c in range(0x995, 0x9A9)] + [chr(c) for c in range(0x9AA, 0x9B1)] + list("লশষসহ")
    common = ["".join(w) for w in itertools.islice(itertools.product(letters, repeat=3), 21_000)]
    texts = [" ".join(common[k : k + 100]) for k in range(0, len(common), 100)] * 3
    texts += ["আমার স্টেশন থেকে বলছি", "আমার স্টেশন থেকে বলছি আজ", "আমার স্ট�?�শন থেকে বলছি"]
    df = spark.createDataFrame(list(enumerate(texts)), "internal_id long, text string")
    assert [r.restored_text for r in garbled(df).collect()] == ["আমার স্টেশন থেকে বলছি"]
    counts, weights, fits = tables(df)
    assert fits == {"স্ট�শন": "স্টেশন"}
    whole, asked = Channel(dict(counted(df).collect())), Channel(counts, weights, fits)
    whole._model()
    assert all(abs(asked.pair(a, b) - x) < 1e-5 for a, own in whole.pairs.items() for b, x in own.items())


def test_lost_bytes_under_word_counts():
    """A byte lost from a letter, or its first byte: the most frequent word that fits, among the letters the bytes allow."""
    c = Channel(COUNTS | {"ভালা": 2})
    shown = broken(BN, "cp1252")
    for k in (3, 4, 5, 28, 33):
        if ord(shown[k]) > 127:
            assert c.restore(shown[:k] + "�" + shown[k + 1 :]) == (BN, True), k
    assert c.restore(broken(BN, "cp1251")) == (BN, True)
    for t in ("Міѕѕ уоu аll", "сара’", "это просто текст"):  # look-alikes and Cyrillic words aren't cp1251's bytes
        assert c.decoders(t) == t


def test_viterbi_is_exact():
    """The best path is that of all readings of a short span."""
    c = Channel(COUNTS)
    c._model()
    shown = broken("ভাই", "cp1252")
    for k in range(1, len(shown)):
        lost = shown[:k] + "�" + shown[k + 1 :]
        path = c._viterbi(lost, [BYTES["cp1252"].get(x) for x in lost])
        got = sum(c.pair(a, b) for a, b in zip("^" + "".join(p for p, _ in path), "".join(p for p, _ in path)))
        if len(path) == 3:
            best = max(sum(c.pair(a, b) for a, b in zip("^" + w, w)) for w in ("".join(x) for x in itertools.product(*[o or (p,) for p, o in path])))
            assert abs(got - best) < 1e-9


def test_lost_letters_of_other_scripts():
    """A lost letter is one of the word's own script: no Bangla letter in a Hindi or Latin word."""
    c = Channel(dict.fromkeys("नमस्कार नमक नमकीन नमन".split(), 5) | COUNTS)
    assert c.restore("आज नम�ीला खाना मिला") == ("आज नमकीला खाना मिला", True)
    assert c.restore("they don�t want any") == ("they don�t want any", True)
    c = Channel(dict.fromkeys("café cafés".split(), 5) | COUNTS)
    assert c.restore("the caf�teria was closed") == ("the caféteria was closed", True)
