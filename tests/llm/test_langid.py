from emoloom.llm import langid as L

TEXTS = {
    "bn": ["আমি বাজারে গিয়ে মাছ কিনেছি আজ সকালে", "সে খুব ভালো গান করে এবং সবাই শোনে", "আমাদের গ্রামে বৃষ্টি হচ্ছে অনেক দিন ধরে"],
    "as": ["মই বজাৰলৈ গৈ মাছ কিনিলোঁ আজি ৰাতিপুৱা", "তেওঁ বৰ ভাল গান গায় আৰু সকলোৱে শুনে", "আমাৰ গাঁৱত বহুত দিনৰ পৰা বৰষুণ হৈছে"],
    "hi": ["मैं बाजार जाकर मछली खरीदी आज सुबह", "वह बहुत अच्छा गाना गाता है और सब सुनते हैं", "हमारे गांव में बहुत दिन से बारिश हो रही है"],
    "ne": ["म बजार गएर माछा किनेँ आज बिहान", "उनी धेरै राम्रो गीत गाउँछन् र सबैले सुन्छन्", "हाम्रो गाउँमा धेरै दिनदेखि पानी परिरहेको छ"],
    "en": ["I went to the market and bought fish this morning", "she sings very well and everyone listens to her", "it has been raining in our village for many days"],
    "bn-Latn": ["ami bajare giye mach kinechi aj shokale", "she khub bhalo gaan kore ebong shobai shone", "amader grame brishti hocche onek din dhore"],
}


def rows():
    return [(k, t) for k, ts in TEXTS.items() for t in ts for _ in range(4)]


def test_labels():
    cases = {"bn": "bn", "BN": "bn", "bn_IN": "bn", "Bengali": "bn", "bn-Latn": "bn-Latn", "BN-LATN": "bn-Latn", "Banglish": "bn-Latn", "en-US": "en", "hin": "hi", "ne-NP": "ne", "und": None, "mul": None, "zxx": None, "": None, None: None, "-": None, "n/a": None, "hi-Latn": "other"}
    assert {k: L.label_language(k) for k in cases} == cases


def test_label_column_agrees(spark):
    labels = ["bn", "BN ", "bn_IN", "bn-Latn", "hi-Latn", "Banglish", "zxx", "", None, "ne-NP", "English"]
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    assert [r[0] for r in df.select(L.label_column(df.x)).collect()] == [L.label_language((x or "").strip() or None) for x in labels]


def test_texts_and_mixtures():
    m = L.fit(rows())

    def read(t):
        return m.read(m.scores(L.words_of(t)))

    for k, ts in TEXTS.items():
        for t in ts:
            assert [L.LANGUAGES[x] for x, _ in read(t)[0]] == [k]
    found, segments = read(TEXTS["bn"][0] + "। " + TEXTS["en"][0] + ". " + TEXTS["as"][2])
    assert {L.LANGUAGES[k] for k, _ in found} == {"bn", "en", "as"}
    assert [L.LANGUAGES[k] for k, _, _ in segments] == ["bn", "en", "as"]
    assert [L.LANGUAGES[k] for k, _ in read("আমি বাজারে thanks গিয়ে মাছ hero কিনেছি আজ সকালে")[0]] == ["bn"]
    for t in ["", "😂😂 !!"]:
        assert m.read_all([L.words_of(t)]) == [None]


def test_table(spark):
    data = [(k, t, lang) for k, (lang, t) in enumerate(rows())]
    data += [(500, TEXTS["en"][0], "bn"), (501, TEXTS["bn"][0], None), (502, TEXTS["bn"][1], "Bengali"), (503, None, None), (504, "", None), (505, "  ", "en"), (506, "hello my friend", "bn"), (507, TEXTS["bn"][1] + " / " + TEXTS["en"][1], "bn"), (508, "???? ??? ?????? ????", "und"), (509, TEXTS["hi"][2] * 300, "hi")]
    df = spark.createDataFrame(data, "internal_id long, text string, lang string").selectExpr("*", "1 as k", "2 as languages")
    got = {tuple(r) for r in L.mislabelled(df).collect()}
    assert got == {(500, "en"), (501, "bn"), (507, "bn"), (507, "en"), (508, "bn")}
    shown = {r.internal_id: r for r in L.languages(df).collect()}
    assert shown[503].languages == [] and abs(sum(x.confidence for x in shown[507].languages) - 1) < 1e-6 and all(0 <= x.confidence <= 1 for r in shown.values() for x in r.languages)
    assert L.mislabelled(df.limit(0)).collect() == []


def test_rows_without_a_readable_word_stay(spark, tmp_path):
    """Rows without a readable word have a null language, garbled ones the script's guess, both at confidence 0."""
    from emoloom.llm import queries as Q

    rows = [(k, "আমার ভাই খুব ভালো গান গায় আজ", "bn") for k in range(20)] + [(100, None, "bn"), (101, "123 !!!", None), (102, "???? ??? ????? ????", "en")]
    spark.createDataFrame(rows, "internal_id long, text string, lang string").write.parquet(f"{tmp_path}/harmonized_pre_dedup.parquet")
    for query in (Q.p1_languages, Q.p1_segments):
        got = {r.internal_id: (r.lang, r.confidence) for r in query(spark, str(tmp_path)).collect()}
        assert len(got) == 23 and got[100] == got[101] == (None, 0.0) and got[102] == ("bn", 0.0), query
    assert (102, "bn") in {tuple(r) for r in Q.p1_found(spark, str(tmp_path)).collect()}
