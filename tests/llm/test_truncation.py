from emoloom.llm import truncation as T


def test_cut_texts(spark):
    whole = [f"আজ সকালে {p} থেকে বলছি, গানটা খুব সুন্দর লাগল। সবাই {p} নিয়ে ব্যস্ত, অথচ কেউ কিছু বলে না।" for p in ("ঢাকা", "খুলনা", "বরিশাল", "সিলেট", "যশোর", "পাবনা")] * 3
    rows = [(k, "a", t) for k, t in enumerate(whole)]
    cases = {
        100: "আজ সকালে ঢাকা থেকে বলছি, গানটা খুব", 101: "আজ সকালে ঢাকা থেকে বলছি, গানটা খুব সুন্দর লাগ", 102: "আজ সকালে ঢাকা থেকে বলছি, গানটা খু�", 103: "আজ সকালে ঢাকা থেকে বলছি, গানটা... আরও পড়ুন",
        104: "আজ সকালে ঢাকা থেকে বলছি,", 105: "আজ সকালে ঢাকা থেকে বলছি, গানটা খুব… read more",
    }
    fine = {
        200: "আজ সকালে ঢাকা থেকে বলছি, গানটা খুব সুন্দর লাগল", 201: "আজ সকালে ঢাকা থেকে বলছি, গানটা খুব সুন্দর লাগল...", 202: "আজ সকালে ঢাকা থেকে বলছি, গানটা খুব সুন্দর 😂😂", 203: "আজ সকালে ঢাকা থেকে বলছি, গানটা দারুণ #মেলা",
        204: "বাহ", 205: "আজ সকালে ঢাকা থেকে বলছি https://a.example/x", 206: "আজ সকালে ঢাকা থেকে বলছি, গানটা দারুণ!\n", 207: None, 208: "", 209: " \n ", 210: "আজ সকালে ঢাকা থেকে বলছি, গানটা খুব সুন্দর লাগল… ", 211: "শব্দ " * 9000 + "লাগল।",
    }
    rows += [(i, "b", t) for i, t in (cases | fine).items()]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as id", "2 as t", "3 as cut")
    got = T.truncated(df).collect()
    assert {r.id for r in got if r.cut} == set(cases)
    rates = {r.source: r for r in T.rates(T.truncated(df)).collect()}
    assert rates["a"].cut == 0 and rates["b"].cut == len(cases)
    assert T.truncated(df.limit(0)).collect() == []


def test_short_texts(spark):
    """Texts of three words or fewer are cut where counts tell it; stock phrases aren't."""
    rows = [f"আজ {p} এলাকার কুকুর খুব সুন্দর লাগল। nice video ta, {p} গিয়েছি।" for p in ("ঢাকা", "খুলনা", "বরিশাল", "সিলেট", "যশোর", "পাবনা")] * 3
    cases = {100: "ঢাকা এলাকার কুকু", 101: "এলাকার কুকুর খুব", 102: "খুল"}
    fine = {200: "সুন্দর লাগল", 201: "nice video", 202: "nice video", 203: "বাহ", 204: "খুব সুন্দর লাগল", **{k: "first comment" for k in range(205, 210)}}
    df = spark.createDataFrame([(k, "a", t) for k, t in enumerate(rows)] + [(k, "b", t) for k, t in (cases | fine).items()], "doc_id long, source string, text string")
    assert {r.id for r in T.truncated(df).collect() if r.cut} - set(range(100)) == set(cases)
