import pytest

from emoloom.llm import pii as P


@pytest.fixture()
def finder():
    return P.Finder({"তানভীন", "tanveen", "সাগর"}, {"মিরধান", "mirdhan"}, {"<নাম:": 0.9, ";>": 0.9}, {"xid": 0.9}, {"সাগর"})


def types(f, t):
    return sorted({k for *_, k in f.spans(t)})


def test_each_type(finder):
    for t in ("write to a.b+c@x.example.org now", "a_1 [at] chithi [dot] test ok", "মেইল abc অ্যাট box ডট example ডট net এ", "x92＠dakghar.example ok ok"):
        assert types(finder, t) == ["email"], t
    for t in ("call +880 1245-659 163 ok", "কল ০১২ ৬০৫৮ ৭৭৮১ এ", "(012) 5860.7315 তে ফোন", "008801223025686", "+৮৮০১০৫১৭৬৫১৩১", "01202-372002"):
        assert types(finder, t) == ["phone"], t
    for t in ("NID: 989 913 0720 lost", "পাসপোর্ট BX০৮৫৪৪৭০ দিয়ে", "জন্মসনদ নং 19072728278562005", "ভোটার আইডি 9598361539656", "my xid 1234567890"):
        assert types(finder, t) == ["id_number"], t
    for t in ("বাসা ১৭৪, রোড ২১, ব্লক E, কদমপুর এ", "House 51, Road 28, Block C, Bhatipur", "গ্রাম: সোনাপুর, ডাকঘর: বেতপুর, উপজেলা: কাশিহাট", "203/16 চন্দপুর লেন, শালিচর-১৬৬৬", "Flat 12F, 24 Dhulipur Street, Pakhihat", "HOUSE 5, ROAD 2, BLOCK C, BHATIPUR", "holding 35, Modhupur Sarak, ward 23, Horinghata"):
        assert types(finder, t) == ["address"], t
    for t in ("তানভীন মিরধান এসেছে", "Mr. Tanveen Mirdhan helped", "DR. TANVEEN MIRDHAN HELPED US"):
        assert types(finder, t) == ["name"], t


def test_what_isnt_personal(finder):
    for t in ("order no 715052983687 never came", "ভিউ হয়েছে 3403294", "TRK-36-7899", "https://video.example/watch?v=170666963", "@tara_vlogs কে ধন্যবাদ", "26/08/2023 তারিখের", "হটলাইন ৯৯৯", "স্কোর 391/2 ওভার ২০", "বাস রোড ব্লক করে রেখেছে 7 ঘণ্টা", "house full on road trip day 4", "আলো কম ছিল, সাগর দেখা যায়নি", "see minute 62:37", "it cost 69546", "", "  "):
        assert types(finder, t) == [], t


def test_masking_keeps_the_rest(finder):
    t = "নাম: তানভীন মির​ধান; ফোন ০১২ ৬০৫৮ ৭৭৮১। ধন্যবাদ য়"
    assert finder.masked(t) == "নাম: [NAME]; ফোন [PHONE]। ধন্যবাদ য়"
    assert finder.masked("কিছু নেই") == "কিছু নেই"


def test_unseen_names_are_learned(spark):
    known = [("তানভীন", "মিরধান"), ("রুশমিলা", "সরখেলী"), ("আরিবুল", "মিরধান"), ("তানভীন", "সরখেলী")]
    rows = []
    for k in range(60):
        g, f = known[k % 4]
        rows.append(f"নাম: {g} {f}; মতামত: ভালো লাগল")
    rows += ["নাম: তানভীন দেওয়ানিক; মতামত: বেশ", "নাম: রুশমিলা দেওয়ানিক; মতামত: বেশ ভালো"] * 3
    rows += ["আলো কম ছিল আজ রাতে", "আজ আলো নিয়ে কথা হলো", "কবিতা আর আলো এত ভালো"] * 10
    rows += ["ওই দেওয়ানিক রুশমিলা নয়", "কাল রুশমিলা দেওয়ানিক এসেছিল"]
    data = list(enumerate(rows)) + [(900, None), (901, ""), (902, " "), (903, "ফোন 01202372002"), (904, "ফোন 01202372002 এ কর")]
    df = spark.createDataFrame(data, "internal_id long, text string").selectExpr("*", "'n' as kind", "1 as patterns")
    gaz = spark.createDataFrame([(w, "given_name", "Beng") for w in ("তানভীন", "রুশমিলা", "আরিবুল", "আলো")] + [(w, "family_name", "Beng") for w in ("মিরধান", "সরখেলী")] + [(None, "family_name", None)], "entry string, kind string, script string")
    own, _, _ = P.finder(df, gaz)
    assert "দেওয়ানিক" in own.family and "কম" not in own.family and "আলো" in own.ordinary
    got = {(r.internal_id, r.pii_type) for r in P.found(df, gaz).collect()}
    assert {i for i, k in got if k == "name"} == set(range(66)) | {97} and (904, "phone") in got and (903, "phone") not in got
    masked = {r.internal_id: r.masked_text for r in P.masked(df, gaz).collect()}
    assert masked[97] == "কাল [NAME] এসেছিল" and masked[900] is None and masked[901] == ""
    assert P.found(df.limit(0), gaz).collect() == []


def test_rare_names_and_patterns_count_in_large_tables(spark, monkeypatch):
    """What is found doesn't depend on how many other instances the table has."""
    known = [("তানভীন", "মিরধান"), ("রুশমিলা", "সরখেলী")]
    rows = ["নাম: %s %s; মতামত: ভালো লাগল" % known[k % 2] for k in range(40)]
    rows += ["নাম: তানভীন দেওয়ানিক; মতামত: বেশ ভালো", "কাল তানভীন দেওয়ানিক এসেছিল", "আমার নথি নং 9598361539 হারিয়েছে", "কাল নথি নং 9598361540 হারিয়েছে"]
    rows += ["my nid 9598361539 নথি নং 9598361541 lost"] * 3
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "internal_id long, text string")
    gaz = spark.createDataFrame([(w, "given_name") for w in ("তানভীন", "রুশমিলা")] + [(w, "family_name") for w in ("মিরধান", "সরখেলী")], "entry string, kind string")
    small, table, _ = P.finder(df, gaz)
    instances = P.instances
    # the same graph beside very many instances of other names and numbers
    def more(*a):
        one = instances(*a)
        other = spark.createDataFrame([("name", "তানভীন", f"মিরধান{k}", 1, [f"<x{k}"], 400_000) for k in range(3)] + [("number", "9", "", 0, [f"y{k}"], 400_000) for k in range(3)], "kind string, a string, b string, known int, patterns array<string>, n long")
        return one.unionByName(other)

    monkeypatch.setattr(P, "instances", more)
    large = P.finder(df, gaz)[0]
    rare = {r.pattern for r in table.where("kind = 'name' and confidence >= 0.7 and 3 <= n and n < 10").collect()}
    assert small.names and "দেওয়ানিক" in small.family
    assert set(small.names) == set(large.names) and small.ids.keys() == large.ids.keys() and rare <= set(large.names)
