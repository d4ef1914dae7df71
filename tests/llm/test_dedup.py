import random

from emoloom.llm import dedup as D


def brute(rows):
    keys = {}
    for i, t in rows:
        if D.is_case(t):
            keys.setdefault(D.Keys().key(t), []).append(i)
    return {(min(v), i) for v in keys.values() for i in v if i != min(v)}


def test_key_disregards_format_only():
    key = D.Keys().key
    assert key("Hello, World  a b") == key("hello world (A) b!!") == key("hellowоrld ab")
    assert key("a b c 😀") != key("a b c")
    assert key("a b c 1") != key("a b c ১")


def test_field_order():
    key = D.Keys().key
    a, b = "নাম: ক খ\nমোবাইল: 017\nমতামত: ভাল, খুব ভাল", "মতামত: ভাল; খুব ভাল | নাম: ক খ | মোবাইল: 017"
    assert key(a) == key(b)
    assert key("a: 1; b: 2") != key("b: 2; a: 1")  # two fields aren't enough
    assert D.fields("see https://x.example/a:b:c") is None


def test_members_against_brute_force(spark):
    rng = random.Random(5)
    words = ["ভাল", "দিন", "good", "day", "কথা", "x"]
    rows = [(k, rng.choice(["", " ", "  "]).join([""]) + " ".join(rng.choice(words) for _ in range(rng.randrange(3, 6))) + rng.choice(["", "!", " ..", "।"])) for k in range(400)]
    rows += [(400 + k, "one hot text here" + "!" * (k % 3)) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "?? !! .. ,,"), (1004, "word " * 4000), (1005, "WORD " * 4000)]
    df = spark.createDataFrame(rows, "internal_id long, text string").selectExpr("*", "'k' as key", "1 as ids", "2 as keeper", "3 as bucket").repartition(5)
    want = brute(rows)
    for limit in (50_000, 7, 2):  # one bucket; buckets split; hot keys alone
        assert {tuple(r) for r in D.members(df, bucket_limit=limit).collect()} == want
        counts = {}
        for k, _ in want:
            counts[k] = counts.get(k, 1) + 1
        assert {tuple(r) for r in D.copies(df, bucket_limit=limit).collect()} == set(counts.items())


def test_empty_table(spark):
    df = spark.createDataFrame([], "internal_id long, text string")
    assert D.members(df).collect() == [] and D.copies(df).collect() == []


def test_trie():
    t = D.CopyTrie()
    for k, key in enumerate([b"", b"a" * 40, b"a" * 41, b"a" * 40, b"a" * 16, b"b", b""]):
        t.add(key, [k])
    assert sorted((k, v) for k, v in t.groups()) == [(b"", [0, 6]), (b"a" * 16, [4]), (b"a" * 40, [1, 3]), (b"a" * 41, [2]), (b"b", [5])]


def test_a_key_of_nearly_all_rows(spark):
    """One key holds nine tenths of the rows: no list of its ids is gathered, and the limit counts ids, not entries."""
    rows = [(k, "one hot text here") for k in range(9000)] + [(9000 + k, f"one other text {k % 500}") for k in range(1000)]
    df = spark.createDataFrame(rows, "internal_id long, text string").repartition(3)
    table = D.entries(df)
    assert table.where("key = cast('onehottexthere' as binary)").count() < 20  # few entries of many ids
    levels = D.splits(table, 1000)
    assert [r.single for _, big in levels for r in big.where("single").collect()] == [True]
    got = D.members(df, bucket_limit=1000)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert {r.copies for r in D.copies(df, bucket_limit=1000).collect()} == {9000, 2}
