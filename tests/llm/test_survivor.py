import datetime
import itertools
import random

from pyspark.sql import functions as F

from emoloom.llm import survivor as S


def rows_of(spark, rows):
    ddl = "internal_id long, text string, source_dataset string, source_split string, source_row_id long, domain string, topic string, " + ", ".join(f"{c} int" for c in S.LABELS) + ", original_class string, original_love long, original_contempt long, original_enjoyment long, ingested_at timestamp_ntz"
    full = [(i, t, ds, sp, r, dom, top, 0, 0, 0, 1, 0, 0, None, None, None, None, None) for i, t, ds, sp, r, dom, top in rows]
    return spark.createDataFrame(full, ddl)


def test_search_is_the_best_of_all_choices():
    rng = random.Random(2)
    for _ in range(200):
        options = {k: [(rng.randrange(100), n, rng.choice("ABC"), f"{k}{n}") for n in range(rng.randrange(0, 4))] for k in S.KINDS}
        best = float("-inf")
        for combo in itertools.product(*([o for o in options[k]] or [None] for k in S.KINDS)):
            a, b = combo[0], combo[1]
            if a and b and a[2] != b[2]:
                continue
            best = max(best, sum(o[0] for o in combo if o))
        got = S.search(options)
        if best > float("-inf"):
            assert sum(o[0] for o in got.values()) == best
        else:
            assert got == {}


def test_domains(spark):
    rows = [
        (1, "aa bb cc dd", "EmoNoBa", "Train", 1, None, None), (2, "aa bb cc dd!", "EmoNoBa", "Train", 1, " youtube ", "x"), (3, "AA bb cc dd", "UBMEC", "NONE", 9, "nan", None),
        (4, "ee ff gg hh", "EmoNoBa", "Val", 2, "Facebook", None), (5, "ee ff gg hh.", "EmoNoBa", "Val", 2, "Twitter", None), (6, "ee ff gg hh", None, None, None, "", None),
        (7, "ii jj kk ll", "EmoNoBa", "Val", 2, "Facebook", None), (8, "ii jj kk ll", "EmoNoBa", "Val", 2, "FACEBOOK", None), (9, "alone text is here", "EmoNoBa", "Val", 2, None, None), (10, None, None, None, None, None, None),
    ]
    df = rows_of(spark, rows)
    assert {tuple(r) for r in S.completed_domains(df).collect()} == {(1, "Youtube")}
    best = {r.keeper_id: r for r in S.survivors(df).collect()}
    assert set(best) == {1, 4, 7} and best[1].copies == 3 and best[1].topic == "x" and best[1].source_dataset == "EmoNoBa" and best[7].domain == "Facebook"
    assert S.survivors(df.limit(0)).collect() == []


def test_agreement_has_no_cap(spark):
    """Of two origins and topics in a hot group that of more rows wins, though both have many and the other is newer."""
    many = spark.range(21_000).selectExpr(
        "id as keeper", "id as internal_id", "'EmoNoBa' as source_dataset", "'Train' as source_split", "id % 5 < 2 as few", "timestamp_ntz'2024-01-01 00:00:00' as old", "timestamp_ntz'2024-06-01 00:00:00' as new"
    ).selectExpr("0L as keeper_id", "internal_id", "source_dataset", "source_split", "if(few, 2L, 1L) as source_row_id", "'Facebook' as domain", "if(few, 'few', 'many') as topic", *(f"0 as {c}" for c in S.LABELS),
        "'x' as original_class", "0L as original_love", "0L as original_contempt", "0L as original_enjoyment", "if(few, new, old) as ingested_at")
    best = S.choices(S.candidates(many)).first()
    assert '"many"' in best.topic and '"source_row_id":1' in best.origin


def test_all_columns_survive(spark):
    """Text, language, thread, times and flags come out too, the flags with the labels of the origin's dataset."""
    more = "lang string, thread_key string, commented_at timestamp_ntz, emonoba_disgust_assumption boolean, f5_eligible boolean"
    df = rows_of(spark, [(1, "aa bb cc dd", "UBMEC", None, 9, None, None), (2, "aa bb cc dd!", "EmoNoBa", "Train", 1, None, "x"), (3, "aa bb cc dd!", "EmoNoBa", "Train", 1, None, "x")])
    flags = spark.createDataFrame([(1, None, None, None, False, False), (2, "bn", "t1", None, True, False), (3, "bn", "t1", None, True, False)], "internal_id long, " + more)
    df = df.join(flags, "internal_id").withColumns({c: F.expr("timestamp_ntz'2024-01-01 10:00:00.123456'") for c in ("commented_at", "ingested_at")})
    [r] = S.survivors(df).collect()
    assert set(df.columns) - {"internal_id"} <= set(r.asDict())
    assert (r.text, r.lang, r.thread_key, r.emonoba_disgust_assumption, r.f5_eligible, r.source_dataset) == ("aa bb cc dd!", "bn", "t1", True, False, "EmoNoBa")
    assert r.commented_at == r.ingested_at == datetime.datetime(2024, 1, 1, 10, 0, 0, 123456)


def test_dependencies_across_bundles():
    """Place and topic follow the origin's dataset and the domain, though others score higher."""
    options = {
        "origin": [(90, 1, "A", "a"), (10, 2, "B", "b")], "labels": [(50, 1, "A", "a"), (60, 2, "B", "b")],
        "place": [(5, 1, "A", "fb", "Facebook"), (9, 2, "B", "yt", "Youtube")], "topic": [(7, 2, "B", "music", "Youtube"), (6, 3, "B", "news", "Facebook"), (1, 1, "A", "none", None)],
    }
    got = {k: o[3] for k, o in S.search(options).items()}
    assert got == {"origin": "a", "labels": "a", "place": "fb", "topic": "news"}
    options["place"] = [(0, 1, "A", "null", None), (9, 2, "B", "yt", "Youtube")]  # the origin's dataset knows none: another's may serve
    got = {k: o[3] for k, o in S.search(options).items()}
    assert got["place"] == "yt" and got["topic"] == "music"


def test_trust_is_learned(spark):
    rows = [(g, "labels", d, v, 1, n) for g in range(20) for d, v, n in (("A", "x", 3), ("B", "x", 1), ("C", "y" if g < 15 else "x", 1))]
    same = spark.createDataFrame(rows, "keeper_id long, kind string, dataset string, value string, complete int, n long")
    assert {r.dataset: r.trust for r in S.trusts(same).collect()} == {"A": 10, "B": 10, "C": 2}
