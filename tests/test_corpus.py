import pytest
from pyspark.sql import functions as F

from emoloom.functions import text as T
from emoloom.operators import audit, dedup, harmonise, sets, splitting
from emoloom.schema import LABELS

DDL = "internal_id long, source_dataset string, source_split string, source_row_id long, text string, domain string, topic string, " + ", ".join(f"{c} int" for c in LABELS)


def table(spark, rows):
    """(id, dataset, split, row id, text, domain, joy)"""
    return spark.createDataFrame([(i, ds, sp, r, t, dom, None, 0, 0, 0, joy, 0, 0) for i, ds, sp, r, t, dom, joy in rows], DDL)


def annotated(df):
    return dedup.annotated(df, T.comparison_key(F.col("text")))


def test_group_types(spark):
    rows = [
        (1, "EmoNoBa", "Train", 1, "a", None, 1), (2, "EmoNoBa", "Train", 2, "a ", None, 1),  # A
        (3, "EmoNoBa", "Train", 3, "b", None, 1), (4, "EmoNoBa", "Train", 4, "b", None, 0),  # B
        (5, "EmoNoBa", "Train", 5, "c", None, 1), (6, "UBMEC", "NONE", 1, "c", None, 1),  # C
        (7, "EmoNoBa", "Train", 6, "d", None, 1), (8, "MONOVAB", "NONE", 1, "d", None, 0),  # D
        (9, "EmoNoBa", "Train", 7, "e", None, 1), (10, "EmoNoBa", "Val", 8, "e", None, 1),  # E
        (11, "EmoNoBa", "Train", 9, "f", None, 1), (12, "EmoNoBa", "Val", 10, "f", None, 0),  # E+B
        (13, "EmoNoBa", "Train", 11, "g", None, 1), (14, "EmoNoBa", "Val", 12, "g", None, 1), (15, "UBMEC", "NONE", 2, "g", None, 1),  # E+C
        (16, "EmoNoBa", "Train", 13, "h", None, 1), (17, "EmoNoBa", "Test", 14, "h", None, 1), (18, "UBMEC", "NONE", 3, "h", None, 0),  # E+D
        (19, "UBMEC", "NONE", 4, "alone", None, 1), (20, "UBMEC", "NONE", None, None, None, 1), (21, None, None, None, "", None, 1),
    ]
    got = {r.internal_id: r for r in annotated(table(spark, rows)).collect()}
    assert [got[i].group_type for i in (1, 3, 5, 7, 9, 11, 13, 16)] == ["A", "B", "C", "D", "E", "E+B", "E+C", "E+D"]
    assert got[19].action == "KEPT_AS_IS" and got[19].group_type is None
    assert {got[i].action for i in (3, 4, 7, 8, 11, 12, 16, 17, 18)} == {"RETAINED_UNRESOLVED"}
    assert got[1].action == "CANONICAL_KEPT" and got[2].action == "COLLAPSED_INTO_CANONICAL"
    books = dedup.accounting(annotated(table(spark, rows))).first()
    assert books.balanced and books.rows_in == len(rows)
    left = dedup.without_conflicts(table(spark, rows), annotated(table(spark, rows)), T.comparison_key(F.col("text")))
    assert {r.internal_id for r in left.collect()} == {1, 2, 5, 6, 9, 10, 13, 14, 15, 19, 20, 21}


def test_canonical_order(spark):
    rows = [
        (1, "UBMEC", "NONE", 1, "a", "x", 1), (2, "EmoNoBa", "Train", 9, "a", None, 1),  # metadata first
        (3, "MONOVAB", "NONE", 1, "b", None, 1), (4, "EmoNoBa", "Test", 1, "b", "nan", 1), (5, "EmoNoBa", "Train", 5, "b", " ", 1),  # then dataset and split
        (6, "EmoNoBa", "Train", None, "c", None, 1), (7, "EmoNoBa", "Train", 3, "c", None, 1), (8, "EmoNoBa", "Train", 3, "c", None, 1),  # then row id, then id
    ]
    best = {r.internal_id for r in annotated(table(spark, rows)).where("is_canonical").collect()}
    assert best == {1, 5, 7}
    assert [r.internal_id for r in dedup.in_order(table(spark, rows)).collect()] == [7, 8, 5, 2, 6, 4, 1, 3]
    assert {r.internal_id for r in dedup.keep_first(table(spark, rows), T.simple_key(F.col("text")), "internal_id").collect()} == {1, 3, 6}


def test_empty_table(spark):
    df = table(spark, [(1, None, None, None, None, None, None)]).limit(0)
    assert annotated(df).collect() == [] and dedup.groups(annotated(df)).collect() == [] and audit.text_audit(df).first().total == 0


def test_harmonised_sources(spark):
    multi = spark.createDataFrame([(1, "x", 1, 0, 0, 0, 0, 0, "t", "d"), (2, "y", 1, 1, 0, 0, 0, 0, "t", "d"), (3, None, None, 0, 0, 0, 0, 0, None, None)], "ID long, Data string, Love long, Joy long, Surprise long, Anger long, Sadness long, Fear long, Topic string, Domain string")
    source = harmonise.multi_label(split=F.lit("Train"))
    got = harmonise.harmonised(multi, source).collect()
    assert [r.source_row_id for r in got] == [2, 3] and got[0].disgust == 0 and got[0].emonoba_disgust_assumption and got[0].original_love == 1
    assert [r.source_row_id for r in harmonise.reincluded(multi, source).collect()] == [1]
    single = spark.createDataFrame([(1, "x", " JOY "), (2, "y", "calm"), (3, "z", None), (4, "w", "")], "row_no long, text string, classes string")
    rows = harmonise.harmonised(single, harmonise.single_label()).collect()
    assert [(r.source_row_id, r.joy, r.anger) for r in rows] == [(1, 1, 0)]
    log = {(r.rule): r.affected for r in harmonise.transformation_log(harmonise.manifest(single, harmonise.single_label())).collect()}
    assert log == {"mapped": 1, "unknown_class": 3}
    seven = spark.createDataFrame([(1, "x", 0, 1, 0, 0, 0, 0, 0), (2, "y", 0, 1, 0, 1, 0, 0, 0)], "`Unnamed: 0` long, comment string, anger long, contempt long, disgust long, enjoyment long, fear long, sadness long, surprise long")
    rows = harmonise.harmonised(seven, harmonise.seven_label()).collect()
    assert [(r.source_row_id, r.joy, r.original_contempt) for r in rows] == [(2, 1, 1)]
    both = harmonise.ordered_columns(harmonise.union_all(harmonise.harmonised(multi, source), harmonise.harmonised(seven, harmonise.seven_label())))
    assert both.count() == 3 and len(both.columns) == 18
    ids = harmonise.sample_ids(both.unionByName(both)).select("sample_id").collect()
    assert len({r[0] for r in ids}) == 6


def test_sets(spark):
    def one(*xs):
        return spark.createDataFrame([(x,) for x in xs], "x string")

    texts = {"a": one("1", "2", "2", None), "b": one("2", "3"), "c": one("2", "1", "4")}
    assert {r.sets: r.n for r in sets.overlap_counts(texts).collect()} == {"a&b": 1, "a&c": 2, "b&c": 1, "a&b&c": 1}
    assert tuple(sets.union_counts(texts).first()) == (4, 3)
    assert sets.lost(texts["a"], texts["a"]).collect() == []
    assert {(r.x, r.side) for r in sets.lost(texts["a"], texts["b"]).collect()} == {("1", "before"), ("2", "before"), (None, "before"), ("3", "after")}
    nested = spark.createDataFrame([("g", "1|2", "a|b")], "g string, i string, s string")
    assert [tuple(r) for r in sets.unnested(nested, ["i", "s"]).collect()] == [("g", "1", "a"), ("g", "2", "b")]


def test_splits(spark):
    rows = [(i, "EmoNoBa", "Train", i, "t", None, i % 2) for i in range(1000)]
    df = splitting.stratified_split(table(spark, rows), "internal_id")
    counts = {(r.split, r.joy): r["count"] for r in df.groupBy("split", "joy").count().collect()}
    assert counts == {("train", 0): 350, ("train", 1): 350, ("val", 0): 75, ("val", 1): 75, ("test", 0): 75, ("test", 1): 75}
    again = {r.internal_id: r.split for r in splitting.stratified_split(table(spark, rows).repartition(7), "internal_id").collect()}
    assert again == {r.internal_id: r.split for r in df.collect()}
    passed = {r.check: r.passed for r in splitting.split_checks(df, "internal_id", ("joy",)).collect()}
    assert all(passed.values())
    assert {r.split: r["count"] for r in splitting.random_split(table(spark, rows), "internal_id").groupBy("split").count().collect()} == {"train": 700, "val": 150, "test": 150}


def test_oversampling_and_weights(spark):
    rows = [(i, "EmoNoBa", "Train", i, "t", None, int(i < 10)) for i in range(100)]
    df = table(spark, rows).withColumn("fear", (F.col("internal_id") >= 90).cast("int"))
    assert splitting.oversampled(df, "internal_id", {"joy": 2}).count() == 110
    assert splitting.oversampled(df, "internal_id", {"joy": 2, "fear": 2}).count() == 120
    assert splitting.oversampled(df, "internal_id", {"joy": 1.5}).count() == 105
    w = {r.joy: r.w for r in df.select("joy", splitting.sample_weight({"joy": 2}).alias("w")).distinct().collect()}
    assert w == {0: 1.0, 1: 2.0}
    both = df.where("internal_id = 5").withColumn("fear", F.lit(1)).select(splitting.sample_weight({"joy": 2, "fear": 3})).first()[0]
    assert both == 3.0
    weights = {r.label: (r.weight_0, r.weight_1) for r in splitting.class_weights(df, ("joy", "anger")).collect()}
    assert weights["joy"] == (round(100 / 180, 6), 5.0) and weights["anger"][1] is None


def test_label_orders(spark):
    rows = [(i, "EmoNoBa", "Train", i, "t", None, 1) for i in range(5)]
    df = table(spark, rows).withColumn("fear", F.lit(1)).withColumn("anger", F.when(F.col("internal_id") < 2, 1).otherwise(0))
    order = [r.label for r in audit.label_order(df).orderBy("place").collect()]
    assert order == ["joy", "fear", "anger", "surprise", "sadness", "disgust"]
    assert audit.greedy_label_order(df) == ["joy", "fear", "anger", "disgust", "sadness", "surprise"]
    assert audit.run_summary(spark.createDataFrame([(0.51,), (0.52,), (0.53,)], "m double"), ["m"]).first()[1:3] == (0.52, 0.01)
    assert audit.run_summary(spark.createDataFrame([(0.51,)], "m double"), ["m"]).first()["std"] == 0.0


@pytest.mark.parametrize("rule,violations", [("text_present", 1), ("binary_joy", 1)])
def test_checks(spark, rule, violations):
    df = table(spark, [(1, "EmoNoBa", "Train", 1, None, None, 2), (2, "EmoNoBa", "Train", 2, "x", None, 1)]).withColumn("emonoba_disgust_assumption", F.lit(True))
    got = {r.check: r for r in audit.checks(df, audit.harmonised_rules()).collect()}
    assert got[rule].violations == violations and not got[rule].passed and got["assumption_flagged"].passed
