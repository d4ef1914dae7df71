import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from emoloom.operators import metrics, models, thresholds
from emoloom.schema import LABELS

L2 = ("a", "b")


def predictions(spark, y, p, prob=None, labels=L2):
    names = [f"true_{c}" for c in labels] + [f"pred_{c}" for c in labels] + [f"prob_{c}" for c in labels]
    prob = prob or [[float(x) for x in r] for r in p]
    return spark.createDataFrame([(*a, *b, *c) for a, b, c in zip(y, p, prob)], ", ".join(f"{n} {'double' if n.startswith('prob') else 'int'}" for n in names))


def test_metrics_of_extremes(spark):
    y = [[1, 0], [0, 1], [0, 0]]
    good = metrics.overall(predictions(spark, y, y), labels=L2).first()
    assert good.macro_f1 == good.micro_f1 == good.subset_accuracy == 1.0 and good.hamming_loss == 0.0 and good.jaccard == round(2 / 3, 4)
    none = metrics.overall(predictions(spark, y, [[0, 0]] * 3), labels=L2).first()
    assert none.macro_f1 == 0.0 and none.micro_f1 == 0.0 and none.hamming_loss == round(2 / 6, 6)


def test_metrics_against_counts(spark):
    rng = random.Random(3)
    y, p = ([[rng.randrange(2) for _ in LABELS] for _ in range(200)] for _ in "yp")
    df = predictions(spark, y, p, labels=LABELS)
    for k, r in enumerate(sorted(metrics.per_label(df).collect(), key=lambda r: LABELS.index(r.label))):
        tp = sum(a[k] & b[k] for a, b in zip(y, p))
        fp, fn = sum(b[k] > a[k] for a, b in zip(y, p)), sum(a[k] > b[k] for a, b in zip(y, p))
        assert (r.tp, r.fp, r.fn) == (tp, fp, fn) and r.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn), abs=1e-4)


def test_confusion_pairs(spark):
    got = {(r.kind, r.a, r.b): r.n for r in metrics.confusion_pairs(predictions(spark, [[1, 0], [0, 1], [1, 1]], [[0, 1], [0, 1], [1, 0]]), L2).collect()}
    assert got == {("cooccurrence", "a", "b"): 1, ("cooccurrence", "b", "a"): 1, ("false_positive", "b", "a"): 1}


def test_errors_and_sensitivity(spark):
    y, p = [[0, 0]] * 8 + [[1, 0]] * 12, [[1, 0]] * 5 + [[0, 0]] * 3 + [[0, 0]] * 3 + [[1, 0]] * 9
    df = predictions(spark, y, p).withColumn("i", F.monotonically_increasing_id())
    s = metrics.error_summary(df, "a", {"all": F.lit(True), "none": F.lit(False)}).where("pattern = 'all'").first()
    assert (s.fp, s.fn, s.fp_pct) == (5, 3, 100.0)
    flagged = predictions(spark, [[1, 0]] * 20, [[1, 0]] * 10 + [[0, 0]] * 10).withColumn("f", F.when(F.col("pred_a") == 1, F.lit("True")).otherwise(F.lit("0")))
    got = {r.flagged: (r.n, r.f1) for r in metrics.flag_sensitivity(flagged, F.col("f"), "a").collect()}
    assert got == {True: (10, 1.0), False: (10, 0.0)}


def brute(prob, y, taus):
    out = []
    for t in taus:
        tp = sum(a >= t and b for a, b in zip(prob, y))
        fp = sum(a >= t and not b for a, b in zip(prob, y))
        fn = sum(a < t and b for a, b in zip(prob, y))
        out.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    return out


@pytest.mark.parametrize("step", [0.01, 0.005, 0.001])
def test_sweep_against_brute_force(spark, step):
    rng = random.Random(4)
    taus = thresholds.grid(step)
    prob = [[rng.choice([rng.random(), rng.choice(taus), 0.0, 1.0, 0.05, 0.95]) for _ in L2] for _ in range(100)]
    y = [[int(x > 0.5), 0] for x, _ in prob]
    df = predictions(spark, y, y, prob)
    curve = thresholds.curve(df, step, L2).collect()
    for k, c in enumerate(L2):
        got = [r.f1 for r in sorted((r for r in curve if r.label == c), key=lambda r: r.tau)]
        assert got == pytest.approx(brute([p[k] for p in prob], [r[k] for r in y], taus))
    assert len(taus) == {0.01: 91, 0.005: 181, 0.001: 905}[step]
    best = {r.label: r.tau for r in thresholds.best(thresholds.curve(df, step, L2), 0.5).collect()}
    assert best["b"] == 0.5 and {r.label: r.tau for r in thresholds.best(thresholds.curve(df, step, L2)).collect()}["b"] == 0.05


def test_apply_and_blend(spark):
    p = [[0.2, 0.4, 0.6, 0.8, 0.1, 0.5], [0.3, 0.2, 0.7, 0.4, 0.9, 0.1]]
    taus = dict(zip(LABELS, [0.25, 0.35, 0.55, 0.5, 0.5, 0.4]))
    df = spark.createDataFrame(p, ", ".join(f"prob_{c} double" for c in LABELS))
    got = [tuple(r) for r in thresholds.applied(df, taus).select(*(f"pred_{c}" for c in LABELS)).collect()]
    assert got == [(0, 1, 1, 1, 0, 1), (1, 0, 1, 0, 1, 0)]
    two = spark.createDataFrame([(0.8, 0.2, 0.2, 0.6), (0.4, 0.6, 0.8, 0.4)], "x_a double, x_b double, y_a double, y_b double")
    assert [tuple(round(v, 6) for v in r) for r in thresholds.blended(two, "x", "y", 0.7, L2).select("prob_a", "prob_b").collect()] == [(0.62, 0.32), (0.52, 0.54)]
    assert thresholds.raised({"a": 0.5, "b": 0.88}, {"a": 0.05, "b": 0.05}) == {"a": 0.55, "b": 0.9}


def test_regression_guard(spark):
    old = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "label string, f1 double")
    new = spark.createDataFrame([("a", 0.49), ("b", 0.4899), ("c", 0.6)], "label string, f1 double")
    assert {r.label: r.rejected for r in metrics.regressions(old, new).collect()} == {"a": False, "b": True, "c": False}


def test_chain(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        x, z = rng.random(), rng.random()
        a, b = int(x > 0.5), int(x > 0.5 and z > 0.5)
        rows.append((i, a, b, 0, Vectors.dense(x, z)))
    df = spark.createDataFrame(rows, ["doc", "a", "b", "c", "features"])
    chain = models.Chain(models.logistic(c=100.0), ("a", "b", "c")).fit(df)
    got = chain.predict_proba(df).collect()
    assert sum((r.prob_a > 0.5) == (r.a == 1) for r in got) > 110 and all(r.prob_c == 0.0 for r in got)
    chain.save(str(tmp_path / "m"), spark, {"a": 0.4})
    loaded, taus = models.Chain.load(str(tmp_path / "m"), spark)
    assert taus == {"a": 0.4}
    again = {r.doc: r.prob_b for r in loaded.predict_proba(df).collect()}
    assert all(abs(again[r.doc] - r.prob_b) < 1e-9 for r in got)
    with pytest.raises(RuntimeError):
        models.Chain(models.logistic()).predict_proba(df)
    svc = models.CalibratedSvc().fit(df, "a", "features").predict_proba(df, "features", "p").collect()
    assert sum((r.p > 0.5) == (r.a == 1) for r in svc) > 105 and all(0 <= r.p <= 1 for r in svc)
    huber = models.ModifiedHuber(("a", "b"), steps=60, rate=2.0).fit(df).predict_proba(df).collect()
    assert sum((r.prob_a > 0.5) == (r.a == 1) for r in huber) > 100 and len(huber) == 120
    sparse = df.where("doc < 40").withColumn("features", F.lit(None)).drop("features").join(spark.createDataFrame([(i, Vectors.sparse(2, {0: i / 40})) for i in range(40)], ["doc", "features"]), "doc")
    assert models.ModifiedHuber(("a", "b"), steps=2).fit(sparse.unionByName(df.where("doc >= 40"))).predict_proba(sparse).count() == 40
    bayes = models.Chain(models.complement_bayes(), ("a", "b")).fit(df).predict_proba(df)
    assert bayes.where("prob_a between 0 and 1").count() == 120


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None)], "i long, v array<double>")
    want = {}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 200, 20):
        c = unit @ unit[q]
        c[q] = -2
        want[q] = np.argsort(-c)[:5].tolist()
    for block in (4096, 3):
        got: dict = {}
        for r in models.nearest(df.where("i % 20 = 0"), df, "i", "v", 5, block).orderBy("query", "place").collect():
            got.setdefault(r.query, []).append(r.neighbour)
        assert got == want


def test_nearest_in_leading_directions(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(k, int(k % 2), Vectors.dense(v)) for k, v in enumerate(x)], ["i", "a", "features"])
    table = models.directions(df, "features", 3)
    near = np.linalg.svd(x)[2][:3].T
    assert np.allclose(np.abs(near.T @ table), np.eye(3), atol=1e-6)
    got = {r.i: r.reduced for r in models.reduced(df, "features", table).collect()}
    assert all(np.allclose(got[k], x[k] @ table) for k in got)
    rows = models.reduced(df, "features", table)
    shares = models.neighbour_shares(rows.where("i < 5"), rows, "i", "reduced", ("a",), 3).collect()
    assert len(shares) == 5 and all(round(r.prob_a * 3, 2) in (0, 1, 2, 3) for r in shares)


def test_orders():
    freq = ["joy", "anger", "sadness", "surprise", "disgust", "fear"]
    assert models.chain_order("reverse", freq, freq)[0] == "fear" and models.chain_order("alphabetical", freq, freq) == sorted(freq)
    assert sorted(models.chain_order("random", freq, freq, seed=1)) == sorted(freq)
    with pytest.raises(ValueError):
        models.chain_order("other", freq, freq)


def test_rows_without_terms_stay(spark, tmp_path):
    """A row with no term of the vocabulary has the zero vector and isn't dropped from fitting or prediction."""
    from emoloom.plans import evaluation as E

    rows = [(f"s{k}", "" if k % 4 == 0 else "খুব ভালো গান", *(int(k % 6 == j) for j in range(6))) for k in range(60)]
    spark.createDataFrame(rows, "sample_id string, processed_text string, " + ", ".join(f"{c} int" for c in E.LABELS)).write.parquet(f"{tmp_path}/train.parquet")
    fit, rest = E._vectors(spark, str(tmp_path))
    got = {r.doc: r.features.numNonzeros() for part in (fit, rest) for r in part.collect()}
    assert len(got) == 60 and got["s4"] == 0 and got["s1"] > 0
