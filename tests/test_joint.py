"""Linear models fitted together: the same models as MLlib's, in passes that all labels share."""

import random

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from emoloom.operators import joint, models

L = ("a", "b", "c")


def _table(spark, n=300, labels=3, width=40):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        cells = {j: rng.random() for j in rng.sample(range(width), rng.randint(0, 6))} | ({0: rng.random()} if i % 3 else {})
        y = [int(sum(v * ((j * 7 + k) % 5 - 2) for j, v in cells.items()) + rng.gauss(0, 0.5) > 0) for k in range(labels)]
        rows.append((i, *y, rng.choice([0.5, 2.0]), Vectors.sparse(width, cells)))
    return spark.createDataFrame(rows, ["doc", *(f"y{k}" for k in range(labels)), "sample_weight", "features"])


def test_links_are_mllib_s(spark):
    df = _table(spark).withColumnsRenamed({"y0": "a", "y1": "b", "y2": "c"})
    for chained in (True, False):
        for own in (df, df.drop("sample_weight")):
            fit_one = models.logistic(2.0)
            chain = models.Chain(fit_one, L, chained).fit(own)
            rows = own.withColumns({f"_y_{c}": F.col(c).cast("double") for c in L})
            for k, label in enumerate(L):
                want = fit_one(chain._inputs(k).transform(rows), label, "_x")
                got = chain.links[k]
                assert np.allclose(got.coefficients.toArray(), want.coefficients.toArray(), atol=5e-3) and abs(got.intercept - want.intercept) < 5e-3


def test_passes_don_t_grow_with_labels(spark):
    """The jobs of a fit are those of its slowest label, not the sum over labels."""

    def jobs(n, fit):
        labels = tuple(f"y{k}" for k in range(n))
        df = _table(spark, labels=n).drop("sample_weight").persist()
        df.count()
        sc = spark.sparkContext
        before = len(sc.statusTracker().getJobIdsForGroup(None))
        fit(df, labels)
        return len(sc.statusTracker().getJobIdsForGroup(None)) - before

    assert jobs(6, lambda df, labels: models.Chain(models.logistic(), labels).fit(df)) < 130
    assert jobs(4, lambda df, labels: models.fit_calibrated(df, labels)) < 150


def test_hinge_loss_is_least(spark):
    """Each fold's SVM has a loss no greater than MLlib's, and its curve is fitted on the rows left out."""
    df = _table(spark).drop("sample_weight").withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(3)))
    model = models.fit_calibrated(df, ("y0", "y1"))[1]
    for fold, (svc, slope, _) in enumerate(model.pairs):
        inside = df.where(F.col("part") != fold)
        n, p = inside.count(), inside.where("y1 = 1").count()
        want = LinearSVC(labelCol="y1", weightCol="w", regParam=1 / n, maxIter=50, standardization=False).fit(inside.withColumn("w", models.balanced("y1", p, n)))
        x, y = (np.array(v) for v in zip(*[(r.features.toArray(), 2 * r.y1 - 1) for r in inside.collect()]))
        weight = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))

        def loss(m, x=x, y=y, weight=weight, n=n):
            return weight @ np.maximum(0, 1 - y * (x @ m.coefficients.toArray() + m.intercept)) / n + float(m.coefficients.dot(m.coefficients)) / 2 / n

        assert loss(svc) < loss(want) * 1.02 and slope > 0


def test_a_start_from_some_blocks_ends_at_the_same_point(spark, monkeypatch):
    df = _table(spark, 400).drop("sample_weight")
    plain = models.Chain(models.logistic(), ("y0", "y1")).fit(df)
    monkeypatch.setattr(joint, "WARM", 2)
    monkeypatch.setattr(joint, "ROWS", 20)
    warm = models.Chain(models.logistic(), ("y0", "y1")).fit(df)
    for a, b in zip(plain.links, warm.links):
        assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=5e-3)
