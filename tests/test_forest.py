"""Forests grown together over sparse rows: MLlib's forests, in passes that all labels share."""

import random

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from emoloom.operators import forest, models

L = ("a", "b", "c")


def _table(spark, n=400, width=30, labels=3):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        cells = {j: rng.choice([-1.0, 1.0, 1.0]) * rng.random() for j in rng.sample(range(width), rng.randint(0, 8))}
        y = [int(cells.get(k, 0) + cells.get(k + 5, 0) + rng.gauss(0, 0.2) > (0.2 if k else 0.5)) for k in range(labels)]
        rows.append((i, *y, Vectors.sparse(width, cells) if i % 9 else Vectors.dense(Vectors.sparse(width, cells).toArray())))
    return spark.createDataFrame(rows, ["doc", *(f"y{k}" for k in range(labels)), "features"])


def test_forests_are_mllib_s(spark, tmp_path):
    """Probabilities are those of MLlib's forest but for chance; what was saved is read back."""
    df = _table(spark).withColumnsRenamed({"y0": "a", "y1": "b", "y2": "c"}).persist()
    chain = models.Chain(models.forest(200), L, chained=False).fit(df)
    chain.save(str(tmp_path / "chain"), spark)
    got = models.Chain.load(str(tmp_path / "chain"), spark)[0].predict_proba(df)
    for k, label in enumerate(L):
        p, n = df.where(F.col(label) == 1).count(), df.count()
        rows = df.withColumn("w", models.balanced(label, p, n))
        want = [RandomForestClassifier(labelCol=label, weightCol="w", numTrees=200, seed=seed).fit(rows) for seed in (42, 7)]
        one, two = (np.array([r.v for r in models.probability(m, df, "features", "v").orderBy("doc").collect()]) for m in want)
        own = np.array([r[f"prob_{label}"] for r in got.orderBy("doc").collect()])
        assert np.abs(own - one).mean() < 1.5 * np.abs(two - one).mean() + 0.01 and np.corrcoef(own, one)[0, 1] > 0.98
        assert chain.links[k].getNumTrees == 200 and max(t.depth for t in chain.links[k].trees) == 5


def test_a_tree_s_counts(spark):
    """The nodes' counts and the gain of every split are those of the rows that come to it."""
    df = _table(spark).withColumnRenamed("y1", "a").repartition(3).persist()
    assert df.count() == 400
    rows = forest.Packed(df, "features", ("a",), 32)
    trees = forest.Trees.of(2, 1, 3)
    x = np.concatenate([np.array([r.features.toArray() for r in df.where(F.spark_partition_id() == p).collect()]) for p in range(3)])
    y = np.concatenate([np.array([r.a for r in df.where(F.spark_partition_id() == p).collect()]) for p in range(3)])
    ends = np.cumsum([0, *(df.where(F.spark_partition_id() == p).count() for p in range(3))])
    times = np.concatenate([np.random.default_rng((42, 1, p, 0)).poisson(1.0, ends[p + 1] - ends[p]) for p in range(3)])
    found = {(t, node): (one, n) for t, _, node, one, n in rows.level(trees, [0, 1], 0, 42, 30, np.array([[1.0, 2.0]]))}
    (gain, feature, last, left), n = found[1, 0]
    assert n.tolist() == [times[y == 0].sum(), times[y == 1].sum()]

    def impurity(m):
        w = np.array([times[m & (y == 0)].sum(), 2.0 * times[m & (y == 1)].sum()])
        return w.sum(), 1 - ((w / max(w.sum(), 1e-12)) ** 2).sum()

    def gained(f, cut):
        (n, all_), (a, low), (b, high) = (impurity(m) for m in (y >= 0, x[:, f] <= cut, x[:, f] > cut))
        return all_ - a / n * low - b / n * high

    cuts = {(f, k): forest.threshold(*map(int, c)) for f, at in rows.thresholds.items() for k, c in enumerate(at.T)}
    best = max(gained(f, cut) for (f, _), cut in cuts.items())
    assert abs(gain - best) < 1e-9 and abs(gained(feature, cuts[feature, last]) - best) < 1e-9
    below = x[:, feature] <= cuts[feature, last]
    assert left.tolist() == [times[below & (y == 0)].sum(), times[below & (y == 1)].sum()]


def test_places_keep_the_order():
    v = np.sort(np.concatenate([np.random.default_rng(1).normal(size=500), [0.0, -0.0, 1.0, 2.0]]))
    at = forest.places(v).astype(int)
    assert (np.diff(at) >= 0).all() and forest.places(np.array([0.0]))[0] == forest.ZERO
    for first, before in ((at[k + 1], at[k]) for k in range(len(v) - 1) if at[k + 1] > at[k]):
        cut = forest.threshold(first, before)
        assert (v[at <= before] <= cut).all() and (v[at >= first] > cut).all()


def test_passes_don_t_grow_with_labels(spark):
    def jobs(n):
        df = _table(spark, labels=n).persist()
        df.count()
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        models.Chain(models.forest(20), tuple(f"y{k}" for k in range(n)), chained=False).fit(df)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before

    assert jobs(6) - jobs(1) <= 5 * 9  # a label's model is written and read


def test_wide_rows_aren_t_filled(spark):
    """A row of many features takes the place of those that are set."""
    rng = random.Random(3)
    width = 400_000
    rows = [(i, i % 2, 1, Vectors.sparse(width, {j: 1.0 for j in [i % 2, *rng.sample(range(2, width), 5)]})) for i in range(300)]
    df = spark.createDataFrame(rows, ["doc", "a", "b", "features"])
    chain = models.Chain(models.forest(3), ("a", "b"), chained=False).fit(df)
    assert chain.links[1] == models.Constant(1.0) and chain.links[0].numFeatures == width
