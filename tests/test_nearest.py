"""Nearest rows: what a task returns, ties, rows that are their own queries."""

import numpy as np
from pyspark.sql import functions as F

from emoloom.operators import models


def _table(spark, n=120, parts=2):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 4)).round(1)
    x[n // 2 :] = x[: n - n // 2] * 2  # the same directions again: ties
    x[5] = 0
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>").repartition(parts).persist()


def test_a_task_returns_its_best_only(spark):
    """Rows returned grow with tasks, not with batches of the base."""
    _, df = _table(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert models._nearest_block(df.where("k < 20"), df, "k", "v", 3).count() == 20 * 3 * 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nearest_is_brute_force(spark):
    x, df = _table(spark)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = (u @ u.T).round(9)
    for batch, block in ((7, 1 << 16), (10_000, 1 << 16), (50, 11)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            got: dict = {}
            for r in models.nearest(df.where("k < 40"), df, "k", "v", 5, block).orderBy("query", "place").collect():
                got.setdefault(r.query, []).append(r.neighbour)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {i: sorted((j for j in range(len(x)) if j != i), key=lambda j: (-c[i, j], j))[:5] for i in range(40)}
    few = models.nearest(df.where("k < 2"), df.where("k < 3"), "k", "v", 5).groupBy("query").agg(F.count("*").alias("n")).collect()
    assert {r.query: r.n for r in few} == {0: 2, 1: 2}
