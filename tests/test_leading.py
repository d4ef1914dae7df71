"""Leading directions: all that are asked for, eigenvalues that repeat, rank, restarts; nearest rows in them."""

import numpy as np
import pytest

from emoloom.operators import leading


def _check(x, width, **more):
    table = leading.lanczos(lambda q: x.T @ (x @ q), x.shape[1], width, **more)
    values = np.linalg.eigvalsh(x.T @ x)[::-1]
    k = min(width, int((values > 1e-12 * values[0]).sum()))
    assert table.shape == (x.shape[1], k) and np.allclose(table.T @ table, np.eye(k), atol=1e-10)
    assert np.allclose(np.linalg.eigvalsh(table.T @ x.T @ x @ table)[::-1], values[:k], atol=1e-9 * values[0])
    return table


def test_lanczos():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 300)) * np.linspace(1, 3, 300)
    near = np.linalg.svd(x)[2][:20].T
    for more in ({"vectors": 5}, {"vectors": 5, "most": 45}, {"vectors": 30}):
        table = _check(x, 20, **more)
        assert np.abs(near - table @ (table.T @ near)).max() < 1e-6
    _check(rng.normal(size=(14, 300)), 20, vectors=5)  # its rank is less
    _check(rng.normal(size=(40, 6)), 9)
    _check(np.eye(300), 20, vectors=10)
    _check(np.eye(300) * np.r_[np.full(15, 3.0), np.full(30, 2.0), np.full(255, 0.5)], 20, vectors=10)  # more often than a block has vectors


def test_blocks_are_products(monkeypatch):
    monkeypatch.setattr(leading, "ROWS", 50)
    monkeypatch.setattr(leading, "DENSE", 10)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 40)) * (rng.uniform(size=(120, 40)) < np.linspace(0.02, 0.9, 40))
    x[[0, 60, 119]] = 0
    row, at = np.nonzero(x)
    q, space = rng.normal(size=(40, 7)), leading.Space()
    total, made = np.zeros((40, 7)), []
    for block in leading.blocks_of(row, at, x[row, at], 120):
        dense = leading.opened(block, space)
        made.append(leading.product(block, dense, q, space))
        leading.add_back(block, dense, made[-1], total, space)
        assert 0 < len(block["often"]) < 40
    assert np.allclose(np.concatenate(made), x @ q) and np.allclose(total, x.T @ (x @ q))


def test_svd_knn_takes_all_directions(spark, tmp_path):
    """The shares are those among the neighbours in 200 directions, as numpy finds them."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from emoloom.plans import evaluation as E

    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("কখগঘচছজঝটঠডঢতথদধ"), 4)) for _ in range(400)]
    rows = [(f"s{k}", " ".join(rng.choice(words, 12)), *(int(k % 6 == j) for j in range(6))) for k in range(500)]
    spark.createDataFrame(rows, "sample_id string, processed_text string, " + ", ".join(f"{c} int" for c in E.LABELS)).write.parquet(f"{tmp_path}/train.parquet")
    fit, rest = (part.select(F.xxhash64("doc").alias("key"), "doc", *E.LABELS, vector_to_array("features").alias("x")).toPandas() for part in E._vectors(spark, str(tmp_path)))
    x, y = np.array(fit.x.tolist()), np.array(rest.x.tolist())
    near = np.linalg.svd(x, full_matrices=False)[2][:200].T
    assert near.shape[1] == 200
    a, b = ((v @ near) / np.linalg.norm(v @ near, axis=1, keepdims=True) for v in (x, y))
    top = np.array([np.lexsort((fit.key, -c.round(9)))[:5] for c in b @ a.T])
    want = {doc: fit[list(E.LABELS)].to_numpy()[own].mean(0).round(4).tolist() for doc, own in zip(rest.doc, top)}
    got = {r.sample_id: [r[f"prob_{c}"] for c in E.LABELS] for r in E.svd_knn(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
