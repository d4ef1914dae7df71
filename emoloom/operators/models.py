"""Multi-label classifiers on MLlib: chains, independent models, ensembles.

A table has ``features`` (a vector) and one 0/1 column a label.  A chain fits
a link a label, each link seeing the features and the labels of the links
before it: their true values in training, their decisions at 0.5 afterwards.
Links are fitted side by side; each fit is a series of distributed jobs.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import LABELS
from . import forest as sparse_forest, joint
from .leading import directions, reduced


def packed(df: DataFrame, part_bytes: int = 32 << 20) -> DataFrame:
    """``df`` kept in memory in partitions of about ``part_bytes``: a solver
    runs a job an iteration, whose tasks should have more to do than to start."""
    kept = df.persist()
    kept.count()
    size = int(str(kept.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return kept.coalesce(max(1, -(-size // part_bytes))).persist()


def at_once(make: Callable, items) -> list:
    """``make`` of every item, the jobs of all running side by side."""
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(make, items))


def balanced(label: str, positives: int, n: int) -> Column:
    """Weights n / (2 x the class's number); 1 where a class is missing."""
    if not 0 < positives < n:
        return F.lit(1.0)
    return F.when(F.col(label) == 1, n / (2.0 * positives)).otherwise(n / (2.0 * (n - positives)))


def class_weight(label: str, how: str | float | None, positives: int, n: int) -> Column:
    """None, "balanced", or a multiplier of the positives."""
    if how == "balanced":
        return balanced(label, positives, n)
    return F.when(F.col(label) == 1, float(how)).otherwise(1.0) if how else F.lit(1.0)


def logistic(c: float = 1.0, weight: str | float | None = "balanced", max_iter: int = 100) -> Callable:
    """A factory of L2 logistic regressions; the penalty is that of a summed loss with strength 1/C."""

    def fit(df: DataFrame, label: str, features: str) -> Model:
        stats = df.agg(F.sum(label).alias("p"), F.count("*").alias("n")).first()
        rows = df.withColumn("_w", class_weight(label, weight, stats.p or 0, stats.n) * (F.col("sample_weight") if "sample_weight" in df.columns else F.lit(1.0)))
        total = rows.agg(F.sum("_w")).first()[0] or 1.0
        return LogisticRegression(featuresCol=features, labelCol=label, weightCol="_w", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-6).fit(rows)

    def together(df: DataFrame, order: tuple[str, ...], chained: bool, features: str) -> list:
        """The links of a chain, all fitted in the same passes over the rows."""
        rows = joint.Rows(df, features, order, weight="sample_weight" if "sample_weight" in df.columns else None)
        links = [joint.Problem(k, tuple(range(k)) if chained else ()) for k in range(len(order))]
        known = [rows.known(p) for p in links]
        own = [k for k, (n, positives) in enumerate(known) if 0 < positives < n]
        weights = [class_weights(weight, known[k][1], known[k][0]) for k in own]
        got = dict(zip(own, joint.fitted(rows, [links[k] for k in own], weights, lambda total: 1.0 / (c * total), joint.log_loss, max_iter, 1e-6)))
        rows.drop()
        return [linear_model(df, "LogisticRegression", got[k][:-1], got[k][-1]).setFeaturesCol("_x") if k in got else Constant(float(known[k][1] > 0)) for k in range(len(order))]

    fit.together = together
    return fit


def class_weights(how: str | float | None, positives: int, n: int) -> tuple[float, float]:
    """The weights that ``class_weight`` gives negatives and positives."""
    if how == "balanced":
        return (n / (2.0 * (n - positives)), n / (2.0 * positives)) if 0 < positives < n else (1.0, 1.0)
    return 1.0, float(how) if how else 1.0


def linear_model(df: DataFrame, kind: str, coefficients, intercept: float) -> Model:
    """MLlib's model ("LogisticRegression" or "LinearSVC") with the given coefficients."""
    import uuid

    from pyspark.ml import classification
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import Vectors

    sc = df.sparkSession.sparkContext
    made = getattr(sc._jvm.org.apache.spark.ml.classification, f"{kind}Model")
    return getattr(classification, f"{kind}Model")(made(f"{kind}_{uuid.uuid4().hex[:12]}", _py2java(sc, Vectors.dense(coefficients)), float(intercept)))


def complement_bayes(alpha: float = 1.0) -> Callable:
    def fit(df: DataFrame, label: str, features: str) -> Model:
        return NaiveBayes(featuresCol=features, labelCol=label, modelType="complement", smoothing=alpha).fit(df)

    return fit


def forest(trees: int = 200, seed: int = 42) -> Callable:
    """A factory of balanced random forests, those of independent labels grown in the same passes."""

    def fit(df: DataFrame, label: str, features: str) -> Model:
        got = sparse_forest.grown(df, (label,), features, trees, seed)[0]
        return Constant(got) if isinstance(got, float) else got

    def together(df: DataFrame, order: tuple[str, ...], chained: bool, features: str) -> list | None:
        if chained:  # each link has features of its own
            return None
        got = sparse_forest.grown(df, order, features, trees, seed)
        return [Constant(x) if isinstance(x, float) else x.setFeaturesCol("_x") for x in got]

    fit.together = together
    return fit


def probability(model: Model, df: DataFrame, features: str, out: str) -> DataFrame:
    """Adds ``out``, the probability of 1; of a margin its logistic function."""
    model = model.copy()
    for name in ("predictionCol", "rawPredictionCol", "probabilityCol"):
        if model.hasParam(name):
            model._set(**{name: f"_{name}"})
    scored = model.transform(df)
    if "_probabilityCol" in scored.columns:
        p = vector_to_array("_probabilityCol")
    else:
        margin = vector_to_array("_rawPredictionCol")[1]
        p = F.array(1 - 1 / (1 + F.exp(-margin)), 1 / (1 + F.exp(-margin)))
    # a model that saw one class only has one probability
    value = F.when(F.size(p) > 1, F.element_at(p, 2)).otherwise(0.0)
    return scored.withColumn(out, value).drop("_predictionCol", "_rawPredictionCol", "_probabilityCol")


@dataclass
class Constant:
    """Stands for a label that training rows have always or never."""

    value: float


@dataclass
class Chain:
    """A classifier chain.  ``order`` is the order of the links; ``chained``
    False gives independent models."""

    fit_one: Callable
    order: tuple[str, ...] = LABELS
    chained: bool = True
    links: list = field(default_factory=list)

    def _inputs(self, k: int) -> VectorAssembler:
        before = list(self.order[:k]) if self.chained else []
        return VectorAssembler(inputCols=["features", *(f"_y_{c}" for c in before)], outputCol="_x")

    def fit(self, df: DataFrame) -> Chain:
        """The links see the true labels before them, so all are fitted at once."""
        together = getattr(self.fit_one, "together", None)
        if together and (links := together(df, tuple(self.order), self.chained, "features")) is not None:
            self.links = links
            return self
        rows = df.withColumns({f"_y_{c}": F.col(c).cast("double") for c in self.order})
        seen = rows.agg(*(f(c).alias(f"{n}_{c}") for c in self.order for n, f in (("lo", F.min), ("hi", F.max)))).first()

        def one(k: int):
            label = self.order[k]
            if seen[f"lo_{label}"] == seen[f"hi_{label}"]:
                return Constant(float(seen[f"lo_{label}"]))
            return self.fit_one(self._inputs(k).transform(rows), label, "_x")

        self.links = at_once(one, range(len(self.order)))
        return self

    def predict_proba(self, df: DataFrame, prefix: str = "prob") -> DataFrame:
        """Adds ``<prefix>_<label>``; RuntimeError before ``fit``."""
        if not self.links:
            raise RuntimeError("fit before predict_proba")
        rows = df
        for k, (label, link) in enumerate(zip(self.order, self.links)):
            out = f"{prefix}_{label}"
            if isinstance(link, Constant):
                rows = rows.withColumn(out, F.lit(link.value))
            else:
                rows = probability(link, self._inputs(k).transform(rows), "_x", out).drop("_x")
            rows = rows.withColumn(f"_y_{label}", (F.col(out) > 0.5).cast("double"))
        return rows.drop(*(f"_y_{c}" for c in self.order))

    def save(self, path: str, spark, thresholds: dict[str, float] | None = None) -> None:
        """Each link in MLlib's own form; order, constants and thresholds as JSON."""
        facts = {"order": self.order, "chained": self.chained, "thresholds": thresholds, "links": []}
        for k, link in enumerate(self.links):
            facts["links"].append(link.value if isinstance(link, Constant) else f"{type(link).__module__}.{type(link).__name__}")
            if not isinstance(link, Constant):
                link.write().overwrite().save(f"{path}/link{k}")
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/chain")

    @classmethod
    def load(cls, path: str, spark) -> tuple[Chain, dict[str, float] | None]:
        import importlib

        facts = json.loads(spark.read.text(f"{path}/chain").first()[0])
        out = cls(None, tuple(facts["order"]), facts["chained"])
        for k, what in enumerate(facts["links"]):
            if isinstance(what, str):
                module, _, name = what.rpartition(".")
                out.links.append(getattr(importlib.import_module(module), name).load(f"{path}/link{k}"))
            else:
                out.links.append(Constant(what))
        return out, facts["thresholds"]


@dataclass
class CalibratedSvc:
    """A linear SVM whose margins are turned into probabilities by a logistic
    curve fitted on the margins of folds left out; the mean over the folds."""

    folds: int = 3
    max_iter: int = 50
    pairs: list = field(default_factory=list)

    def fit(self, df: DataFrame, label: str, features: str, key: str = "doc") -> CalibratedSvc:
        self.pairs = fit_calibrated(df, (label,), features, key, self.folds, self.max_iter)[0].pairs
        return self

    @staticmethod
    def _margin(svc: Model, df: DataFrame, features: str) -> DataFrame:
        svc = svc.copy()
        svc._set(rawPredictionCol="_raw", predictionCol="_p")
        return svc.transform(df).withColumn("_margin", vector_to_array("_raw")[1]).drop("_raw", "_p")

    def predict_proba(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """Adds ``out``, the mean of the folds' probabilities."""
        total, rows = F.lit(0.0), df
        for k, (svc, a, b) in enumerate(self.pairs):
            rows = self._margin(svc, rows, features).withColumnRenamed("_margin", f"_m{k}")
            total = total + 1 / (1 + F.exp(-(F.col(f"_m{k}") * a + b)))
        return rows.withColumn(out, total / len(self.pairs)).drop(*(f"_m{k}" for k in range(len(self.pairs))))


def fit_calibrated(df: DataFrame, labels: tuple[str, ...], features: str = "features", key: str = "doc", folds: int = 3, max_iter: int = 50) -> list[CalibratedSvc]:
    """A calibrated SVM for each label: the SVMs of all labels and folds take
    their steps in the same passes over the rows, their curves likewise."""
    rows = joint.Rows(df, features, labels, part=F.pmod(F.xxhash64(key), F.lit(folds)))
    problems = [joint.Problem(k, (), fold) for k in range(len(labels)) for fold in range(folds)]
    weights = [class_weights("balanced", positives, n) for n, positives in map(rows.known, problems)]
    points = joint.fitted(rows, problems, weights, lambda total: 1.0 / max(total, 1.0), joint.hinge_loss, max_iter, 1e-6)
    curves = rows.calibrated(problems, points, 50, 1e-6)
    rows.drop()
    pairs = [(linear_model(df, "LinearSVC", w[:-1], w[-1]).setFeaturesCol(features), *curve) for w, curve in zip(points, curves)]
    return [CalibratedSvc(folds, max_iter, pairs[k * folds : (k + 1) * folds]) for k in range(len(labels))]


@dataclass
class ModifiedHuber:
    """A chain of linear models under the modified Huber loss, balanced, by full
    gradient steps (stochastic steps have no counterpart that gives the same
    numbers).  In training a link sees the true labels of those before it, so
    all links take a step in one pass over the rows: an aggregate of one sparse
    gradient a link.  The coefficients are broadcast."""

    order: tuple[str, ...] = LABELS
    chained: bool = True
    steps: int = 30
    rate: float = 1.0
    alpha: float = 1e-4
    coefficients: list = field(default_factory=list)  # a row a link: the features', then the labels before it
    intercepts: list = field(default_factory=list)

    def fit(self, df: DataFrame, features: str = "features") -> ModifiedHuber:
        import numpy as np
        import pyarrow as pa

        n_links, chained, sparse = len(self.order), self.chained, _sparse()
        stats = df.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in self.order)).first()
        width = df.select(features).first()[0].size
        rows = df.select(F.col(features).alias("x"), F.array(*(F.col(c).cast("double") for c in self.order)).alias("y"), F.array(*(balanced(c, stats[c] or 0, stats.n) for c in self.order)).alias("w")).persist()
        w, b = np.zeros((n_links, width + n_links)), np.zeros(n_links)

        for step in range(self.steps):
            now = df.sparkSession.sparkContext.broadcast((w, b))

            def gradient(batches, now=now):
                w, b = now.value
                total = np.zeros((n_links, width + n_links + 1))
                for batch in batches:
                    n = len(batch)
                    if not n:
                        continue
                    row, at, v = sparse(batch.column(0))
                    y, weight = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(n, n_links) for k in (1, 2))
                    for k in range(n_links):
                        before = y[:, : k if chained else 0]
                        m = before.shape[1]
                        sign = 2 * y[:, k] - 1
                        z = sign * (np.bincount(row, v * w[k, at], n) + before @ w[k, width : width + m] + b[k])
                        slope = np.where(z >= 1, 0.0, np.where(z >= -1, -2 * (1 - z), -4.0)) * sign * weight[:, k]
                        total[k, :width] += np.bincount(at, v * slope[row], width)
                        total[k, width : width + m] += slope @ before
                        total[k, -1] += slope.sum()
                k, at = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at])], names=["k", "at", "g"])

            parts = rows.mapInArrow(gradient, "k int, at int, g double").groupBy("k", "at").agg(F.sum("g").alias("g")).toArrow()
            total = np.zeros((n_links, width + n_links + 1))
            total[parts["k"].to_numpy(), parts["at"].to_numpy()] = parts["g"].to_numpy()
            scale = self.rate / (1 + 0.1 * step) / max(stats.n, 1)
            w, b = w * (1 - self.rate * self.alpha) - scale * total[:, :-1], b - scale * total[:, -1]
            now.unpersist()
        rows.unpersist()
        self.coefficients, self.intercepts = w.tolist(), b.tolist()
        return self

    def predict_proba(self, df: DataFrame, features: str = "features", prefix: str = "prob") -> DataFrame:
        """The other columns of ``df`` with ``<prefix>_<label>``: (margin within
        -1 and 1, plus 1) / 2; RuntimeError before ``fit``."""
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

        if not self.coefficients:
            raise RuntimeError("fit before predict_proba")
        kept = df.sparkSession.sparkContext.broadcast((np.array(self.coefficients), np.array(self.intercepts)))
        n, chained, sparse = len(self.order), self.chained, _sparse()

        def scored(batches):
            w, b = kept.value
            width = w.shape[1] - n
            for batch in batches:
                row, at, v = sparse(batch.column(1))
                p, said = np.zeros((len(batch), n)), np.zeros((len(batch), n))
                for k in range(n):
                    z = np.bincount(row, v * w[k, at], len(batch)) + b[k]
                    if chained:
                        z = z + said[:, :k] @ w[k, width : width + k]
                    p[:, k] = (np.clip(z, -1, 1) + 1) / 2
                    said[:, k] = p[:, k] > 0.5
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(p), pa.list_(pa.float64()))], names=["row", "p"])

        rows = df.select(F.struct(*(c for c in df.columns if c != features)).alias("row"), F.col(features).alias("x"))
        out = rows.mapInArrow(scored, StructType([StructField("row", rows.schema["row"].dataType), StructField("p", ArrayType(DoubleType()))]))
        return out.select("row.*", *(F.col("p")[k].alias(f"{prefix}_{c}") for k, c in enumerate(self.order)))


def _sparse():
    """A reader of a column of vectors in Arrow: rows, places and values, flat."""

    def read(column):
        import numpy as np

        kind, lists = column.field("type").to_numpy(zero_copy_only=False), column.field("values")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(column)), sizes)
        if (kind == 0).all():
            at = column.field("indices").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        else:  # some rows are dense
            own = column.field("indices").to_pylist()
            at = np.concatenate([np.asarray(x, np.int64) if k == 0 else np.arange(n) for x, k, n in zip(own, kind, sizes)])
        return row, at, values

    return read


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int = 5, block: int = 1 << 16) -> DataFrame:
    """(query, neighbour, cosine, place): the ``k`` nearest rows by cosine, ties by id.

    The stated set of queries meets the base in blocks of about ``block``, which
    bounds what is broadcast: each task keeps the best ``k`` of every query over
    its part of the base, which are then merged.  No pair of rows is shuffled.
    Rows without a vector are nobody's neighbours."""
    rows = queries.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null and v is not null")
    blocks = -(-rows.count() // block) or 1
    found = None
    for n in range(blocks):
        one = _nearest_block(rows.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == n), base, key, vector, k)
        found = one if found is None else found.unionByName(one)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query", "neighbour", F.round("cosine", 6).alias("cosine"), F.col("place").cast("long").alias("place"))


def _nearest_block(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Of each task the best ``k`` of every query.  Cosines are taken in single
    precision first; what comes within its error of a query's last place so far
    is taken again in double precision, which decides."""
    import numpy as np
    import pyarrow as pa

    def opened(batch):
        v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        return batch.column(0).to_numpy(), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    made = [opened(b) for b in queries.select("k", "v").toArrow().to_batches() if len(b)]
    ids = np.concatenate([x for x, _ in made]) if made else np.zeros(0, np.int64)
    q = np.concatenate([v for _, v in made]) if made else np.zeros((0, 0))
    order = np.argsort(ids, kind="stable")
    kept = queries.sparkSession.sparkContext.broadcast((ids[order], q[order]))

    def best(batches):
        ids, q = kept.value
        if not len(ids):
            return
        error = np.float32((q.shape[1] + 4) * 2.0**-23)
        single = q.astype(np.float32)
        cosine, near, full = np.full((len(ids), k), -2.0), np.zeros((len(ids), k), np.int64), False
        for batch in batches:
            if not len(batch):
                continue
            own, x = opened(batch)
            columns = np.ascontiguousarray(x.astype(np.float32).T)
            # a row is not its own neighbour
            a, b = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
            self_q, self_x = np.concatenate([np.arange(i, j) for i, j in zip(a, b) if i < j] or [np.zeros(0, int)]), np.repeat(np.arange(len(own)), b - a)
            for start in range(0, len(ids), 256):
                part = single[start : start + 256] @ columns
                mine = (self_q >= start) & (self_q < start + 256)
                part[self_q[mine] - start, self_x[mine]] = -2
                least = cosine[start : start + 256, -1].astype(np.float32)
                if not full and part.shape[1] > k:
                    least = np.maximum(least, np.partition(part, part.shape[1] - k, axis=1)[:, -k])
                row, at = divmod(np.flatnonzero(part >= (least - 2 * error)[:, None]), part.shape[1])
                seen = part[row, at] > -1.5
                row, at = row[seen], at[seen]
                if not len(row):
                    continue
                some = np.unique(row)
                c = np.concatenate([cosine[start + some].ravel(), np.einsum("ij,ij->i", q[start + row], x[at])])
                n = np.concatenate([near[start + some].ravel(), own[at]])
                r = np.concatenate([np.repeat(some, k), row])
                order = np.lexsort((n, -c.round(9), r))
                r, starts = r[order], np.searchsorted(r[order], some)
                first = order[np.add.outer(starts, np.arange(k)).ravel()]  # of every row there are k at least
                cosine[start + some], near[start + some] = c[first].reshape(-1, k), n[first].reshape(-1, k)
            full = bool((cosine[:, -1] > -2).all())
        found = cosine.ravel() > -2
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[found]), pa.array(near.ravel()[found]), pa.array(cosine.ravel()[found])], names=["query", "neighbour", "cosine"])

    rows = base.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null and v is not null")
    # what a task returns is its queries' best, so there is a task a core
    return rows.coalesce(queries.sparkSession.sparkContext.defaultParallelism).mapInArrow(best, "query long, neighbour long, cosine double")


def neighbour_shares(queries: DataFrame, base: DataFrame, key: str, vector: str, labels: tuple[str, ...] = LABELS, k: int = 5) -> DataFrame:
    """(query, prob_<label>…): for every query the share of its ``k`` nearest rows of ``base`` that have each label."""
    near = nearest(queries, base, key, vector, k).select("query", "neighbour")
    named = near.join(base.select(F.col(key).alias("neighbour"), *labels), "neighbour")
    return named.groupBy("query").agg(*(F.round(F.avg(F.col(c).cast("double")), 4).alias(f"prob_{c}") for c in labels))


# The order that puts the rare labels in the middle.
RARE_MIDDLE = ("joy", "anger", "fear", "surprise", "disgust", "sadness")


def chain_order(kind: str, frequency: list[str], correlation: list[str], labels: tuple[str, ...] = LABELS, seed: int = 42) -> list[str]:
    """Orders of the links: by frequency, its reverse, by co-occurrence, by name, the rare in the middle, or at random."""
    if kind == "frequency":
        return list(frequency)
    if kind == "reverse":
        return list(reversed(frequency))
    if kind == "correlation":
        return list(correlation)
    if kind == "alphabetical":
        return sorted(labels)
    if kind == "rare_middle":
        return list(RARE_MIDDLE)
    if kind == "random":
        out = sorted(labels)
        random.Random(seed).shuffle(out)
        return out
    raise ValueError(f"unknown order {kind!r}")


#: Penalty strengths that a sweep tries.
STRENGTHS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0)
