"""Linear models of many labels fitted together.

The rows' sparse vectors are packed once into blocks, which are kept serialised.  All models that are being fitted take a
step of L-BFGS in one pass over the blocks: each asks for its loss and gradient
at a point, a job answers all of them, and who has converged asks no more.  So
the data are read once a step, however many labels and folds there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Generator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

ROWS = 1024  # of a block
WARM = 16
DENSE = 20  # a block's columns that are set in one row of so many or more are multiplied as a dense matrix


@dataclass(frozen=True)
class Problem:
    """One model: its label's place, the places of the labels that it sees as
    features, and the part of the rows that it doesn't see (-1: it sees all)."""

    label: int
    before: tuple[int, ...] = ()
    without: int = -1


def blocks_of(features, y, weight, part, sparse):
    """Blocks of at most ROWS rows of one part, from the columns of a batch."""
    row, at, v = sparse(features)
    ends = np.searchsorted(row, np.arange(len(y) + 1))
    sizes = features.field("size").to_numpy(zero_copy_only=False)
    width = int(np.where(np.isnan(sizes), np.diff(ends), sizes).max(initial=0))
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        for start in range(0, len(mine), ROWS):
            some = mine[start : start + ROWS]
            n, sizes = len(some), ends[some + 1] - ends[some]
            where = np.repeat(ends[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            r, a, x = np.repeat(np.arange(n), sizes), at[where], v[where]
            found = np.bincount(a, minlength=1) * DENSE >= n
            dense = found[a]
            often, rest = np.flatnonzero(found), ~dense
            sizes = np.bincount(r[rest], minlength=n)
            rows = np.flatnonzero(sizes)
            yield {
                "n": n, "part": int(p), "width": width, "y": y[some], "weight": None if weight is None else weight[some],
                "often": often, "cells": (r[dense] * len(often) + np.searchsorted(often, a[dense])).astype(np.int32), "u": x[dense],
                "at": a[rest].astype(np.uint16 if width <= 1 << 16 else np.int32), "v": x[rest], "sizes": sizes, "rows": rows, "starts": (np.cumsum(sizes) - sizes)[rows],
            }


def opened(packed: bytes) -> dict:
    block = pickle.loads(packed)
    block["at"] = block["at"].astype(np.intp)
    block["dense"] = np.zeros((block["n"], len(block["often"])))
    block["dense"].ravel()[block["cells"]] = block["u"]
    return block


def products(block, points: list[np.ndarray]) -> np.ndarray:
    """The rows' products with each of the points, a column each."""
    at, v = block["at"], block["v"]
    kept = np.empty(len(v))
    out = block["dense"] @ np.array([w[block["often"]] for w in points]).T
    if len(v):
        for k, w in enumerate(points):
            np.take(w, at, out=kept, mode="clip")
            np.multiply(kept, v, out=kept)
            out[block["rows"], k] += np.add.reduceat(kept, block["starts"])
    return out


def sums(block, slopes: list[np.ndarray], totals: list[np.ndarray]) -> None:
    """Adds the rows, each times its slope, to each of the totals."""
    often = np.array(slopes) @ block["dense"]
    for slope, total, own in zip(slopes, totals, often):
        total[block["often"]] += own
        if len(block["v"]):
            kept = np.repeat(slope, block["sizes"])
            np.multiply(kept, block["v"], out=kept)
            total += np.bincount(block["at"], kept, len(total))


def log_loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loss at a margin (positive where the sign is right), and its slope."""
    e = np.exp(-np.abs(margin))
    return np.log1p(e) + np.maximum(-margin, 0), np.where(margin >= 0, -e, -1.0) / (1 + e)


def hinge_loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(1 - margin, 0), np.where(margin < 1, -1.0, 0.0)


class Rows:
    """A table's rows as kept blocks.  ``part`` numbers the folds."""

    def __init__(self, df: DataFrame, features: str, labels: tuple[str, ...], part=None, weight: str | None = None):
        from .models import _sparse

        sparse, n_labels, weighed = _sparse(), len(labels), weight is not None
        rows = df.select(
            F.col(features).alias("x"), F.array(*(F.col(c).cast("double") for c in labels)).alias("y"), (F.lit(0) if part is None else part).cast("int").alias("part"),
            (F.col(weight) if weighed else F.lit(1.0)).cast("double").alias("weight"))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if not len(batch):
                    continue
                y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n_labels)
                if np.isnan(y).any():
                    raise ValueError("a label is missing")
                made = blocks_of(batch.column(0), y, batch.column(3).to_numpy(zero_copy_only=False) if weighed else None, batch.column(2).to_numpy(zero_copy_only=False), sparse)
                for block in made:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

        self.sc = df.sparkSession.sparkContext
        self.labels = labels
        self.kept = rows.mapInArrow(run, "block binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)

        def counts(blocks):
            found, widths = {}, []
            for block in map(pickle.loads, blocks):
                own = found.setdefault(block["part"], [0, np.zeros(n_labels)])
                own[0] += block["n"]
                own[1] += block["y"].sum(0)
                widths.append(block["width"])
            return [(found, max(widths, default=0))]

        #: Of each part the number of rows and of each label's positives.
        self.n: dict[int, int] = {}
        self.positives: dict[int, np.ndarray] = {}
        self.width = 0
        for one, width in self.kept.mapPartitions(counts).collect():
            self.width = max(self.width, width)
            for p, (n, y) in one.items():
                self.n[p], self.positives[p] = self.n.get(p, 0) + n, self.positives.get(p, 0) + y
        # a task a core: a step sends one gradient of each model a task
        self.few = self.kept.coalesce(max(1, min(self.kept.getNumPartitions(), self.sc.defaultParallelism)))

    def known(self, problem: Problem) -> tuple[int, int]:
        """The rows that a problem sees, and how many have its label."""
        parts = [p for p in self.n if p != problem.without]
        return sum(self.n[p] for p in parts), int(round(sum(self.positives[p][problem.label] for p in parts)))

    def asked(self, problems: list[Problem], points: list[np.ndarray], weights: list[tuple[float, float]], loss: Callable, every: int = 1) -> list[tuple[float, np.ndarray, float]]:
        """For each problem the summed loss at its point, its gradient
        (features, labels before, intercept) and the summed weights; of one
        block in ``every`` of a task."""
        now, width = self.sc.broadcast((problems, points, weights)), self.width

        def one(blocks):
            problems, points, weights = now.value
            totals = [np.zeros(len(w)) for w in points]
            losses = np.zeros((len(points), 2))
            for number, packed in enumerate(blocks):
                if number % every:
                    continue
                block = opened(packed)
                own = [k for k, p in enumerate(problems) if p.without != block["part"]]
                if not own:
                    continue
                slopes = []
                for k, z in zip(own, products(block, [points[k][:width] for k in own]).T):
                    p, y = problems[k], block["y"][:, problems[k].label]
                    weight = np.where(y == 1, weights[k][1], weights[k][0])
                    if block["weight"] is not None:
                        weight = weight * block["weight"]
                    before, sign = block["y"][:, list(p.before)], 2 * y - 1
                    m = before.shape[1]
                    value, slope = loss(sign * (z + before @ points[k][width : width + m] + points[k][-1]))
                    slope = slope * sign * weight
                    losses[k] += float(weight @ value), float(weight.sum())
                    totals[k][width : width + m] += slope @ before
                    totals[k][-1] += slope.sum()
                    slopes.append(slope)
                sums(block, slopes, [totals[k][:width] for k in own])
            return [(losses, totals)]

        def add(a, b):
            return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]

        made = self.few.mapPartitions(one)
        losses, totals = made.treeReduce(add) if made.getNumPartitions() > 64 else reduce(add, made.collect())
        now.unpersist()
        return [(losses[k, 0], totals[k], losses[k, 1]) for k in range(len(points))]

    def calibrated(self, problems: list[Problem], points: list[np.ndarray], max_iter: int, tol: float) -> list[tuple[float, float]]:
        """For each problem the logistic curve (slope, intercept) of its label
        over its products with the rows of the part that it didn't see."""
        now, width = self.sc.broadcast((problems, points)), self.width

        def one(blocks):
            problems, points = now.value
            for packed in blocks:
                block = opened(packed)
                own = [k for k, p in enumerate(problems) if p.without == block["part"]]
                if own:
                    z = products(block, [points[k][:width] for k in own]).T
                    yield [(k, x + points[k][-1], 2 * block["y"][:, problems[k].label] - 1) for k, x in zip(own, z)]

        margins = self.few.mapPartitions(one).persist(StorageLevel.MEMORY_AND_DISK)

        def asked(at: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
            def one(parts):
                out = {k: np.zeros(4) for k in at}
                for part in parts:
                    for k, x, sign in part:
                        if k in at:
                            value, slope = log_loss(sign * (at[k][0] * x + at[k][1]))
                            slope = slope * sign
                            out[k] += value.sum(), slope @ x, slope.sum(), len(x)
                return [out]

            return reduce(lambda a, b: {k: a[k] + b[k] for k in a}, margins.mapPartitions(one).collect())

        out: list = [(0.0, 0.0)] * len(problems)
        asks, at = {}, {}
        for k, p in enumerate(problems):
            n, positives = self.n.get(p.without, 0), self.positives[p.without][p.label] if p.without in self.n else 0
            if 0 < positives < n:
                asks[k] = lbfgs(np.zeros(2), max_iter, tol)
                at[k] = next(asks[k])
            elif n:
                out[k] = (0.0, np.inf if positives else -np.inf)
        while at:
            for k, (value, a, b, n) in asked(at).items():
                try:
                    at[k] = asks[k].send((value / n, np.array([a, b]) / n))
                except StopIteration as end:
                    out[k] = (float(end.value[0]), float(end.value[1]))
                    del at[k]
        margins.unpersist()
        return out

    def drop(self) -> None:
        self.kept.unpersist()


Asks = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def lbfgs(x: np.ndarray, max_iter: int, tol: float, memory: int = 10, look_back: int = 20) -> Asks:
    """Minimises: yields points, is sent the value and gradient there, returns
    the last point.  It ends as Breeze's does: when the values of the last
    iterations differ, or the gradient's length is, by no more than ``tol``."""
    f, g = yield x
    first, values, pairs = f, [f], []
    for step in range(max_iter):
        if np.linalg.norm(g) <= max(tol * abs(f), 1e-8):
            break
        if len(values) > 2 and max(values[-look_back:]) - f <= tol * first and len(values) > look_back:
            break
        d = -g
        kept = []
        for s, y, sy in reversed(pairs):
            a = (s @ d) / sy
            d = d - a * y
            kept.append(a)
        if pairs:
            s, y, sy = pairs[-1]
            d *= sy / (y @ y)
        for (s, y, sy), a in zip(pairs, reversed(kept)):
            d = d + (a - (y @ d) / sy) * s
        if not g @ d < 0:
            d, pairs = -g, []
        got = yield from _searched(x, f, g, d, 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(d)))
        if got is None:
            if not pairs:
                break
            pairs = []  # once more along the gradient
            continue
        new, f, new_g = got
        s, y = new - x, new_g - g
        if (sy := s @ y) > 1e-12 * (y @ y):
            pairs = [*pairs[-memory + 1 :], (s, y, sy)]
        x, g = new, new_g
        values.append(f)
    return x


def _searched(x, f0, g0, d, t: float):
    """A point along ``d`` under the strong Wolfe conditions, or at least a
    lower one; None where there is none."""
    slope0 = g0 @ d
    low, f_low, slope_low, high, best = 0.0, f0, slope0, None, None
    for _ in range(20):
        f, g = yield x + t * d
        slope = g @ d
        if np.isfinite(f) and f <= f0 + 1e-4 * t * slope0:
            best = (x + t * d, f, g) if best is None or f < best[1] else best
            if abs(slope) <= 0.9 * abs(slope0):
                return x + t * d, f, g
        if not np.isfinite(f) or f > f0 + 1e-4 * t * slope0 or (low > 0 and f >= f_low):
            high = t
        elif slope >= 0:
            high, low, f_low, slope_low = (low if low > t else t), *((low, f_low, slope_low) if low < t else (t, f, slope))
        else:
            low, f_low, slope_low = t, f, slope
        if high is None:
            t *= 2.0 if low else 1.0
            continue
        # the parabola through the lower end and its slope, kept within the middle
        guess, span = low, high - low
        if np.isfinite(f) and t == high and (curve := f - f_low - slope_low * span) > 0:
            guess = low - slope_low * span * span / (2 * curve)
        t = min(max(guess, low + 0.1 * span), high - 0.1 * span) if guess != low else low + 0.5 * span
    return best


def fitted(rows: Rows, problems: list[Problem], weights: list[tuple[float, float]], strength: Callable[[float], float], loss: Callable, max_iter: int, tol: float) -> list[np.ndarray]:
    """Of each problem the coefficients (features, labels before, intercept) of
    least weighed mean loss plus half the strength (a function of the summed
    weights) times the coefficients' square.

    A table of many blocks is minimised over one block in WARM first, only for
    a start: what is returned is the result of up to ``max_iter`` steps over all rows."""
    points = [np.zeros(rows.width + len(p.before) + 1) for p in problems]
    if sum(rows.n.values()) >= WARM * WARM * ROWS:
        points = _minimised(rows, problems, points, weights, strength, loss, max_iter, tol, WARM)
    return _minimised(rows, problems, points, weights, strength, loss, max_iter, tol, 1)


def _minimised(rows, problems, starts, weights, strength, loss, max_iter, tol, every) -> list[np.ndarray]:
    asks = [lbfgs(x, max_iter, tol) for x in starts]
    points = {k: next(a) for k, a in enumerate(asks)}
    out: list = [None] * len(problems)
    while points:
        own = sorted(points)
        answers = rows.asked([problems[k] for k in own], [points[k] for k in own], [weights[k] for k in own], loss, every)
        for k, (value, gradient, total) in zip(own, answers):
            w, total = points[k], total or 1.0
            penalty = np.full(len(w), strength(total))
            penalty[-1] = 0.0
            try:
                points[k] = asks[k].send((value / total + 0.5 * float(penalty @ (w * w)), gradient / total + penalty * w))
            except StopIteration as end:
                out[k] = end.value
                del points[k]
    return out
