"""Leading singular vectors of a table's sparse rows, and rows in their directions.

The rows are packed once into blocks, which are kept serialised.  A pass
multiplies all of them with a block of vectors and sends back one product a
task; the block Lanczos method on the driver, whose basis is kept orthogonal in
full, asks for passes until the directions have converged.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

ROWS = 1024  # of a block
DENSE = 48  # a block's columns that are set in one row of so many or more are multiplied as a dense matrix
VECTORS = 50  # of a pass: what each task sends back


def blocks_of(row: np.ndarray, at: np.ndarray, v: np.ndarray, n: int):
    """Blocks of at most ROWS of ``n`` rows, from the cells' rows (ascending), columns and values."""
    ends = np.searchsorted(row, np.arange(0, n + ROWS, ROWS))
    for start, a, b in zip(range(0, n, ROWS), ends, ends[1:]):
        rows, r, c, x = min(ROWS, n - start), row[a:b] - start, at[a:b], v[a:b]
        found = np.bincount(c, minlength=1) * DENSE >= rows
        often, dense = np.flatnonzero(found), found[c]
        r, c, x, cells, u, sizes = r[~dense], c[~dense], x[~dense], np.searchsorted(often, c[dense]), x[dense], np.bincount(r[dense], minlength=rows)
        order = np.argsort(c, kind="stable")
        yield {
            "n": rows, "often": often, "sizes": sizes, "cells": cells.astype(np.uint16 if len(often) <= 1 << 16 else np.int32), "u": u,
            "rest": (r.astype(np.int16), c.astype(np.int32), x), "back": (c[order].astype(np.int32), r[order].astype(np.int16), x[order]),
        }


class Space:
    """Memory that is used again from block to block."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def take(self, name: str, *shape: int) -> np.ndarray:
        n = int(np.prod(shape))
        if name not in self.kept or len(self.kept[name]) < n:
            self.kept[name] = np.empty(n)
        return self.kept[name][:n].reshape(shape)


def opened(block: dict, space: Space) -> np.ndarray:
    """The block's dense part."""
    n, width = block["n"], len(block["often"])
    out = space.take("dense", n, width)
    out.fill(0)
    # a row has a column once
    out.ravel()[np.repeat(np.arange(n) * width, block["sizes"]) + block["cells"]] = block["u"]
    return out


def _add_cells(to: np.ndarray, where: np.ndarray, source: np.ndarray, of: np.ndarray, v: np.ndarray, space: Space) -> None:
    """Adds to the rows ``where`` (ascending) of ``to`` those ``of`` of ``source``, times ``v``."""
    if not len(v):
        return
    firsts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    some = max(1, (1 << 18) // source.shape[1])  # what the processor's cache holds
    cuts = np.unique(np.r_[np.searchsorted(firsts, np.arange(0, len(v), some)), len(firsts)])
    ends = np.r_[firsts, len(v)]
    for a, b in zip(cuts, cuts[1:]):
        start, end = ends[a], ends[b]
        kept = space.take("cells", end - start, source.shape[1])
        np.take(source, of[start:end], axis=0, out=kept, mode="clip")
        kept *= v[start:end, None]
        to[where[firsts[a:b]]] += np.add.reduceat(kept, firsts[a:b] - start)


def product(block: dict, dense: np.ndarray, table: np.ndarray, space: Space) -> np.ndarray:
    """The block's rows times ``table``."""
    often = space.take("often", len(block["often"]), table.shape[1])
    np.take(table, block["often"], axis=0, out=often, mode="clip")
    out = dense @ often
    row, at, v = block["rest"]
    _add_cells(out, row, table, at, v, space)
    return out


def add_back(block: dict, dense: np.ndarray, z: np.ndarray, total: np.ndarray, space: Space) -> None:
    """Adds the transposed block times ``z`` to ``total``."""
    often = space.take("often", len(block["often"]), z.shape[1])
    total[block["often"]] += np.matmul(dense.T, z, out=often)
    at, row, v = block["back"]
    _add_cells(total, at, z, row, v, space)


class Rows:
    """A table's rows as kept blocks."""

    def __init__(self, df: DataFrame, features: str):
        from .models import _sparse

        sparse = _sparse()

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if not len(batch):
                    continue
                own = batch.column(0)
                row, at, v = sparse(own)
                sizes = own.field("size").to_numpy(zero_copy_only=False)
                width = int(np.where(np.isnan(sizes), np.bincount(row, minlength=len(batch)), sizes).max())
                for block in blocks_of(row, at, v, len(batch)):
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block | {"width": width}, 5)], pa.binary())], names=["block"])

        self.sc = df.sparkSession.sparkContext
        self.kept = df.select(F.col(features).alias("x")).mapInArrow(run, "block binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
        widths = self.kept.map(lambda packed: pickle.loads(packed)["width"]).collect()
        if not widths:
            raise ValueError("there are no rows")
        self.width = max(widths)
        # a task a core: a pass sends one product a task
        self.few = self.kept.coalesce(max(1, min(self.kept.getNumPartitions(), self.sc.defaultParallelism)))

    def asked(self, vectors: np.ndarray) -> np.ndarray:
        """The rows' transposed product with their product with ``vectors``."""
        now = self.sc.broadcast(vectors)

        def one(blocks):
            q, space = now.value, Space()
            total = np.zeros(q.shape)
            for block in map(pickle.loads, blocks):
                dense = opened(block, space)
                add_back(block, dense, product(block, dense, q, space), total, space)
            return [total]

        made = self.few.mapPartitions(one)
        out = made.treeReduce(np.add) if made.getNumPartitions() > 16 else reduce(np.add, made.collect())
        now.destroy()
        return out

    def drop(self) -> None:
        self.kept.unpersist()


def lanczos(asked: Callable[[np.ndarray], np.ndarray], size: int, width: int, vectors: int = VECTORS, most: int = 0, tol: float = 1e-8, seed: int = 0) -> np.ndarray:
    """The eigenvectors of the ``width`` largest eigenvalues, a column each, of
    the symmetric matrix without negative eigenvalues that ``asked`` multiplies
    with vectors; fewer where its rank is less.

    It ends when what each vector's product has outside the vector is ``tol`` of
    the least of the eigenvalues.  A basis of more than ``most`` vectors is
    reduced to the leading ones.  Where a start's products are used up, random
    vectors take their place: an eigenvalue may come more often than a block
    has vectors, so then a whole new start must find nothing new.  (Where products
    don't run out, no more than ``vectors`` of one eigenvalue's are found.)"""
    rng = np.random.default_rng(seed)
    width, vectors = min(width, size), min(vectors, size)
    basis = np.empty((min(size, max(most or 10 * width, width + 4 * vectors)), size))
    q, link, inner, m = np.linalg.qr(rng.normal(size=(size, vectors)))[0], np.zeros((vectors, 0)), np.zeros((0, 0)), 0
    replaced, seen, steps, longest = False, None, 0, 0
    while True:
        rest = asked(q)
        b, own, steps = q.shape[1], q.T @ rest, steps + 1
        inner = np.block([[inner, link.T], [link, (own + own.T) / 2]])
        basis[m : m + b] = q.T
        m += b
        values, mix = np.linalg.eigh(inner)
        values, mix = values[::-1], mix[:, ::-1]
        for _ in range(2):
            rest -= basis[:m].T @ (basis[:m] @ rest)
        q, r = np.linalg.qr(rest)
        u, d, w = np.linalg.svd(r)
        room = min(vectors, size - m)
        good = min(int((d > 1e-13 * values[0]).sum()), room)
        q, r, k = q @ u[:, :good], d[:good, None] * w[:good], min(width, m)
        replaced |= good < min(b, room)
        error = np.linalg.norm(r @ mix[-b:, :k], axis=0).max(initial=0.0)
        done = m == size
        if not done and m >= width and error <= max(tol * values[k - 1], 1e-13 * values[0]):
            same = seen is not None and np.abs(seen - values[:k]).max() <= 1e-6 * max(values[k - 1], 1e-6 * values[0])
            done = not replaced or (same and (not good or steps >= longest))
            if not done and (not good or steps >= longest):
                seen, longest, steps, good, q, r = values[:k].copy(), max(longest, steps), 0, 0, q[:, :0], r[:0]
        if done:
            # below this, an eigenvalue can't be told from none
            return (mix[:, : max(1, int((values[:k] > 1e-14 * values[0]).sum()))].T @ basis[:m]).T
        last = mix[-b:]
        if m + room > len(basis):
            m = min(width + vectors, len(basis) - room)
            basis[:m] = mix[:, :m].T @ basis[: len(mix)]
            inner, link = np.diag(values[:m]), r @ last[:, :m]
        else:
            link = np.hstack([np.zeros((good, m - b)), r])
        q = np.hstack([q, rng.normal(size=(size, room - good))])
        q[:, good:] /= np.linalg.norm(q[:, good:], axis=0)
        link = np.vstack([link, np.zeros((room - good, m))])
        for _ in range(1 if good == room else 2):
            q -= basis[:m].T @ (basis[:m] @ q)
            q, r = np.linalg.qr(q)
            link = r @ link


def directions(df: DataFrame, features: str, width: int) -> np.ndarray:
    """The ``width`` leading right singular vectors of the features (as they stand, not centred), a column each."""
    rows = Rows(df, features)
    out = lanczos(rows.asked, rows.width, width)
    rows.drop()
    return out


def reduced(df: DataFrame, features: str, table: np.ndarray, out: str = "reduced") -> DataFrame:
    """The other columns of ``df`` with ``out``, the features in the directions of ``table``, as an array."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    from .models import _sparse

    kept, sparse = df.sparkSession.sparkContext.broadcast(table), _sparse()

    def project(batches):
        table, space = kept.value, Space()
        for batch in batches:
            if not len(batch):
                continue
            row, at, v = sparse(batch.column(1))
            made = np.concatenate([product(block, opened(block, space), table, space) for block in blocks_of(row, at, v, len(batch))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "p"])

    rows = df.select(F.struct(*(c for c in df.columns if c != features)).alias("row"), F.col(features).alias("x"))
    made = rows.mapInArrow(project, StructType([StructField("row", rows.schema["row"].dataType), StructField("p", ArrayType(DoubleType()))]))
    return made.select("row.*", F.col("p").alias(out))
