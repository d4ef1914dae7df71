"""Random forests of many labels grown together over sparse rows.

The forests are MLlib's in form and settings (Gini, 32 bins, depth 5, the root
of the features at a node, Poisson bootstrap, leaves of one decision merged),
but only the cells that are set are binned and counted: those that aren't are
a node's rows less these.  The rows are packed by column once.  A pass counts
the nodes of one level of many trees, for all labels; the counts are summed by
tree, and only the best splits reach the driver.  Trees of one number see the
same sample and the same features whatever the label, as they do in MLlib,
whose seed is the same for all.
"""

from __future__ import annotations

import json
import pickle
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, functions as F

ROWS = 1 << 14  # of a block
COUNTS = 96 << 20  # bytes of counts that a task keeps: so many trees share a pass
SHIFT, ZERO = 17, 1 << 14  # values are counted on a grid of 64 steps an octave; zero's place there


def places(values: np.ndarray) -> np.ndarray:
    """Places on the grid, in the order of the values."""
    bits = (values.astype(np.float32) + np.float32(0)).view(np.uint32)
    return (np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)) >> SHIFT).astype(np.uint16)


def edges(at: np.ndarray) -> np.ndarray:
    """The least values at places of the grid."""
    u = at.astype(np.uint32) << SHIFT
    return np.where(u >> 31, u & np.uint32((1 << 31) - 1), ~u).view(np.float32).astype(np.float64)


def parted(at: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """The first places of all bins but the least, and the places before them:
    each place is a bin where they are few enough, else zero is one, and the
    others have equal parts."""
    if len(at) <= bins:
        return np.array([at[1:], at[:-1]])
    zero = at == ZERO
    own = np.where(zero, 0, counts)
    part = ((np.cumsum(own) - own / 2) * (bins - 1) / own.sum()).astype(np.int64)
    new = (part[1:] != part[:-1]) | zero[1:] | zero[:-1]
    return np.array([at[1:][new], at[:-1][new]])


def threshold(first: int, before: int) -> float:
    """What parts two bins: the middle of the empty places between them, or just below the second one's least value."""
    low, high = edges(np.array([before + 1, first])).tolist()
    if low < high:
        return (low + high) / 2
    return float(np.nextafter((high + float(np.nextafter(np.float32(high), np.float32(-np.inf)))) / 2, -np.inf))


def by_column(x, y: np.ndarray, sparse):
    """Blocks of at most ROWS rows, their cells in the order of the columns."""
    row, at, v = sparse(x)
    ends = np.searchsorted(row, np.arange(len(y) + 1))
    sizes = x.field("size").to_numpy(zero_copy_only=False)
    width = int(np.where(np.isnan(sizes), np.diff(ends), sizes).max(initial=0))
    for start in range(0, len(y), ROWS):
        stop = min(start + ROWS, len(y))
        a, b = ends[start], ends[stop]
        order = np.argsort(at[a:b], kind="stable")
        yield {"y": y[start:stop], "width": width, "ptr": np.concatenate([[0], np.cumsum(np.bincount(at[a:b], minlength=width))]), "rows": (row[a:b] - start)[order].astype(np.uint16), "at": places(v[a:b][order])}


def joined(values: np.ndarray, starts, ends) -> np.ndarray:
    return np.concatenate([values[a:b] for a, b in zip(starts, ends)]) if len(starts) else values[:0]


@dataclass
class Trees:
    """Of each tree and label the nodes of a heap: the feature (-1: a leaf), the
    last bin that goes left, its gain and the sampled rows of each class."""

    feature: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    counts: np.ndarray
    open: np.ndarray  # nodes still to be split

    @classmethod
    def of(cls, trees: int, labels: int, depth: int) -> Trees:
        shape = (trees, labels, (2 << depth) - 1)
        opened = np.zeros(shape, bool)
        opened[:, :, 0] = True
        return cls(np.full(shape, -1, np.int32), np.zeros(shape, np.uint8), np.zeros(shape), np.zeros((*shape, 2), np.int64), opened)


def chosen(seed: int, tree: int, node: int, width: int, some: int) -> np.ndarray:
    return np.arange(width) if some >= width else np.random.default_rng((seed, tree, node)).choice(width, some, replace=False)


def routed(block, feature, last, zero, level: int) -> np.ndarray:
    """The node of every row, down to ``level``."""
    at = np.zeros(len(block["y"]), np.uint8)
    for e in range(level):
        nodes = np.arange((1 << e) - 1, (2 << e) - 1)
        nodes = nodes[feature[nodes] >= 0]
        if not len(nodes):
            break
        f = feature[nodes]
        then = np.arange(len(feature), dtype=np.uint8)
        then[nodes] = 2 * nodes + 1 + (zero[f] > last[nodes])
        starts, ends = block["ptr"][f], block["ptr"][f + 1]
        rows, node = joined(block["rows"], starts, ends), np.repeat(nodes, ends - starts)
        right = joined(block["bins"], starts, ends) > np.repeat(last[nodes], ends - starts)
        mine = at[rows] == node
        at = then[at]
        at[rows[mine]] = (2 * node + 1 + right)[mine]
    return at


def counted(block, trees: Trees, numbers, level: int, seed: int, subsets, zero, bins: int, totals: dict, cells: dict) -> None:
    """Adds a block's counts to those of the trees: of each open node by class,
    and by chosen feature, bin and class."""
    n, first, labels = len(block["y"]), (1 << level) - 1, block["y"].shape[1]
    for t in numbers:
        nodes, columns = subsets[t]
        if not len(nodes):
            continue
        k, some = columns.shape
        times = np.random.default_rng((seed, t, *block["seed"])).poisson(1.0, n).astype(np.uint8)
        flat = columns.ravel()
        starts, ends = block["ptr"][flat], block["ptr"][flat + 1]
        rows = joined(block["rows"], starts, ends)
        cell = np.repeat(np.arange(len(flat), dtype=np.int32) * (2 * bins), ends - starts) + 2 * joined(block["bins"], starts, ends).astype(np.int32)
        node = np.repeat(nodes.astype(np.uint8), np.add.reduceat(ends - starts, np.arange(k) * some))
        kept = np.flatnonzero(times[rows])
        rows, cell, node = rows[kept].astype(np.intp), cell[kept], node[kept]
        place = np.full(256, k, np.intp)
        place[nodes] = np.arange(k)
        for c in range(labels):
            open_ = trees.open[t, c, nodes]
            if not open_.any():
                continue
            at = routed(block, trees.feature[t, c], trees.bin[t, c], zero, level)
            y = block["y"][:, c]
            totals[t, c] = totals.get((t, c), 0) + np.bincount(2 * place[at] + y, times, 2 * k + 2)[: 2 * k].astype(np.int64)
            mine = np.flatnonzero(at[rows] == node)
            r = rows[mine]
            got = np.bincount(cell[mine] + y[r], times[r], len(flat) * 2 * bins)
            if (t, c) in cells:
                cells[t, c] += got.astype(np.uint32)
            else:
                cells[t, c] = got.astype(np.uint32)


def best(cells: np.ndarray, total: np.ndarray, columns: np.ndarray, zero: np.ndarray, weights) -> list[tuple]:
    """Of each node its best split: (gain, feature, last bin on the left, counts on the left)."""
    k, some = columns.shape
    counts = cells.reshape(k, some, -1, 2).astype(np.int64)
    i, j = np.indices((k, some))
    counts[i, j, zero[columns]] += total[:, None, :] - counts.sum(2)
    left = np.cumsum(counts, 2)[:, :, :-1]
    out = []
    for node in range(k):
        a, both = left[node] * weights, total[node] * weights
        b, n = both - a, both.sum()
        p, q = a.sum(-1), b.sum(-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            # the impurity is 2 x p0 x p1
            gain = 2 * (both[0] * both[1] / n - a[..., 0] * a[..., 1] / p - b[..., 0] * b[..., 1] / q) / n
        sizes = left[node].sum(-1)
        gain = np.where((sizes > 0) & (sizes < total[node].sum()), gain, -np.inf)
        f, s = np.unravel_index(gain.argmax(), gain.shape) if gain.size else (0, 0)
        out.append((float(gain[f, s]), int(columns[node, f]), int(s), left[node, f, s]) if gain.size else (-np.inf, 0, 0, total[node]))
    return out


class Packed:
    """A table's rows as kept blocks of binned cells."""

    def __init__(self, df: DataFrame, features: str, labels: tuple[str, ...], bins: int):
        from .models import _sparse

        sparse, n_labels = _sparse(), len(labels)
        self.sc, self.bins = df.sparkSession.sparkContext, bins
        rows = df.select(F.col(features).alias("x"), F.array(*(F.col(c).cast("double") for c in labels)).alias("y"))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if len(batch):
                    y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n_labels)
                    if np.isnan(y).any():
                        raise ValueError("a label is missing")
                    for block in by_column(batch.column(0), (y == 1).astype(np.uint8), sparse):
                        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

        placed = rows.mapInArrow(run, "block binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
        facts = placed.map(pickle.loads).map(lambda b: (len(b["y"]), b["y"].sum(0, dtype=np.int64), b["width"])).collect()
        self.n, self.positives = sum(x[0] for x in facts), sum((x[1] for x in facts), np.zeros(n_labels, np.int64))
        self.width = max((x[2] for x in facts), default=0)
        self.first, self.zero = self._bins(placed)
        self.most = max((len(x) for x in self.first), default=0) + 1
        now = self.sc.broadcast((self.first, self.zero))

        def binned(part, blocks):
            first, zero = now.value
            for number, packed in enumerate(blocks):
                block = pickle.loads(packed)
                at, ptr = block.pop("at"), block["ptr"]
                made = np.empty(len(at), np.uint8)
                for j in np.flatnonzero(np.diff(ptr)):
                    made[ptr[j] : ptr[j + 1]] = np.searchsorted(first[j], at[ptr[j] : ptr[j + 1]], "right")
                if len(ptr) <= len(zero):  # rows of dense vectors may be shorter
                    block["ptr"] = np.concatenate([ptr, np.full(len(zero) + 1 - len(ptr), ptr[-1])])
                yield pickle.dumps(block | {"bins": made, "seed": (part, number)}, 5)

        self.kept = placed.mapPartitionsWithIndex(binned).persist(StorageLevel.MEMORY_AND_DISK)
        self.kept.count()
        placed.unpersist()

    def _bins(self, placed) -> tuple[list[np.ndarray], np.ndarray]:
        """Of each feature the first places of its bins but the least, and zero's bin, from all rows."""
        parts, n, bins = max(1, self.sc.defaultParallelism), self.n, self.bins

        def count(blocks):
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for packed in blocks:
                block = pickle.loads(packed)
                code = np.repeat(np.arange(block["width"], dtype=np.int64) << 16, np.diff(block["ptr"])) | block["at"]
                own, times = np.unique(code, return_counts=True)
                keys, back = np.unique(np.concatenate([keys, own]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, times]), len(keys)).astype(np.int64)
            for p in range(parts):
                mine = (keys >> 16) % parts == p
                yield p, (keys[mine], counts[mine])

        def parted_(own):
            found = [x for _, x in own]
            if not found:
                return
            keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
            column, at = keys >> 16, (keys & 0xFFFF).astype(np.int64)
            starts = np.flatnonzero(np.diff(column, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                k, c = at[a:b], counts[a:b]
                if (rest := n - c.sum()) > 0 and ZERO not in k:  # the cells that aren't set
                    z = np.searchsorted(k, ZERO)
                    k, c = np.insert(k, z, ZERO), np.insert(c, z, rest)
                yield int(column[a]), parted(k, c, bins).astype(np.uint16)

        first, self.thresholds = [np.zeros(0, np.uint16)] * self.width, {}
        for j, x in placed.mapPartitions(count).partitionBy(parts, int).mapPartitions(parted_).collect():
            first[j], self.thresholds[j] = x[0], x
        zero = np.zeros(self.width, np.int64)
        for j in self.thresholds:
            zero[j] = np.searchsorted(first[j], ZERO, "right")
        return first, zero

    def level(self, trees: Trees, numbers: list[int], level: int, seed: int, some: int, weights: np.ndarray) -> list[tuple]:
        """(tree, label, node, best split, counts) of the open nodes of a level."""
        first, zero, most, width = (1 << level) - 1, self.zero, self.most, self.width
        own = {t: first + np.flatnonzero(trees.open[t, :, first : 2 * first + 1].any(0)) for t in numbers}
        now = self.sc.broadcast((trees, own, zero, weights))

        def columns(t, nodes):
            return np.array([chosen(seed, t, int(node), width, some) for node in nodes], np.int64).reshape(len(nodes), -1)

        def count(blocks):
            trees, own, zero, _ = now.value
            subsets = {t: (nodes, columns(t, nodes)) for t, nodes in own.items()}
            totals, cells = {}, {}
            for packed in blocks:
                counted(pickle.loads(packed), trees, numbers, level, seed, subsets, zero, most, totals, cells)
            for key in list(cells):
                got = cells.pop(key)
                at = np.flatnonzero(got)
                yield key[0] * 4096 + key[1], (at.astype(np.uint32), got[at].astype(np.min_scalar_type(got.max(initial=0))), totals[key])

        def split(found):
            trees, own, zero, weights = now.value
            sums: dict = {}
            for key, (at, n, total) in found:
                t = key // 4096
                if key not in sums:
                    sums[key] = [np.zeros(len(own[t]) * some * most * 2, np.int64), 0]
                sums[key][0][at] += n
                sums[key][1] = sums[key][1] + total
            for key in list(sums):
                (t, c), (cells, total) = divmod(key, 4096), sums.pop(key)
                total = total.reshape(-1, 2)
                for node, one, n in zip(own[t], best(cells, total, columns(t, own[t]), zero, weights[c]), total):
                    if trees.open[t, c, node]:
                        yield t, c, int(node), one, n

        parts = max(1, min(self.sc.defaultParallelism, len(numbers) * len(weights)))
        out = self.kept.mapPartitions(count).partitionBy(parts, lambda key: key // 4096 + key % 4096).mapPartitions(split).collect()
        now.unpersist()
        return out


def grown(df: DataFrame, labels: tuple[str, ...], features: str, count: int, seed: int, depth: int = 5, bins: int = 32) -> list[RandomForestClassificationModel | float]:
    """A forest for each label; of a label that all rows have or none, 1.0 or 0.0."""
    rows = Packed(df, features, labels, bins)
    some = rows.width if count == 1 else int(np.ceil(np.sqrt(rows.width)))
    usual = [c for c in range(len(labels)) if 0 < rows.positives[c] < rows.n]
    weights = np.array([(rows.n / (2.0 * (rows.n - p)), rows.n / (2.0 * p)) if 0 < p < rows.n else (1.0, 1.0) for p in rows.positives])
    trees = Trees.of(count, len(labels), depth)
    trees.open[:, [c for c in range(len(labels)) if c not in usual]] = False
    for level in range(depth):
        each = max(1, COUNTS // (4 * len(labels) * some * rows.most * 2 << level))
        busy = [t for t in range(count) if trees.open[t, :, (1 << level) - 1 : (2 << level) - 1].any()]
        for start in range(0, len(busy), each):
            for t, c, node, (gain, feature, last, left), n in rows.level(trees, busy[start : start + each], level, seed, some, weights):
                trees.counts[t, c, node], trees.open[t, c, node] = n, False
                if gain <= 0:
                    continue
                trees.feature[t, c, node], trees.bin[t, c, node], trees.gain[t, c, node] = feature, last, gain
                for child, own in ((2 * node + 1, left), (2 * node + 2, n - left)):
                    trees.counts[t, c, child] = own
                    trees.open[t, c, child] = level + 1 < depth and (own > 0).all()
    rows.kept.unpersist()
    with ThreadPoolExecutor(max(1, len(usual))) as pool:
        made = dict(zip(usual, pool.map(lambda c: model(df, trees, c, weights[c], rows.thresholds, features, labels[c], count, seed, depth, bins, rows.width), usual)))
    return [made.get(c, float(rows.positives[c] > 0)) for c in range(len(labels))]


def nodes_of(feature, gain, sampled, stats, cuts) -> list[dict]:
    """A tree's nodes as MLlib writes them, leaves of one decision merged; of lists over the heap."""
    said = {}  # of each leaf, also of merged ones
    for node in range(len(feature) - 1, -1, -1):
        left, right = 2 * node + 1, 2 * node + 2
        if feature[node] < 0 or left in said and right in said and said[left] == said[right]:
            said[node] = float(stats[node][1] > stats[node][0])
    out: list[dict] = []

    def add(node: int) -> int:
        (a, b), number = stats[node], len(out)
        own = {"id": number, "prediction": float(b > a), "impurity": 2 * a * b / (a + b) ** 2 if a + b else 0.0, "impurityStats": [a, b], "rawCount": sampled[node], "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        out.append(own)
        if node not in said:
            own |= {"gain": gain[node], "split": {"featureIndex": feature[node], "leftCategoriesOrThreshold": [cuts[node]], "numCategories": -1}}
            own["leftChild"] = add(2 * node + 1)
            own["rightChild"] = add(2 * node + 2)
        return number

    add(0)
    return out


_NODE = "struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"


def model(df: DataFrame, trees: Trees, c: int, weights, places_of, features: str, label: str, count: int, seed: int, depth: int, bins: int, width: int) -> RandomForestClassificationModel:
    """MLlib's model of these trees, which it reads from its own form."""
    import pyarrow as pa

    spark, package = df.sparkSession, "org.apache.spark.ml.classification."
    common = {"featuresCol": features, "labelCol": label, "maxBins": bins, "maxDepth": depth, "seed": seed}

    def facts(kind: str, **more) -> dict:
        return {"class": package + kind, "timestamp": 0, "sparkVersion": spark.version, "uid": f"{kind}_{uuid.uuid4().hex[:12]}", "defaultParamMap": {"predictionCol": "prediction", "probabilityCol": "probability", "rawPredictionCol": "rawPrediction", "leafCol": "", "impurity": "gini"}} | more

    feature, counts = trees.feature[:, c], trees.counts[:, c]
    cuts = np.zeros(feature.shape)
    for at in zip(*np.nonzero(feature >= 0)):
        cuts[at] = threshold(*map(int, places_of[feature[at]][:, trees.bin[:, c][at]]))
    nodes = [nodes_of(*one) for one in zip(feature.tolist(), trees.gain[:, c].tolist(), counts.sum(-1).tolist(), (counts * weights).tolist(), cuts.tolist())]
    own = [json.dumps(facts("DecisionTreeClassificationModel", paramMap=common, numFeatures=width, numClasses=2)) for _ in nodes]
    whole = facts("RandomForestClassificationModel", paramMap=common | {"numTrees": count}, numFeatures=width, numClasses=2, numTrees=count)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp()
    path = f"{base}/forest-{uuid.uuid4().hex}"
    flat = pa.table({"treeID": pa.array([t for t, x in enumerate(nodes) for _ in x], pa.int32()), "nodeData": pa.array([y for x in nodes for y in x])})
    spark.createDataFrame(flat, f"treeID int, nodeData {_NODE}").coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame([(t, text, 1.0) for t, text in enumerate(own)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    out = RandomForestClassificationModel.load(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return out
