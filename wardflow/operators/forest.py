"""Random forests of several feature lists, grown together (M2, M8).

The method is that of ``RandomForestClassifier``: a tree sees every row as often
as a Poisson(1) draw says, a node looks for its cut among ``ceil(sqrt(n))`` features
drawn for it, cuts are judged by Gini impurity, both sides keep ``min_rows`` drawn
rows, leaves of one parent that name the same class become one, and a row's
probabilities are the mean class shares of its leaves.  With a weight a class the
impurities, shares and names of nodes are those of weighted rows; ``min_rows``
still counts drawn rows.

Features are cut into bins once (as for boosting) and the table holds blocks of
rows, a byte a feature and row, with the class folded into it.  A level of *all*
trees of *all* forests is one pass: each task adds up drawn rows by node, drawn
feature, bin and class, one tree after the other, so it holds the cells of one
tree; Spark brings the cells of a stretch of nodes together, where they are summed
and the best cuts are found.  The driver sees a row a node, never cells or rows.
Draws belong to (seed, block, tree): each pass makes them anew, all the same, and
tree ``i`` of every forest is grown on the same rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions.scalar import map_lookup
from wardflow.operators.boosting import BINS, _cuts
from wardflow.session import write_table

#: Rows of a block, rows whose path is followed at once, rows of a file, and nodes whose cells travel together.
BLOCK, AT_ONCE, FILE_ROWS, STRETCH = 4096, 1 << 14, 500_000, 256
#: Least and most rows that a task adds up at once: few stay in the cache, many are worth a table of cells.
LEAST, MOST = 1 << 15, 1 << 18
#: Poisson(1) by a uniform 16-bit number.
_POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(i) for i in range(8)]),
                           (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
#: The least number of each count over 0.
_STEPS = np.searchsorted(_POISSON, np.arange(1, _POISSON.max() + 1)).astype(np.uint16)


def _draws(seed: int, block: int, tree: int, rows: int) -> np.ndarray:
    """How often the tree sees each row of the block."""
    number = np.random.default_rng([seed, block, tree]).integers(0, 1 << 16, rows, np.uint16)
    out = (number >= _STEPS[0]).view(np.uint8)
    for step in _STEPS[1:]:
        out += number >= step
    return out


def _nodes_of(x: np.ndarray, start: np.ndarray, feature: np.ndarray, bound: np.ndarray, depth: int) -> np.ndarray:
    """Node (heap order, root 1) that each row reaches after ``depth`` steps; a leaf's rows go on to its left."""
    if not depth:
        return np.ones(len(start), np.int64)
    at = (x.take(start + int(feature[1])) > bound[1]).astype(np.int64)
    at += 2
    for _ in range(depth - 1):
        place = feature.take(at)
        place += start
        right = x.take(place) > bound.take(at)
        at += at
        at += right
    return at


def kind_of(classes: int):
    return np.uint8 if BINS * classes < 256 else np.uint16


def coded(columns: list, cuts: list[np.ndarray]) -> np.ndarray:
    """(rows, features) bins; an unknown value is over every cut."""
    out = np.empty((len(columns[0]), len(cuts)), np.intp)
    for i, c in enumerate(columns):
        out[:, i] = np.searchsorted(cuts[i], c.to_numpy(zero_copy_only=False).astype(np.float64))
    return out


@dataclass
class Forest:
    """Trees in heap order: by tree and node the feature, the last code that goes left, and the class shares."""

    features: list[str]
    classes: list[str]
    cuts: list[np.ndarray]
    feature: np.ndarray
    bound: np.ndarray
    shares: np.ndarray
    importances: np.ndarray | None = None
    total_nodes: int = 0
    params: dict = field(default_factory=dict)

    #: The method's name in model metadata.
    algorithm = "RandomForestClassificationModel"

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line, and a row a tree."""
        rest = {"features": self.features, "classes": self.classes, "cuts": [c.tolist() for c in self.cuts],
                "importances": self.importances.tolist(), "total_nodes": self.total_nodes, "params": self.params,
                "kind": self.bound.dtype.str}
        trees = [(i, *(bytearray(v[i].tobytes()) for v in (self.feature, self.bound, self.shares)))
                 for i in range(len(self.feature))]
        spark.range(1).select(F.lit(json.dumps(rest)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/forest")
        spark.createDataFrame(trees, "tree int, feature binary, bound binary, shares binary").write.mode("overwrite") \
            .parquet(f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        rest = json.loads(spark.read.text(f"{path}/forest").first()["value"])
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()  # a row a tree
        kind, k = rest.pop("kind"), len(rest["classes"])
        rest |= {"cuts": [np.array(c, np.float64) for c in rest["cuts"]], "importances": np.array(rest["importances"])}
        read = lambda name, kind: np.stack([np.frombuffer(r[name], kind) for r in rows])
        shares = read("shares", np.float64).reshape(len(rows), -1, k)
        return Forest(**rest, feature=read("feature", np.int16), bound=read("bound", kind), shares=shares)

    def probabilities(self) -> Column:
        """Mean class shares of a row's leaves, in class order."""
        cuts, feature, bound, shares = self.cuts, self.feature, self.bound, self.shares
        depth, k = feature.shape[1].bit_length() - 2, len(self.classes)

        @F.arrow_udf("array<double>")
        def scores(*columns: pa.Array) -> pa.Array:
            x = (coded(columns, cuts) * k).astype(kind_of(k))
            start, found = np.arange(len(x), dtype=np.int64) * x.shape[1], np.zeros((len(x), k))
            for f, b, s in zip(feature, bound, shares, strict=True):
                found += s.take(_nodes_of(x.ravel(), start, f.astype(np.int64), b, depth), axis=0)
            found /= np.maximum(found.sum(axis=1, keepdims=True), 1e-300)  # a tree without a drawn row has no say
            ends = np.arange(len(x) + 1, dtype=np.int32) * k
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

        return scores(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features])


def _blocks(rows: DataFrame, features: list[str], cuts: list[np.ndarray], k: int) -> DataFrame:
    """Blocks of rows: number, and the codes (bin * classes + class) of all features row by row."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            codes = coded([b.column(f) for f in features], cuts) * k + b.column("_y").to_numpy()[:, None]
            codes = codes.astype(kind_of(k))
            for at in range(0, len(codes), BLOCK):
                yield pa.record_batch([pa.array([number]), pa.array([codes[at:at + BLOCK].tobytes()], pa.binary())], ["block", "codes"])
                number += 1

    return rows.mapInArrow(run, "block long, codes binary")


def _cells(blocks: DataFrame, trees: int, seed: int, depth: int, width: int, k: int,
           feature: np.ndarray, bound: np.ndarray, slot: np.ndarray, picked: list[np.ndarray]) -> DataFrame:
    """Cells of each task by tree and stretch of open nodes: drawn rows by drawn feature, node, bin and class.

    ``slot`` numbers the open nodes of each tree's level (-1: closed), ``picked`` holds their features.
    """
    kind = kind_of(k)

    def run(batches):
        found = [(block, np.frombuffer(codes, kind)) for b in batches
                 for block, codes in zip(b.column("block").to_pylist(), b.column("codes").to_pylist(), strict=True)]
        if not found:
            return
        x = np.concatenate([codes for _, codes in found])
        sizes = [(block, len(codes) // width) for block, codes in found]
        del found
        for tree in range(trees):
            mine = [t for t in range(tree, len(picked), trees) if len(picked[t])]
            if not mine:
                continue
            tables, total = {}, {}
            for t in mine:  # by node: the first cell (-1: closed), and the drawn features
                n, each = picked[t].shape
                cell, own = np.full(2 << depth, -1), np.zeros((each, 2 << depth), np.int64)
                cell[1 << depth:] = np.where(slot[t] < 0, -1, slot[t] * (BINS * k))
                own[:, np.flatnonzero(slot[t] >= 0) + (1 << depth)] = picked[t].T
                tables[t] = cell, own, feature[t].astype(np.int64)
                total[t] = np.zeros((each, n * BINS * k))
            most = min(max(2 * max(v.shape[1] for v in total.values()), LEAST), MOST)
            at = first = 0  # block, row
            while at < len(sizes):
                drawn, last = [], first
                while at < len(sizes) and (not drawn or last - first < most):
                    drawn.append(_draws(seed, sizes[at][0], tree, sizes[at][1]))
                    last += sizes[at][1]
                    at += 1
                drawn = np.concatenate(drawn)
                start = np.flatnonzero(drawn != 0)
                weight = drawn.take(start).astype(np.float64)
                start *= width
                here = x[first * width:last * width]
                first = last
                for t in mine:
                    cell, own, f = tables[t]
                    node = np.concatenate([_nodes_of(here, start[i:i + AT_ONCE], f, bound[t], depth)
                                           for i in range(0, len(start), AT_ONCE)] or [np.empty(0, np.int64)])
                    base, begin, w = cell.take(node), start, weight
                    inside = base >= 0
                    if not inside.all():
                        base, begin, w, node = base[inside], begin[inside], w[inside], node[inside]
                    for j, one in enumerate(own):
                        place = one.take(node)
                        place += begin
                        total[t][j] += np.bincount(base + here.take(place), w, total[t].shape[1])
            for t in mine:
                n, each = picked[t].shape
                cells = total.pop(t)
                top = cells.max()
                size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
                cells = cells.astype(f"u{size}").reshape(each, n, BINS * k)
                parts = range(0, n, STRETCH)
                yield pa.record_batch(
                    [pa.array([t] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()),
                     pa.array([size] * len(parts), pa.int32()),
                     pa.array([cells[:, i:i + STRETCH].tobytes() for i in parts], pa.binary())],
                    ["tree", "part", "size", "cells"])

    return blocks.mapInArrow(run, "tree int, part int, size int, cells binary")


def _purity(counts: np.ndarray) -> np.ndarray:
    """Rows less rows times Gini impurity, of counts by class."""
    return (counts ** 2).sum(axis=-1) / np.maximum(counts.sum(axis=-1), 1e-300)


def _best_cuts(cells: np.ndarray, min_rows: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of cells by node, feature, bin and class: place of the best feature (-1: none), bin, class counts left and in all."""
    left = cells.cumsum(axis=2)
    total = left[:, 0, -1]
    right = total[:, None, None] - left
    n, rest = left.sum(axis=3), right.sum(axis=3)
    if weights is None:
        score = _purity(left) + _purity(right)
    else:
        score = _purity(left * weights) + _purity(right * weights)
    score[(n < max(min_rows, 1)) | (rest < max(min_rows, 1))] = -np.inf
    flat = score.reshape(len(cells), -1)
    best = flat.argmax(axis=1)
    heavy = total if weights is None else total * weights
    each, size = np.arange(len(cells)), heavy.sum(axis=1)
    gain = flat[each, best] - _purity(heavy)
    place, cut = best // cells.shape[2], best % cells.shape[2]
    return np.where(gain > 1e-9 * size, place, -1), cut, left[each, place, cut], total


def _level(cells: DataFrame, k: int, min_rows: int, picked: list[np.ndarray],
           weights: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """A row a node: tree, number of the open node, feature (-1: none), bin, class counts left and in all."""
    names = ["tree", "slot", "feature", "cut", *[f"{s}{c}" for s in "lt" for c in range(k)]]

    def best(key, table):
        tree, part = (v.as_py() for v in key)
        own = picked[tree][part * STRETCH:(part + 1) * STRETCH].astype(np.int64)
        found = np.zeros(own.size * BINS * k)
        for size, one in zip(table.column("size").to_pylist(), table.column("cells"), strict=True):
            found += np.frombuffer(one.as_buffer(), f"u{size}")
        place, cut, left, total = _best_cuts(found.reshape(*own.T.shape, BINS, k).swapaxes(0, 1), min_rows, weights)
        feature = np.where(place < 0, -1, own[np.arange(len(own)), place])
        slots = part * STRETCH + np.arange(len(own))
        return pa.table([np.full(len(own), tree), slots, feature, cut, *left.T, *total.T], names)

    schema = "tree long, slot long, feature long, cut long, " + ", ".join(f"{n} double" for n in names[4:])
    rows = cells.groupBy("tree", "part").applyInArrow(best, schema).toArrow()
    columns = [rows.column(n).to_numpy() for n in names]
    return *columns[:4], np.column_stack(columns[4:4 + k]), np.column_stack(columns[4 + k:])


def _joined(feature: np.ndarray, counts: np.ndarray, depth: int) -> None:
    """Makes a leaf of each node whose children are leaves of the same class, from below."""
    named = counts.argmax(axis=2)
    for level in range(depth - 1, -1, -1):
        at = np.arange(1 << level, 2 << level)
        a, b = 2 * at, 2 * at + 1
        same = (feature[:, at] >= 0) & (feature[:, a] < 0) & (feature[:, b] < 0) & (named[:, a] == named[:, b])
        feature[:, at] = np.where(same, -1, feature[:, at])


def _gains(feature: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Impurity times rows that the cuts of each tree take away, by feature."""
    out = np.zeros((len(feature), width))
    at = np.arange(1, feature.shape[1] // 2)
    gain = _purity(counts[:, 2 * at]) + _purity(counts[:, 2 * at + 1]) - _purity(counts[:, at])
    tree, place = np.nonzero(feature[:, at] >= 0)
    np.add.at(out, (tree, feature[tree, at[place]]), gain[tree, place])
    return out


def _importances(gains: np.ndarray) -> np.ndarray:
    """Mean share of each feature in the gain of a tree, as shares of their sum."""
    total = (gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
    return total / max(total.sum(), 1e-300)


def _class_weights(rows: DataFrame, weight_col: str, k: int) -> np.ndarray:
    """The weight of each class (0 without rows)."""
    found = rows.groupBy("_y").agg(F.min(weight_col).alias("low"), F.max(weight_col).alias("high"),
                                   F.count_if(F.col(weight_col).isNull()).alias("unknown")).collect()  # a row a class
    out = np.zeros(k)
    for r in found:
        if r["unknown"] or r["low"] != r["high"] or not r["low"] >= 0:
            raise ValueError(f"rows of one class differ in {weight_col}, or it is unknown or negative")
        out[r["_y"]] = r["low"]
    return out


def fit_forests(train: DataFrame, feature_sets: list[list[str]], label: str, classes: list[str], trees: int = 100,
                max_depth: int = 10, min_rows: int = 5, seed: int = 42, weight_col: str | None = None) -> list[Forest]:
    """A forest a feature list, of the rows with a known label.

    The weights of ``weight_col`` are those of the classes: rows of one class have one weight.
    """
    k, every = len(classes), list(dict.fromkeys(f for one in feature_sets for f in one))
    code = map_lookup({c: i for i, c in enumerate(classes)}, F.col(label), "int")
    # unknown values as NaN, which is over every cut
    rows = train.withColumn("_y", code).where("_y is not null").select(
        "_y", *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f) for f in every])
    weights = None
    if weight_col:
        weights = _class_weights(train.withColumn("_y", code).where("_y is not null"), weight_col, k)
    n_rows = rows.count()
    if not n_rows:
        raise ValueError("no row has a known label")
    cuts = _cuts(rows, every, n_rows, seed)
    files = max(train.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / FILE_ROWS))
    blocks = write_table(_blocks(rows, every, cuts, k).repartition(files))

    kind = kind_of(k)
    lists = [np.array([every.index(f) for f in one]) for one in feature_sets]
    each = [math.ceil(math.sqrt(len(one))) for one in lists]
    n, heap = trees * len(lists), 2 << max_depth
    feature, counts = np.full((n, heap), -1, np.int16), np.zeros((n, heap, k))
    bound = np.full((n, heap), np.iinfo(kind).max, kind)
    opened = np.ones((n, 1), bool)  # nodes of the level to cut
    for depth in range(max_depth):
        rng = np.random.default_rng([seed, depth])
        picked = []
        for t in range(n):
            own = lists[t // trees]
            order = rng.random((int(opened[t].sum()), len(own))).argsort(axis=1)[:, :each[t // trees]]
            picked.append(own[order].astype(np.int16))
        slot = np.where(opened, opened.cumsum(axis=1) - 1, -1)
        nodes = [np.flatnonzero(o) + (1 << depth) for o in opened]
        upper = np.maximum(feature[:, :1 << depth], 0)
        cells = _cells(blocks, trees, seed, depth, len(every), k, upper, bound[:, :1 << depth], slot, picked)
        tree, at, f, cut, left, total = _level(cells, k, min_rows, picked, weights)
        first = np.cumsum([0, *map(len, nodes)])
        at = np.concatenate(nodes)[first[tree] + at]
        counts[tree, at] = total
        split = f >= 0
        tree, at, f, cut, left, total = (v[split] for v in (tree, at, f, cut, left, total))
        feature[tree, at], bound[tree, at] = f, cut * k + k - 1
        counts[tree, 2 * at], counts[tree, 2 * at + 1] = left, total - left
        below = counts[:, 2 << depth:4 << depth]
        opened = ((below > 0).sum(axis=2) > 1) & (below.sum(axis=2) >= 2 * max(min_rows, 1))
        if not opened.any():
            break
    if weights is not None:
        counts *= weights
    _joined(feature, counts, max_depth)
    gains = _gains(feature, counts, len(every))
    inner = (feature >= 0).sum(axis=1)
    bound[feature < 0] = np.iinfo(kind).max
    shares = counts / np.maximum(counts.sum(axis=2, keepdims=True), 1e-300)
    # a leaf's rows go on to its left as far as the lowest level
    for level in range(max_depth):
        at = np.arange(1 << level, 2 << level)
        shares[:, 2 * at] = np.where(feature[:, at, None] < 0, shares[:, at], shares[:, 2 * at])
        feature[:, 2 * at] = np.where(feature[:, at] < 0, -1, feature[:, 2 * at])
        bound[:, 2 * at] = np.where(feature[:, at] < 0, np.iinfo(kind).max, bound[:, 2 * at])
    out = []
    for i, (names, own) in enumerate(zip(feature_sets, lists, strict=True)):
        mine = slice(i * trees, (i + 1) * trees)
        place = np.zeros(len(every), np.int16)
        place[own] = np.arange(len(own))
        local = np.where(feature[mine] < 0, 0, place[np.maximum(feature[mine], 0)]).astype(np.int16)
        params = {"numTrees": trees, "maxDepth": max_depth, "minInstancesPerNode": min_rows, "seed": seed}
        out.append(Forest(list(names), list(classes), [cuts[f] for f in own], local, bound[mine], shares[mine],
                          _importances(gains[mine][:, own]), int((2 * inner[mine] + 1).sum()), params))
    return out
