"""Gradient boosting on the softmax loss (M4), one regression tree a class and round.

The scores of a row start at the log shares of the classes.  A round takes the
gradients of the loss (is the class, less its probability), grows one regression
tree a class on them by variance, and moves every leaf by one Newton step.

Features are cut into bins once (up to ``BINS``, from a bounded sample; every
value of a feature with few values is a cut), and the table holds a byte a
feature, the label and the scores.  A level of the trees of *all* classes is one
pass: each task adds up rows, gradients and Newton weights by class, node, feature
and bin, and Spark sums the cells.  The driver sees at most
``classes * 2^depth * features * BINS`` of them.  The leaf sums are those of the
chosen cuts, so a round takes ``max_depth`` passes and writes the scores once.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.functions.scalar import argmax_label, map_lookup
from wardflow.session import write_table

#: Bins of a feature, and sampled rows that the cuts are taken from (Spark ML's trees: 32 and 10,000).
BINS, CUT_ROWS = 32, 20_000
_NEVER = 1e-300


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    return F.aggregate(
        F.transform(scores, lambda s: F.exp(s - top)),
        F.struct(F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("parts")),
        lambda acc, e: F.struct((acc["total"] + e).alias("total"), F.concat(acc["parts"], F.array(e)).alias("parts")),
        lambda acc: F.transform(acc["parts"], lambda e: e / acc["total"]))


def _byte_rows(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) bytes of a binary column whose values are all that long."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(column), width)


@dataclass
class Tree:
    """A binary tree in heap order (root 1, children 2i and 2i + 1): feature (-1: leaf), threshold and its bin by node."""

    feature: list[int]
    threshold: list[float]
    cut: list[int]

    @staticmethod
    def stump(max_depth: int) -> Tree:
        n = 2 << max_depth
        return Tree([-1] * n, [0.0] * n, [0] * n)

    def leaf_of(self, x: np.ndarray, bounds: list) -> np.ndarray:
        """Leaf of each row of ``x``; a value over the bound, or unknown, goes right."""
        feature, bound, at, each = np.array(self.feature), np.array(bounds), np.ones(len(x), np.intp), np.arange(len(x))
        for _ in range(len(feature).bit_length() - 2):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + ~(x[each, f] <= bound[at]), at)
        return at


@dataclass
class BoostedTrees:
    """Trees and leaf values by round and class."""

    features: list[str]
    classes: list[str]
    rate: float
    base: list[float]
    trees: list[list[Tree]] = field(default_factory=list)
    leaves: list[list[dict[float, float]]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # before the first round, then after each

    def _steps(self, at: int) -> list[np.ndarray]:
        """What round ``at`` adds to the score of each class, by leaf."""
        out = []
        for tree, values in zip(self.trees[at], self.leaves[at], strict=True):
            step = np.zeros(len(tree.feature))
            for leaf, v in values.items():
                step[int(leaf)] = self.rate * v
            out.append(step)
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``probs`` (class order), ``predicted_class`` and ``confidence``."""
        rounds = [list(zip(trees, self._steps(at), strict=True)) for at, trees in enumerate(self.trees)]
        base = self.base

        @F.arrow_udf("array<double>")
        def scores(*columns: pa.Array) -> pa.Array:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
            s = np.tile(np.array(base, np.float64), (len(x), 1))
            for trees in rounds:
                for c, (tree, step) in enumerate(trees):
                    s[:, c] += step[tree.leaf_of(x, tree.threshold)]
            ends = np.arange(len(x) + 1, dtype=np.int32) * s.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(s.ravel()))

        known = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features]
        out = df.withColumn("_s", scores(*known))
        out = out.withColumn("probs", _softmax(F.col("_s"))).drop("_s")
        label, confidence = argmax_label(F.col("probs"), self.classes)
        return out.withColumn("predicted_class", label).withColumn("confidence", confidence)

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line."""
        rest = {"features": self.features, "classes": self.classes, "rate": self.rate, "base": self.base,
                "losses": self.losses, "leaves": [[list(map(list, v.items())) for v in r] for r in self.leaves],
                "trees": [[[t.feature, t.threshold, t.cut] for t in r] for r in self.trees]}
        spark.range(1).select(F.lit(json.dumps(rest)).alias("value")).coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        rest = json.loads(spark.read.text(path).first()["value"])
        leaves = [[dict(map(tuple, v)) for v in r] for r in rest.pop("leaves")]
        trees = [[Tree(*t) for t in r] for r in rest.pop("trees")]
        return BoostedTrees(**rest, trees=trees, leaves=leaves)


def _cuts(rows: DataFrame, features: list[str], total: int, seed: int) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature, the last bin's excepted."""
    share = min(1.0, CUT_ROWS / total)
    picked = rows.select(*features) if share == 1.0 else rows.select(*features).sample(False, share, seed)
    x = np.array(picked.collect(), np.float64).reshape(-1, len(features))
    out = []
    for column in x.T:
        v = np.sort(column[~np.isnan(column)])
        each = np.unique(v)
        if len(each) > BINS:
            each = np.unique(v[np.linspace(0, len(v) - 1, BINS + 1).astype(int)[1:]])
        out.append(each[:-1])
    return out


def _binned(rows: DataFrame, features: list[str], cuts: list[np.ndarray], base: list[float]) -> DataFrame:
    """Label, bins (a byte a feature) and first scores of each row."""
    kinds = pa.schema([("_y", pa.int32()), ("_b", pa.binary())] + [(f"_s{c}", pa.float64()) for c in range(len(base))])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.empty((b.num_rows, len(features)), np.uint8)
            for i, name in enumerate(features):
                codes[:, i] = np.searchsorted(cuts[i], b.column(name).to_numpy(zero_copy_only=False))  # unknown: the last
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * len(features)
            packed = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(codes)])
            yield pa.record_batch([b.column("_y"), packed, *[pa.array(np.full(b.num_rows, s)) for s in base]], schema=kinds)

    schema = "_y int, _b binary, " + ", ".join(f"_s{c} double" for c in range(len(base)))
    return rows.mapInArrow(run, schema)


def _cells(now: DataFrame, trees: list[Tree], nodes: list[list[int]], width: int) -> np.ndarray:
    """Rows, gradients and Newton weights by class, feature, open node and bin, summed over the table."""
    k, n_nodes = len(trees), max(map(len, nodes))

    def run(batches):
        found = np.zeros((k, 3, width, n_nodes * BINS))
        slots = []
        for c in range(k):
            slot = np.full(len(trees[c].feature), -1)
            slot[nodes[c]] = np.arange(len(nodes[c]))
            slots.append(slot)
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _byte_rows(b.column("_b"), width), b.column("_y").to_numpy()
            s = np.column_stack([b.column(f"_s{c}").to_numpy() for c in range(k)])
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            by_feature = np.ascontiguousarray(x.T).astype(np.intp)
            for c in range(k):
                up = (y == c) - p[:, c]
                down = np.abs(up) * (1 - np.abs(up))
                at = slots[c][trees[c].leaf_of(x, trees[c].cut)]
                inside = at >= 0
                if not inside.any():
                    continue
                every = inside.all()
                start, up, down = (v if every else v[inside] for v in (at * BINS, up, down))
                for f in range(width):
                    code = start + (by_feature[f] if every else by_feature[f][inside])
                    for i, weights in enumerate((None, up, down)):
                        found[c, i, f] += np.bincount(code, weights, n_nodes * BINS)
        at = np.argwhere(found[:, 0] > 0)
        sums = [found[at[:, 0], i, at[:, 1], at[:, 2]] for i in range(3)]
        yield pa.record_batch([*[pa.array(v.astype(np.int32)) for v in at.T], *map(pa.array, sums)], ["c", "f", "cell", "n", "up", "down"])

    cells = now.mapInArrow(run, "c int, f int, cell int, n double, up double, down double").groupBy("c", "f", "cell").agg(
        F.sum("n").alias("n"), F.sum("up").alias("up"), F.sum("down").alias("down")).toArrow()
    out = np.zeros((k, 3, width, n_nodes * BINS))
    at = tuple(cells.column(name).to_numpy() for name in ("c", "f", "cell"))
    for i, name in enumerate(("n", "up", "down")):
        out[at[0], i, at[1], at[2]] = cells.column(name).to_numpy()
    return out.reshape(k, 3, width, n_nodes, BINS)


def _best_cut(sums: np.ndarray, cuts: list[np.ndarray], min_rows: int) -> tuple[int, int] | None:
    """Feature and bin of the cut that takes most variance from a node, if one does."""
    left = sums.cumsum(axis=2)  # statistic, feature, bin
    n, up = left[0], left[1]
    rest_n, rest_up = n[:, -1:] - n, up[:, -1:] - up
    allowed = (np.arange(BINS) < np.array([len(c) for c in cuts])[:, None]) & (n >= max(min_rows, 1)) & (rest_n >= max(min_rows, 1))
    gain = np.full(n.shape, -np.inf)
    whole = up[:, -1:] ** 2 / np.maximum(n[:, -1:], 1)
    np.copyto(gain, up ** 2 / np.maximum(n, 1) + rest_up ** 2 / np.maximum(rest_n, 1) - whole, where=allowed)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(f), int(b)) if gain[f, b] > 1e-12 * n[f, -1] else None


def _grown(now: DataFrame, k: int, cuts: list[np.ndarray], max_depth: int, min_rows: int) -> tuple[list[Tree], list[dict]]:
    """One tree a class, and the Newton step of each leaf."""
    trees = [Tree.stump(max_depth) for _ in range(k)]
    sums: list[dict[int, np.ndarray]] = [{} for _ in range(k)]  # leaf -> gradients and Newton weights
    nodes = [[1] for _ in range(k)]
    for depth in range(max(max_depth, 1)):
        if not any(nodes):
            break
        cells = _cells(now, trees, nodes, len(cuts))
        after: list[list[int]] = [[] for _ in range(k)]
        for c in range(k):
            for slot, node in enumerate(nodes[c]):
                own = cells[c, :, :, slot]
                total = own[1:, 0].sum(axis=1)
                sums[c][node] = total
                found = _best_cut(own, cuts, min_rows) if depth < max_depth else None
                if found:
                    f, b = found
                    trees[c].feature[node], trees[c].threshold[node], trees[c].cut[node] = f, float(cuts[f][b]), b
                    left = own[1:, f, :b + 1].sum(axis=1)
                    del sums[c][node]
                    sums[c][2 * node], sums[c][2 * node + 1] = left, total - left
                    after[c] += [2 * node, 2 * node + 1]
        nodes = after
    newton = lambda up, down: float((k - 1) / k * up / down) if down > 1e-12 else 0.0
    return trees, [{float(leaf): newton(*v) for leaf, v in one.items()} for one in sums]


def _moved(now: DataFrame, trees: list[Tree], steps: list[np.ndarray], width: int) -> DataFrame:
    """The table with its scores after one more round."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _byte_rows(b.column("_b"), width)
            scores = [pa.array(b.column(f"_s{c}").to_numpy() + step[tree.leaf_of(x, tree.cut)])
                      for c, (tree, step) in enumerate(zip(trees, steps, strict=True))]
            yield pa.record_batch([b.column("_y"), b.column("_b"), *scores], b.schema.names)

    return now.mapInArrow(run, now.schema)


def fit_boosting(train: DataFrame, features: list[str], label: str, classes: list[str], rounds: int = 100,
                 max_depth: int = 5, rate: float = 0.1, min_rows: int = 1, seed: int = 42) -> BoostedTrees:
    """Boosted trees of the rows with a known label; a class without rows keeps a probability near zero."""
    k = len(classes)
    code = map_lookup({c: i for i, c in enumerate(classes)}, F.col(label), "int")
    model = BoostedTrees(list(features), list(classes), rate, [])
    # unknown values as NaN, which is over every bound
    rows = train.withColumn("_y", code).where("_y is not null").select(
        "_y", *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f) for f in features])
    shares = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}  # a row a class
    total = sum(shares.values())
    if not total:
        raise ValueError("no row has a known label")
    model.base = [math.log(max(shares.get(c, 0) / total, 1e-9)) for c in range(k)]
    cuts = _cuts(rows, model.features, total, seed)
    now = write_table(_binned(rows, model.features, cuts, model.base))
    scores = [F.col(f"_s{c}") for c in range(k)]
    top = F.array_max(F.array(*scores))
    share = F.exp(F.element_at(F.array(*scores), F.col("_y") + 1) - top) / sum((F.exp(s - top) for s in scores), F.lit(0.0))
    loss = F.avg(-F.log(F.greatest(share, F.lit(_NEVER)))).alias("loss")
    model.losses.append(now.agg(loss).first()["loss"])
    for at in range(rounds):
        trees, leaves = _grown(now, k, cuts, max_depth, min_rows)
        model.trees.append(trees)
        model.leaves.append(leaves)
        now = write_table(_moved(now, trees, model._steps(at), len(features)))
        model.losses.append(now.agg(loss).first()["loss"])
    return model
