"""Feature attribution (V8, V9): Shapley values as one Spark job.

Re-aim of per-row tree SHAP: a coalition's features take the row's value, the
rest a background value (training mean), and a value is the mean change of the
probability when the feature joins, over all orders.

For a forest the values are exact, by one walk of each tree: where the row and the
background part, both ways are followed, and the way taken binds the feature to
the row or to the background.  A leaf that ``a`` features of the row and ``b`` of
the background lead to is won by the last of the ``a`` before all of the ``b``,
so it gives each of the ``a`` features ``(a-1)! b! / (a+b)!`` of its shares and takes
``a! (b-1)! / (a+b)!`` from each of the ``b``.  Every row is handled where it lies,
a bounded number at once; nothing is sampled or exchanged.

For any other model they are sampled: for each row and each of ``n_perm`` seeded
feature permutations, the d+1 coalitions along the permutation are exploded into
rows and scored together by the fitted pipeline's ``transform``, and the changes are
averaged.  Permutations come in antithetic pairs (one and its reverse); the spread
of the pair means gives the standard error of every value, and with ``max_error``
more rounds of pairs are drawn until no value's error is above it.  For a linear
score every permutation gives the exact value.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.operators.forest import Forest, coded, kind_of
from wardflow.session import write_table

#: Rows that one walk of a tree takes.
WALK_ROWS = 2048


def _forest_walk(model: Forest, background: np.ndarray):
    """The function from coded rows to (values by feature, class and row); and the background's probabilities."""
    d, k, depth = len(model.features), len(model.classes), model.feature.shape[1].bit_length() - 2
    bits = 1 << np.arange(d, dtype=np.int64)
    most = min(depth, d) + 1
    fact = [math.factorial(i) for i in range(2 * most)]
    gives = np.array([[fact[max(a - 1, 0)] * fact[b] / fact[a + b] for b in range(most)] for a in range(most)])
    trees = [(f.astype(np.int64), b, s, background.take(f) > b)
             for f, b, s in zip(model.feature, model.bound, model.shares, strict=True) if s.any()]
    base = np.zeros(k)
    for _, _, s, away in trees:
        node = 1
        for _ in range(depth):
            node = 2 * node + int(away[node])
        base += s[node]
    base /= max(len(trees), 1)

    def walk(x: np.ndarray) -> np.ndarray:
        n, flat = len(x), x.ravel()
        out = np.zeros((d, k, n))
        for f, bound, shares, away in trees:
            row, node = np.arange(n), np.ones(n, np.int64)
            own, other = np.zeros(n, np.int64), np.zeros(n, np.int64)  # features bound to the row, to the background
            for _ in range(depth):
                at = f.take(node)
                bit = bits.take(at)
                at += row * d
                right, back = flat.take(at) > bound.take(node), away.take(node)
                parted = np.flatnonzero((right != back) & (((own | other) & bit) == 0))
                node += node
                both = node[parted] + back[parted]
                node += np.where((other & bit) != 0, back, right)
                if len(parted):
                    bit, mine = bit[parted], own[parted]
                    own[parted] = mine | bit
                    row, node = np.concatenate([row, row[parted]]), np.concatenate([node, both])
                    own, other = np.concatenate([own, mine]), np.concatenate([other, other[parted] | bit])
            a, b = np.bitwise_count(own).astype(np.intp), np.bitwise_count(other).astype(np.intp)
            plus, minus = gives[a, b], -gives[b, a]
            for j in range(d):
                up, down = np.flatnonzero(own & bits[j]), np.flatnonzero(other & bits[j])
                if not len(up) and not len(down):
                    continue
                at = np.concatenate([up, down])
                r, weight, s = row[at], np.concatenate([plus[up], minus[down]]), shares.take(node[at], axis=0)
                for c in range(k):
                    out[j, c] += np.bincount(r, weight * s[:, c], n)
        out /= max(len(trees), 1)
        return out

    return walk, base


def _forest_values(model: Forest, given: DataFrame, background: list, key: str) -> DataFrame:
    """(key, _fi, _ci, shap, base_value, std_error) of every row of ``given``, exactly."""
    cuts, features, k = model.cuts, model.features, len(model.classes)
    known = [float("nan") if v is None else float(v) for v in background]
    point = coded([pa.array([v], pa.float64()) for v in known], cuts)[0] * k
    walk, base = _forest_walk(model, point)

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, WALK_ROWS):
                part = b.slice(first, WALK_ROWS)
                x = (coded([part.column(f) for f in features], cuts) * k).astype(kind_of(k))
                values = np.ascontiguousarray(np.moveaxis(walk(x), 2, 0))
                ends = np.arange(len(x) + 1, dtype=np.int32) * values[0].size
                yield pa.record_batch([part.column(key), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))],
                                      [key, "_values"])

    schema = T.StructType([given.schema[key], T.StructField("_values", T.ArrayType(T.DoubleType()))])
    rows = given.select(key, *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f) for f in features])
    each = rows.mapInArrow(run, schema).select(key, F.posexplode("_values").alias("_at", "shap"))
    return each.select(
        key, F.expr(f"_at div {k}").cast("int").alias("_fi"), (F.col("_at") % k).alias("_ci"), "shap",
        F.element_at(F.array(*[F.lit(float(v)) for v in base]), (F.col("_at") % k) + 1).alias("base_value"),
        F.lit(0.0).alias("std_error"))


def _pair_means(score, rows: DataFrame, features: list[str], key: str, first: int, n_pairs: int, seed: int) -> DataFrame:
    """(key, _fi, _ci, delta, base): contributions averaged over each pair of permutations."""
    d = len(features)
    # dealt by key before they are repeated, so that the windows and sums below need no exchange of the coalitions
    perms = rows.repartition(key).withColumn("_pair", F.explode(F.sequence(F.lit(first), F.lit(first + n_pairs - 1)))) \
        .withColumn("_back", F.explode(F.array(F.lit(False), F.lit(True))))
    order = F.transform(
        F.array_sort(F.array(*[F.struct(F.xxhash64(F.col(key), "_pair", F.lit(i), F.lit(seed)).alias("h"),
                                        F.lit(i).alias("i")) for i in range(d)])),
        lambda s: s["i"])
    perms = perms.withColumn("_perm", F.when(F.col("_back"), F.reverse(order)).otherwise(order)) \
        .withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(d))))
    coal = perms
    for i, f in enumerate(features):
        pos = F.array_position("_perm", F.lit(i)) - 1
        coal = coal.withColumn(f, F.when(pos < F.col("_m"), F.col(f)).otherwise(F.col(f"_bg_{f}")))
    scored = score(coal.drop(*[f"_bg_{f}" for f in features])).select(key, "_pair", "_back", "_m", "_perm", "_prob")
    w = Window.partitionBy(key, "_pair", "_back").orderBy("_m")  # d + 1 rows per window
    steps = scored.withColumn("_prev", F.lag("_prob").over(w)).withColumn("_none", F.first("_prob").over(w)) \
        .where(F.col("_m") > 0).withColumn("_fi", F.element_at("_perm", F.col("_m")))
    each = steps.select(key, "_pair", "_fi", "_none", F.posexplode(F.zip_with("_prob", "_prev", lambda a, b: a - b))
                        .alias("_ci", "_delta"))
    return each.groupBy(key, "_pair", "_fi", "_ci").agg(
        F.avg("_delta").alias("delta"), F.first(F.element_at("_none", F.col("_ci") + 1)).alias("base"))


def shapley_values(model, rows: DataFrame, background: DataFrame, features: list[str], classes: list[str],
                   key: str, n_perm: int = 8, seed: int = 42, score=None, max_error: float | None = None,
                   max_rounds: int = 8) -> DataFrame:
    """(key, feature, class_name, shap, base_value, std_error) for every given row.

    The values of a forest are exact (a standard error of 0), and rows may share a
    key.  Otherwise ``key`` is unique, and ``score`` adds the array column ``_prob``
    (one number a class) to feature rows; without it the pipeline ``model`` does.
    The values of a row and class sum to its score less the base value, the score
    of the background.
    """
    if isinstance(model, Forest) and score is None:
        if list(features) != model.features or list(classes) != model.classes or len(features) > 62:
            raise ValueError("not the features and classes of the forest, or over 62 features")
        point = list(background.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first())
        return _named(_forest_values(model, rows, point, key), key, features, classes)
    if score is None:
        score = lambda df: model.transform(df).withColumn("_prob", vector_to_array("probability"))
    bg = background.agg(*[F.avg(F.col(f).cast("double")).alias(f"_bg_{f}") for f in features])
    given = rows.select(key, *[F.col(f).cast("double").alias(f) for f in features]).crossJoin(F.broadcast(bg))
    pairs, drawn = max(1, n_perm // 2), None
    found = None
    for at in range(max_rounds if max_error is not None else 1):
        now = write_table(_pair_means(score, given, features, key, at * pairs, pairs, seed))
        drawn = now if drawn is None else drawn.unionByName(now)
        found = drawn.groupBy(key, "_fi", "_ci").agg(
            F.avg("delta").alias("shap"), F.first("base").alias("base_value"),
            (F.stddev_samp("delta") / F.sqrt(F.count(F.lit(1)))).alias("std_error"))
        worst = found.agg(F.max("std_error")).first()[0] if max_error is not None else None
        if worst is not None and worst <= max_error:
            break
    return _named(found, key, features, classes)


def _named(found: DataFrame, key: str, features: list[str], classes: list[str]) -> DataFrame:
    names = F.array(*[F.lit(f) for f in features])
    cls = F.array(*[F.lit(c) for c in classes])
    return found.select(
        key, F.element_at(names, F.col("_fi") + 1).alias("feature"),
        F.element_at(cls, F.col("_ci") + 1).alias("class_name"), "shap", "base_value", "std_error")


def v8_mean_abs_attribution(shap: DataFrame) -> DataFrame:
    """Mean |value| per feature and class, ranked within class."""
    out = shap.groupBy("feature", "class_name").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    return out.withColumn("rank", F.row_number().over(
        Window.partitionBy("class_name").orderBy(F.desc("mean_abs_shap"), "feature")))


def v9_explain_row(shap: DataFrame, key: str, key_value, class_name: str) -> DataFrame:
    """Base value plus ranked contributions for one row and class."""
    return shap.where((F.col(key) == F.lit(key_value)) & (F.col("class_name") == class_name)) \
        .orderBy(F.desc(F.abs("shap")), "feature")
