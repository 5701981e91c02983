"""Sampled Shapley values against exact ones."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.operators.attribution import _pair_means, shapley_values

FEATURES = ["a", "b", "c"]


def frames(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rng.normal(size=(12, 3)))], "key long, a double, b double, c double")
    back = spark.createDataFrame([tuple(map(float, x)) for x in rng.normal(size=(30, 3))], "a double, b double, c double")
    return rows, back


def product_score(df):
    """Two classes: a product of all features, and a linear sum."""
    return df.withColumn("_prob", F.array(F.col("a") * F.col("b") * F.col("c"), F.col("a") - 2 * F.col("b") + 3 * F.col("c")))


def plain_score(x):
    return np.array([x[0] * x[1] * x[2], x[0] - 2 * x[1] + 3 * x[2]])


def exact(x, bg):
    """Mean contribution over all orders of the features."""
    out = np.zeros((3, 2))
    orders = list(permutations(range(3)))
    for order in orders:
        now = bg.copy()
        for i in order:
            before = plain_score(now)
            now[i] = x[i]
            out[i] += plain_score(now) - before
    return out / len(orders)


def test_values_are_within_their_error_and_add_up(spark):
    rows, back = frames(spark)
    bg = np.array(back.agg(*[F.avg(f) for f in FEATURES]).first())
    got = shapley_values(None, rows, back, FEATURES, ["product", "sum"], "key", n_perm=64, score=product_score).collect()
    points = {r["key"]: np.array([r.a, r.b, r.c]) for r in rows.collect()}
    assert len(got) == 12 * 3 * 2
    far = 0
    for r in got:
        want = exact(points[r["key"]], bg)[FEATURES.index(r.feature), ("product", "sum").index(r.class_name)]
        if r.class_name == "sum":  # linear: every permutation is exact
            assert r.shap == pytest.approx(want) and r.std_error == pytest.approx(0, abs=1e-9)
        else:
            far += abs(r.shap - want) > 4 * r.std_error + 1e-9
    assert far <= 1
    for key, x in points.items():
        for c, name in enumerate(("product", "sum")):
            told = sum(r.shap for r in got if r["key"] == key and r.class_name == name)
            base = {r.base_value for r in got if r["key"] == key and r.class_name == name}
            assert len(base) == 1 and told == pytest.approx(plain_score(x)[c] - base.pop())


def test_rounds_go_on_until_the_error_is_small(spark):
    rows, back = frames(spark)
    options = {"n_perm": 4, "score": product_score}
    one = shapley_values(None, rows, back, FEATURES, ["product", "sum"], "key", **options)
    many = shapley_values(None, rows, back, FEATURES, ["product", "sum"], "key", **options, max_error=1e-12, max_rounds=4)
    error = lambda df: df.agg(F.avg("std_error")).first()[0]
    assert error(many) < error(one)
    assert shapley_values(None, rows.limit(0), back, FEATURES, ["product", "sum"], "key", **options).count() == 0


def test_coalitions_are_not_exchanged(spark):
    rows = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(20)], "k long, a double, b double")
    score = lambda df: df.withColumn("_prob", F.array(F.col("a") + F.col("b")))
    given = rows.crossJoin(rows.agg(F.avg("a").alias("_bg_a"), F.avg("b").alias("_bg_b")))
    found = _pair_means(score, given, ["a", "b"], "k", 0, 2, 42)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
