"""The weighted forest behind the claim model: weights, importances, metadata, files and exact attributions."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import hand_tables
from wardflow.operators import attribution as X
from wardflow.operators import forest as W
from wardflow.operators import models as M
from wardflow.operators.boosting import BINS
from wardflow.operators.features import balanced_class_weights
from wardflow.plans import catalog as C

CLASSES = ["a", "b", "c"]
COLUMNS = ["x0", "x1", "x2"]


def frame(spark, n, seed):
    """A rare class ``a``; ``x2`` is noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=n) > 1.6, "a", np.where(x[:, 1] > 0, "b", "c"))
    return spark.createDataFrame([(*map(float, r), str(c)) for r, c in zip(x, y, strict=True)],
                                 "x0 double, x1 double, x2 double, y string")


def recalls(model, df):
    rows = M.predict(model, df, CLASSES).groupBy("y").agg(
        F.avg((F.col("y") == F.col("predicted_class")).cast("double")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["y"])]


def test_weighted_forest_matches_that_of_spark_ml(spark):
    train, test = balanced_class_weights(frame(spark, 2500, 1), "y"), frame(spark, 2000, 2)
    options = {"n_estimators": 30, "max_depth": 6, "weight_col": "weight"}
    (ours,) = M.train_forests(train, [COLUMNS], "y", CLASSES, **options)
    theirs = M.train_model(train, COLUMNS, "y", CLASSES, "random_forest", **options)
    (plain,) = M.train_forests(train, [COLUMNS], "y", CLASSES, n_estimators=30, max_depth=6)
    assert recalls(ours, test) == pytest.approx(recalls(theirs, test), abs=0.08)
    assert recalls(ours, test)[0] > recalls(plain, test)[0] + 0.1
    mine, other = ({r["feature"]: r["importance"] for r in M.feature_importances(m, COLUMNS).collect()} for m in (ours, theirs))
    assert sum(mine.values()) == pytest.approx(1) and mine == pytest.approx(other, abs=0.06)
    keys = lambda m: {r["key"]: r["value"] for r in M.model_metadata(m, "m", "v", COLUMNS, CLASSES, "y", train).collect()}
    told, wanted = keys(ours), keys(theirs)
    assert list(told) == list(wanted)
    assert {k: v for k, v in told.items() if k != "total_nodes"} == {k: v for k, v in wanted.items() if k != "total_nodes"}
    assert int(told["total_nodes"]) == pytest.approx(int(wanted["total_nodes"]), rel=0.25)


def test_weights_are_those_of_the_classes(spark):
    df = frame(spark, 200, 3).withColumn("w", F.col("x0"))
    with pytest.raises(ValueError, match="differ in w"):
        M.train_forests(df, [COLUMNS], "y", CLASSES, n_estimators=2, weight_col="w")


def test_best_weighted_cut_by_search():
    rng, weights = np.random.default_rng(5), np.array([9.0, 1.0, 0.25])
    cells = rng.integers(0, 6, size=(4, 2, BINS, 3)).astype(float)
    cells[:, 1] = rng.permuted(cells[:, 0], axis=1)
    place, cut, left, total = W._best_cuts(cells, 30, weights)
    gini = lambda c: c.sum() - (c ** 2).sum() / c.sum()
    for node in range(4):
        sides = {(j, b): (cells[node, j, :b + 1].sum(axis=0), cells[node, j, b + 1:].sum(axis=0)) for j in range(2) for b in range(BINS - 1)}
        found = {at: gini(lo * weights) + gini(hi * weights) for at, (lo, hi) in sides.items() if min(lo.sum(), hi.sum()) >= 30}
        assert found[place[node], cut[node]] == pytest.approx(min(found.values()))
        assert (left[node] == sides[place[node], cut[node]][0]).all() and (total[node] == cells[node, 0].sum(axis=0)).all()


def test_saved_forest_is_the_same(spark, scratch):
    df = frame(spark, 400, 4)
    one, two = (M.train_forests(df, [COLUMNS], "y", CLASSES, n_estimators=n, max_depth=4)[0] for n in (3, 5))
    for model in (one, two):  # the second overwrites the first
        M.save_model(model, scratch)
        again = M.load_model(scratch)
        assert [r.probs for r in M.predict(again, df, CLASSES).collect()] == [r.probs for r in M.predict(model, df, CLASSES).collect()]
        assert again.params == model.params and again.total_nodes == model.total_nodes
        assert (again.importances == model.importances).all()


def test_forest_values_are_exact_for_every_row(spark):
    """Against all orders of the features, with unknown values and rows that share a key."""
    train = frame(spark, 600, 6)
    (model,) = M.train_forests(train, [COLUMNS], "y", CLASSES, n_estimators=7, max_depth=6)
    rng = np.random.default_rng(7)
    x = [list(map(float, r)) for r in rng.normal(size=(20, 3))]
    x[3][1], x[4][0] = None, None
    rows = spark.createDataFrame([(i // 2, *r) for i, r in enumerate(x)], "key long, x0 double, x1 double, x2 double")
    back = list(train.agg(*[F.avg(c) for c in COLUMNS]).first())
    mixed = [(i, s, *[r[j] if s >> j & 1 else back[j] for j in range(3)]) for i, r in enumerate(x) for s in range(8)]
    scored = M.predict(model, spark.createDataFrame(mixed, "i int, s int, x0 double, x1 double, x2 double"), CLASSES).collect()
    p = {(r["i"], r["s"]): np.array(r["probs"]) for r in scored}
    want = []
    for i in range(len(x)):
        value = np.zeros((3, 3))
        for order in permutations(range(3)):
            s = 0
            for j in order:
                value[j] += (p[i, s | 1 << j] - p[i, s]) / 6
                s |= 1 << j
        want += [(i // 2, COLUMNS[j], CLASSES[c], round(float(value[j, c]), 9) + 0.0) for j in range(3) for c in range(3)]
    got = X.shapley_values(model, rows, train, COLUMNS, CLASSES, "key").collect()
    assert sorted((r["key"], r["feature"], r["class_name"], round(r["shap"], 9) + 0.0) for r in got) == sorted(want)
    assert all(r["std_error"] == 0 and r["base_value"] == pytest.approx(p[0, 0][CLASSES.index(r["class_name"])]) for r in got)
    with pytest.raises(ValueError, match="not the features"):
        X.shapley_values(model, rows, train, COLUMNS[:2], CLASSES, "key")
    assert X.shapley_values(model, rows.limit(0), train, COLUMNS, CLASSES, "key").count() == 0


def small_model(monkeypatch):
    fit = M.train_forests
    monkeypatch.setattr(M, "train_forests", lambda *a, **k: fit(*a, **{**k, "n_estimators": 3, "max_depth": 3}))


def test_claim_model_is_grown_over_binned_blocks(spark, monkeypatch):
    small_model(monkeypatch)
    monkeypatch.setattr(C, "TESTDATA_SPLIT_DATE", "2100-01-01")
    monkeypatch.setattr(M.RandomForestClassifier, "fit", lambda *a, **k: pytest.fail("rows with their draws are cached"))
    model, tr, te = C._claim_rf(hand_tables(spark))
    assert isinstance(model, W.Forest) and model.params["numTrees"] == 3


def test_attribution_takes_every_row(spark, monkeypatch):
    """More rows than the former sample of 300, some of them equal."""
    small_model(monkeypatch)
    seen, values = [], X.shapley_values
    monkeypatch.setattr(X, "shapley_values", lambda m, rows, *a, **k: seen.append(rows.count()) or values(m, rows, *a, **k))
    train = frame(spark, 400, 8)
    rows = train.withColumn("row_key", F.xxhash64(*COLUMNS)).unionByName(train.limit(20).withColumn("row_key", F.lit(7).cast("long")))
    (model,) = M.train_forests(train, [COLUMNS], "y", CLASSES)
    monkeypatch.setattr(C, "_claim_rf", lambda t, keyed: (model, train, rows))
    monkeypatch.setattr(C.K, "MODEL_FEATURES_U", COLUMNS)
    monkeypatch.setattr(C.K, "CLAIM_CLASSES", CLASSES)
    assert C._v8(None).count() == 9 and seen == [420]
