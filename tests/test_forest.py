import numpy as np
import pytest

from wardflow.operators import forest as W
from wardflow.operators import models as M
from wardflow.operators.boosting import BINS

CLASSES = ["a", "b", "c"]
COLUMNS = ["x0", "x1", "x2", "x3"]


def frame(spark, n, seed, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = np.where(x[:, 0] > 0.5, "a", np.where(x[:, 1] + 0.2 * rng.normal(size=n) > 0, "b", "c"))
    rows = [(*map(float, r), str(k)) for r, k in zip(x, y, strict=True)]
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "x0 double, x1 double, x2 double, x3 double, y string")


def accuracy(model, df):
    rows = M.predict(model, df, CLASSES).collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in rows)
    return np.mean([r.predicted_class == r.y for r in rows])


def test_forests_of_two_feature_lists_match_those_of_spark_ml(spark):
    train, test = frame(spark, 1500, 1), frame(spark, 1000, 2)
    lists = [COLUMNS, ["x1", "x2", "x3"]]
    for names, ours in zip(lists, M.train_forests(train, lists, "y", CLASSES, n_estimators=20, max_depth=6), strict=True):
        theirs = M.train_model(train, names, "y", CLASSES, "random_forest", n_estimators=20, max_depth=6)
        assert accuracy(ours, test) == pytest.approx(accuracy(theirs, test), abs=0.03)
        assert ours.feature.shape[0] == 20 and ours.feature.max() < len(names)


def test_a_level_of_all_forests_is_one_pass(spark):
    train = frame(spark, 300, 3).cache()
    tracker = spark.sparkContext.statusTracker()

    def jobs(lists, trees):
        name = f"forest-{len(lists)}-{trees}"
        spark.sparkContext.setJobGroup(name, name)
        try:
            W.fit_forests(train, lists, "y", CLASSES, trees=trees, max_depth=3)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    # three jobs a level (AQE may save or add a stage), however many trees and lists
    assert jobs([COLUMNS, COLUMNS[1:]], 6) <= jobs([COLUMNS], 2) + 2


def test_cells_hold_every_drawn_row(spark):
    """Two steps down, over several blocks and tasks, against a plain count of the same draws."""
    n, k, trees, seed = 9000, 3, 2, 5
    train = frame(spark, n, 4, parts=2).selectExpr("*", "ascii(y) - 97 as _y")
    cuts = [np.linspace(-2, 2, 31) for _ in COLUMNS]
    blocks = W._blocks(train, COLUMNS, cuts, k).repartition(3).cache()
    feature, bound = np.zeros((trees, 4), np.int16), np.full((trees, 4), 255, np.uint8)
    feature[:, 1], bound[:, 1] = 1, 15 * k + k - 1
    feature[:, 3], bound[:, 3] = 2, 9 * k + k - 1  # the root's left node is a leaf
    slot = np.tile(np.array([-1, -1, 0, 1]), (trees, 1))
    picked = [np.array([[0, 3], [2, 1]], np.int16) for _ in range(trees)]
    found = {}
    for r in W._cells(blocks, trees, seed, 2, 4, k, feature, bound, slot, picked).collect():
        one = np.frombuffer(r["cells"], f"u{r['size']}").reshape(2, 2, BINS, k)
        found[r["tree"]] = found.get(r["tree"], 0) + one.astype(int)
    want = {t: np.zeros((2, 2, BINS, k), int) for t in range(trees)}
    rows = 0
    for b in blocks.collect():
        x = np.frombuffer(b["codes"], np.uint8).reshape(-1, 4)
        rows += len(x)
        for t in range(trees):
            for one, times in zip(x, W._draws(seed, b["block"], t, len(x)), strict=True):
                if one[1] > bound[t, 1]:
                    node = int(one[feature[t, 3]] > bound[t, 3])
                    for j, f in enumerate(picked[t][node]):
                        want[t][j, node, one[f] // k, one[f] % k] += times
    assert rows == n and all((found[t] == want[t]).all() for t in range(trees))


def test_best_cut_by_search(spark):
    rng = np.random.default_rng(8)
    cells = rng.integers(0, 5, size=(6, 2, BINS, 3)).astype(float)
    cells[:, 1] *= cells[:, 0].sum(axis=1, keepdims=True) / cells[:, 1].sum(axis=1, keepdims=True)
    place, cut, left, _ = W._best_cuts(cells, 40)

    def gini(c):
        return c.sum() - (c ** 2).sum() / c.sum() if c.sum() else 0.0

    for node in range(len(cells)):
        whole = {(j, b): (cells[node, j, :b + 1].sum(axis=0), cells[node, j, b + 1:].sum(axis=0)) for j in range(2) for b in range(BINS - 1)}
        allowed = {at: gini(lo) + gini(hi) for at, (lo, hi) in whole.items() if lo.sum() >= 40 and hi.sum() >= 40}
        assert allowed[place[node], cut[node]] == pytest.approx(min(allowed.values()), abs=1e-6)
        assert (left[node] == whole[place[node], cut[node]][0]).all()
    pure = np.zeros((1, 1, BINS, 3))
    pure[0, 0, :, 1] = 4
    assert W._best_cuts(pure, 1)[0][0] == -1


def test_unknown_values_labels_and_empty_tables(spark):
    rows = [(None if i % 5 == 0 else float(i % 2), "ab"[i % 2]) for i in range(200)] + [(1.0, None), (0.0, "zzz")]
    df = spark.createDataFrame(rows, "x double, y string")
    (model,) = W.fit_forests(df, [["x"]], "y", CLASSES, trees=5, max_depth=2)
    got = M.predict(model, df, CLASSES).collect()
    assert len(got) == 202 and all(r.probs[2] == 0 and abs(sum(r.probs) - 1) < 1e-9 for r in got)
    assert all(r.predicted_class == ("b" if r.x else "a") for r in got if r.x is not None)
    assert M.predict(model, df.limit(0), CLASSES).count() == 0
    with pytest.raises(ValueError, match="no row"):
        W.fit_forests(df.where("y = 'q'"), [["x"]], "y", CLASSES)


def test_cells_are_the_same_in_small_pieces(spark, monkeypatch):
    """A task's rows are added up piece by piece; the draws are those of the 16-bit table."""
    train = frame(spark, 9000, 4, parts=2).selectExpr("*", "ascii(y) - 97 as _y")
    blocks = W._blocks(train, COLUMNS, [np.linspace(-2, 2, 31) for _ in COLUMNS], 3).repartition(2).cache()
    upper, slot, picked = np.zeros((2, 1), np.int16), np.zeros((2, 1), int), [np.array([[0, 3]], np.int16)] * 2

    def cells():
        rows = W._cells(blocks, 2, 5, 0, 4, 3, upper, np.full((2, 1), 255, np.uint8), slot, picked).collect()
        return sorted((r["tree"], r["size"], bytes(r["cells"])) for r in rows)

    whole = cells()
    monkeypatch.setattr(W, "LEAST", 1)
    monkeypatch.setattr(W, "MOST", 1)
    assert cells() == whole
    number = np.random.default_rng([5, 7, 1]).integers(0, 1 << 16, 4000, np.uint16)
    assert (W._draws(5, 7, 1, 4000) == W._POISSON[number]).all()
