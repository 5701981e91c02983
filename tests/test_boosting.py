import numpy as np
import pytest

from wardflow.operators.boosting import BoostedTrees, fit_boosting

CLASSES = ["a", "b", "c"]


def frame(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0.5, "a", np.where(x[:, 1] > 0, "b", "c"))
    return spark.createDataFrame([(*map(float, r), str(k)) for r, k in zip(x, y, strict=True)], "x0 double, x1 double, x2 double, y string")


def test_loss_falls_and_probabilities_sum_to_one(spark, scratch):
    train, test = frame(spark, 400, 1), frame(spark, 200, 2)
    model = fit_boosting(train, ["x0", "x1", "x2"], "y", CLASSES, rounds=4, max_depth=3, rate=0.3)
    assert len(model.losses) == 5 and all(b < a for a, b in zip(model.losses, model.losses[1:]))
    rows = model.predict(test).collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 and r.confidence == pytest.approx(max(r.probs), abs=5e-5) for r in rows)
    assert np.mean([r.predicted_class == r.y for r in rows]) > 0.9
    # the recorded loss is that of the model on its training rows
    fitted = model.predict(train).collect()
    assert model.losses[-1] == pytest.approx(np.mean([-np.log(r.probs[CLASSES.index(r.y)]) for r in fitted]))
    model.save(spark, f"{scratch}/m")
    again = BoostedTrees.load(spark, f"{scratch}/m")
    assert [tuple(r) for r in again.predict(test).collect()] == [tuple(r) for r in rows]


def test_first_round_by_hand(spark):
    """One split: leaf values are the Newton steps of the softmax loss."""
    df = spark.createDataFrame([(0.0, "a")] * 6 + [(1.0, "b")] * 3 + [(1.0, "c")] * 1, "x double, y string")
    model = fit_boosting(df, ["x"], "y", CLASSES, rounds=1, max_depth=1, rate=1.0)
    p = np.array([0.6, 0.3, 0.1])
    for c, values in enumerate(model.leaves[0]):
        left = np.full(6, (c == 0) - p[c])
        right = np.array([(c == k) - p[c] for k in (1, 1, 1, 2)])
        want = [2 / 3 * r.sum() / (np.abs(r) * (1 - np.abs(r))).sum() for r in (left, right)]
        assert [values[k] for k in sorted(values)] == pytest.approx(want)


def test_absent_class_unknown_labels_and_empty_table(spark):
    df = spark.createDataFrame([(float(i % 2), "ab"[i % 2]) for i in range(40)] + [(1.0, None), (0.0, "zzz")], "x double, y string")
    model = fit_boosting(df, ["x"], "y", CLASSES, rounds=2, max_depth=2)
    rows = model.predict(df).collect()
    assert len(rows) == 42 and all(r.probs[2] < 1e-6 for r in rows)
    assert model.predict(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no row"):
        fit_boosting(df.where("y = 'q'"), ["x"], "y", CLASSES)


def test_a_level_of_all_classes_is_one_pass(spark):
    """Jobs of a round: a pass a level, the write and the loss; not a tree a class with passes of its own."""
    train = frame(spark, 300, 3).cache()
    tracker = spark.sparkContext.statusTracker()

    def jobs(rounds):
        spark.sparkContext.setJobGroup(f"boost-{rounds}", "boosting")
        try:
            fit_boosting(train, ["x0", "x1", "x2"], "y", CLASSES, rounds=rounds, max_depth=3)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(f"boost-{rounds}"))

    assert jobs(3) - jobs(1) <= 2 * 12


def test_cuts_are_those_of_largest_gain(spark):
    """The first tree against a search of all cuts; unknown values go right."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 6, size=(200, 3)).astype(float)
    y = np.where(x[:, 1] + rng.normal(size=200) > 3, "a", "b")
    x[:20, 1] = np.nan
    rows = [(*(None if np.isnan(v) else float(v) for v in r), str(k)) for r, k in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, y string")
    model = fit_boosting(df, ["x0", "x1", "x2"], "y", ["a", "b"], rounds=1, max_depth=1)
    up = (y == "a") - (y == "a").mean()
    gains = {}
    for f in range(3):
        for v in range(5):
            left = x[:, f] <= v
            gains[f, float(v)] = up[left].sum() ** 2 / left.sum() + up[~left].sum() ** 2 / (~left).sum()
    tree = model.trees[0][0]
    assert (tree.feature[1], tree.threshold[1]) == max(gains, key=gains.get)
    assert model.predict(df).where("predicted_class is null or confidence is null").count() == 0
