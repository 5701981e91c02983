"""Newton steps against Spark ML's fit of the same objective."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardflow.operators import models as M
from wardflow.operators.features import balanced_class_weights

CLASSES, COLUMNS = ["a", "b", "c"], ["x0", "x1", "x2"]


def frame(spark, n, seed):
    """``x2`` is constant."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 50.0] + [3.0, -20.0]
    z = np.column_stack([x[:, 0] - 4, 0.02 * x[:, 1], np.zeros(n)]) + rng.gumbel(size=(n, 3))
    return spark.createDataFrame([(*map(float, r), 7.0, CLASSES[c]) for r, c in zip(x, z.argmax(axis=1), strict=True)],
                                 "x0 double, x1 double, x2 double, y string")


def probabilities(model, df):
    return np.array([r.probs for r in M.predict(model, df, CLASSES).select("probs").collect()])


@pytest.mark.parametrize("c", [1.0, 0.01])
def test_probabilities_are_those_of_spark_ml(spark, c):
    train, test = balanced_class_weights(frame(spark, 800, 1), "y"), frame(spark, 300, 2)
    ours = M.train_logistic(train, COLUMNS, "y", CLASSES, weight_col="weight", C=c)
    theirs = M.train_model(train, COLUMNS, "y", CLASSES, "logistic_regression", weight_col="weight", C=c)
    assert np.abs(probabilities(ours, test) - probabilities(theirs, test)).max() < 2e-3


def test_separable_classes_take_few_passes(spark):
    rows = frame(spark, 600, 3).withColumn("y", F.when(F.col("x0") > 3, "a").otherwise("b")).where("abs(x0 - 3) > 0.2").cache()
    name = "logistic"
    spark.sparkContext.setJobGroup(name, name)
    try:
        model = M.train_logistic(rows, COLUMNS, "y", CLASSES)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)) < 40
    got = M.predict(model, rows, CLASSES).collect()
    assert all(r.predicted_class == r.y and r.probs[2] == 0 for r in got)


def test_unknown_values_and_odd_tables(spark):
    df = frame(spark, 200, 4)
    holes = df.withColumn("x1", F.when(F.col("x0") > 3, F.col("x1"))).unionByName(df.limit(1).withColumn("y", F.lit("zzz")))
    model = M.train_logistic(holes, COLUMNS, "y", CLASSES)
    assert np.allclose(probabilities(model, holes).sum(axis=1), 1)
    one = M.train_logistic(df.withColumn("y", F.lit("b")), COLUMNS, "y", CLASSES)
    assert (probabilities(one, df) == [0, 1, 0]).all()
    assert M.predict(model, df.limit(0), CLASSES).count() == 0
    with pytest.raises(ValueError, match="no row"):
        M.train_logistic(df.where("y = 'q'"), COLUMNS, "y", CLASSES)
