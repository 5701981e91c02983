import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardflow.functions.prefix import totals_before
from wardflow.functions.quantiles import exact_quantiles


def test_quantiles_hot_key_and_ties(spark):
    rng = np.random.default_rng(7)
    hot = np.round(rng.exponential(5.0, 3000), 1)
    cold = rng.normal(0, 1, 300)
    rows = [("hot", float(x)) for x in hot] + [("cold", float(x)) for x in cold] + [("cold", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.k: [r[f"q{i}"] for i in range(len(probs))] for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    assert np.allclose(got["hot"], np.quantile(hot, probs), rtol=0, atol=1e-9)
    assert np.allclose(got["cold"], np.quantile(cold, probs), rtol=0, atol=1e-9)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40))
def test_quantiles_property(spark, xs):
    df = spark.createDataFrame([(1, float(x)) for x in xs], "k int, v double")
    r = exact_quantiles(df, ["k"], "v", [0.2, 0.5, 0.9], buckets=4).first()
    assert np.allclose([r.q0, r.q1, r.q2], np.quantile(np.array(xs, float), [0.2, 0.5, 0.9]))


def test_totals_before_brute_force(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 50, 400)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(vals)], "k int, x double")
    agg = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("c"))
    out = totals_before(agg, ["k"], "x", ["c"], buckets=7).collect()
    for r in out:
        sel = vals[(np.arange(len(vals)) % 2) == r.k]
        assert r.c_before == int((sel < r.x).sum())


def test_quantiles_refinement_rounds_skewed(spark):
    """Tiny window bound forces several narrowing rounds on a heavy-tailed key."""
    rng = np.random.default_rng(9)
    xs = np.round(rng.lognormal(0, 2.0, 2000), 3)
    df = spark.createDataFrame([("k", float(x)) for x in xs], "k string, v double")
    probs = [0.01, 0.3, 0.5, 0.77, 0.999]
    r = exact_quantiles(df, ["k"], "v", probs, buckets=4, max_window_rows=5).first()
    assert np.allclose([r[f"q{i}"] for i in range(len(probs))], np.quantile(xs, probs), rtol=0, atol=1e-12)
    assert r.n == 2000


def test_row_numbers_and_totals_across_partitions(spark):
    from wardflow.functions.prefix import row_numbers

    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rng = np.random.default_rng(4)
        keys = rng.integers(0, 40, 2000)  # many duplicate sort keys, one hot value
        keys[:700] = 7
        df = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "k long, i long")
        rn = row_numbers(df, ["k"], "rn")
        out = rn.collect()
        assert sorted(r.rn for r in out) == list(range(2000))
        ks = {r.rn: r.k for r in out}
        assert [ks[i] for i in range(2000)] == sorted(keys.tolist())  # numbering follows the order
        agg = df.groupBy((F.col("i") % 3).alias("g"), "k").agg(F.count(F.lit(1)).alias("c"))
        tb = totals_before(agg, ["g"], "k", ["c"]).collect()
        for r in tb:
            sel = keys[np.arange(2000) % 3 == r.g]
            assert r.c_before == int((sel < r.k).sum())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("buckets,bound", [(4, 5), (64, 3)])
def test_quantiles_over_many_decades_infinities_and_hot_values(spark, buckets, bound):
    """Ranges over hundreds of decades, a value that holds a third of the rows, and signs narrow for certain."""
    rng = np.random.default_rng(2)
    xs = np.concatenate((10.0 ** rng.uniform(-300, 300, 300), -(10.0 ** rng.uniform(-200, 200, 100)),
                         np.full(200, 7.5), np.zeros(20), [np.inf, -np.inf, 5e-324, 1.7e308, -1.7e308]))
    df = spark.createDataFrame([("k", float(x)) for x in xs], "k string, v double")
    probs = [0.0, 0.1, 0.4, 0.5, 0.8, 1.0]
    n = len(xs)
    exact = [i / (n - 1) for i in (0, 60, 250, 312, 500, n - 1)]  # whole ranks: no interpolation
    r = exact_quantiles(df, ["k"], "v", exact, buckets=buckets, max_window_rows=bound).first()
    assert [r[f"q{i}"] for i in range(len(probs))] == [float(np.sort(xs)[round(p * (n - 1))]) for p in exact]


def test_quantile_rounds_carry_no_values(spark):
    """Before the last scan only slice counts are shuffled: no exchange holds a row per value."""
    from wardflow.functions import quantiles as Q

    seen = []
    write = Q.write_table
    Q.write_table = lambda d: (seen.append(d), write(d))[1]
    try:
        df = spark.range(30_000).select(F.lit("k").alias("k"), (F.col("id") * 1.37).alias("v"))
        r = exact_quantiles(df, ["k"], "v", [0.5], buckets=512, max_window_rows=200).first()
    finally:
        Q.write_table = write
    assert abs(r.q0 - 1.37 * 29999 / 2) < 1e-9
    assert all(d.count() <= 600 for d in seen)


def test_neighbouring_doubles_lose_no_round(spark, monkeypatch):
    from wardflow.functions import quantiles as Q

    near = [0.95, float(np.nextafter(0.95, 1)), float(np.nextafter(0.95, 0))]
    xs = [near[i % 3] for i in range(90)] + [i / 10 for i in range(10)]
    df = spark.createDataFrame([(1, x) for x in xs], "k int, v double")
    monkeypatch.setattr(Q, "MAX_ROUNDS", 2)  # one round to the clump, one to tell its values apart
    r = exact_quantiles(df, ["k"], "v", [0.25, 0.5, 0.75], max_window_rows=20).first()
    assert np.allclose([r.q0, r.q1, r.q2], np.quantile(xs, [0.25, 0.5, 0.75]), rtol=0, atol=0)
