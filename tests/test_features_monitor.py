import datetime as dt

import numpy as np
from fixtures import hand_tables
from pyspark.sql import functions as F

from wardflow import constants as K
from wardflow.operators import features as E
from wardflow.operators import monitor as D
from wardflow.sources.tables import merged_frame


def test_weekday_monday_zero_and_clip_keeps_null(spark):
    m = merged_frame(hand_tables(spark))
    f = E.engineer_features(m, rates=K.HOSPITAL_PROVIDER_REJECTION_RATES)
    r = {x.visit_id: x for x in f.collect()}
    assert r[10].visit_dayofweek == 0
    assert r[12].los_capped is None            # NULL stays NULL when capped
    assert r[14].payment_days_capped == 0.0    # unpaid -> 0 after capping
    assert r[11].approval_ratio == 0.5         # Pending without any Pending ratio -> 0.5
    assert r[12].approval_ratio == 0.0
    assert r[13].approval_ratio == 0.0         # zero billed: NULL ratio, Rejected -> 0
    assert r[10].provider_rejection_rate == 0.148655
    assert r[13].provider_rejection_rate == K.HOSPITAL_DEFAULT_REJECTION_RATE  # blank insurer


def test_iqr_cap_matches_numpy(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.normal(100, 10, 500), [1000.0, -500.0]])
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
    out = np.array([r.x for r in E.iqr_cap(df, ["x"]).collect() if r.x is not None])
    q1, q3 = np.quantile(xs, [0.25, 0.75])
    lo, hi = max(0.0, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)
    assert np.allclose(np.sort(out), np.sort(np.clip(xs, lo, hi)))


def test_positional_split_many_rows_on_cutoff(spark):
    rows = [(i, dt.date(2025, 1, 1) if i < 3 else dt.date(2025, 1, 2), i) for i in range(20)]
    df = spark.createDataFrame(rows, "visit_id long, visit_date date, bill_id long")
    s = {r.split: r.n_rows for r in E.split_summary(E.positional_split(df, 0.8)).collect()}
    assert s == {"train": 16, "test": 4}


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "y string")
    w = {r.y: r.weight for r in E.balanced_class_weights(df, "y").distinct().collect()}
    assert w == {"a": 8 / (2 * 6), "b": 8 / (2 * 2)}


def _psi_utils_numpy(e, a, n_bins=10):
    e, a = np.asarray(e, float), np.asarray(a, float)
    edges = np.unique(np.percentile(e, np.linspace(0, 100, n_bins + 1)))
    if len(edges) < 2:
        return 0.0
    ec, _ = np.histogram(e, bins=edges)
    ac, _ = np.histogram(a, bins=edges)
    ep = (ec + 0.0001) / (len(e) + 0.0001 * len(ec))
    ap = (ac + 0.0001) / (len(a) + 0.0001 * len(ac))
    return float(np.sum((ap - ep) * np.log(ap / ep)))


def _psi_notebook_numpy(e, a, buckets=10):
    e, a = np.asarray(e, float), np.asarray(a, float)
    bp = np.percentile(e, np.arange(0, buckets + 1) / buckets * 100)
    ep, ap = [], []
    for i in range(len(bp) - 1):
        ep.append(max(((e >= bp[i]) & (e < bp[i + 1])).sum() / len(e), 0.0001))
        ap.append(max(((a >= bp[i]) & (a < bp[i + 1])).sum() / len(a), 0.0001))
    ep, ap = np.array(ep), np.array(ap)
    return round(float(np.sum((ep - ap) * np.log(ep / ap))), 4)


def test_psi_variants_against_numpy(spark):
    rng = np.random.default_rng(5)
    e = np.round(rng.normal(50, 10, 800))
    a = np.round(rng.normal(55, 12, 600))
    tied = [1.0] * 500 + [2.0] * 20
    const = [3.0] * 50
    cases = {"x": (e, a), "tied": (tied, tied[::-1][:300]), "const": (const, [3.0, 4.0])}
    for name, (ee, aa) in cases.items():
        ed = spark.createDataFrame([(float(v),) for v in ee], "f double")
        ad = spark.createDataFrame([(float(v),) for v in aa], "f double")
        u = D.psi_table(ed, ad, ["f"], "utils").first().psi
        n = D.psi_table(ed, ad, ["f"], "notebook").first().psi
        assert abs(u - _psi_utils_numpy(ee, aa)) < 1e-9, name
        assert abs(n - _psi_notebook_numpy(ee, aa)) < 1e-9, name


def test_prediction_drift_and_alert(spark):
    base = spark.createDataFrame([(0,)] * 20 + [(1,)] * 80, "prediction int")
    new = spark.createDataFrame([(0,)] * 40 + [(1,)] * 60, "prediction int")
    out = {r.class_name: r for r in D.d4_prediction_drift(base, new, ["A", "B", "C"]).collect()}
    assert out["A"].shift_pct == 20.0 and out["A"].alert
    assert out["C"].baseline_pct == 0.0 and not out["C"].alert
    drift = spark.createDataFrame([("a", 0.3), ("b", 0.3), ("c", 0.26), ("d", 0.12)], "feature string, psi double")
    f1 = spark.createDataFrame([(0.0, 0.5)], "current_macro_f1 double, baseline_macro_f1 double")
    al = D.d5_retraining_alert(drift, f1).first()
    assert al.retrain_recommended and al.severe_drift_count == 3 and al.moderate_drift_count == 1
    assert len(al.reasons) == 2  # F1 of 0 is a value, not "absent"
    assert [(r.code, r.value, r.threshold) for r in al.reasons if r.code == "macro_f1_drop"] == [("macro_f1_drop", 0.5, 0.05)]
    assert al.timestamp is not None and al.macro_f1_drop == 0.5
    assert all(r.code != "macro_f1_drop" for r in D.d5_retraining_alert(drift).first().reasons)


def test_drift_label_is_of_the_unrounded_psi(spark, monkeypatch):
    monkeypatch.setattr(D, "psi_table", lambda *a, **k: spark.createDataFrame(
        [("a", 0.09996), ("b", 0.3)], "feature string, psi double"))
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    rows = D.d3_feature_drift(df, df, ["a", "b"]).collect()
    assert [(r.feature, r.psi, r.status) for r in rows] == [("b", 0.3, "Significant Drift"), ("a", 0.1, "Stable")]


def test_bootstrap_draws_follow_the_key(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    a = sorted(r.k for r in D.d7_bootstrap(df.repartition(7), "k").collect())
    b = sorted(r.k for r in D.d7_bootstrap(df, "k").collect())
    assert a == b and abs(len(a) - 4000) < 300 and abs(len(set(a)) / 4000 - 0.632) < 0.04


def test_smote_partners_are_k_ranks(spark):
    from wardflow.operators.smote import smote

    rows = [("big", float(i), 0.0) for i in range(60)] + [("small", float(i), 1.0) for i in range(12)] + [("one", 5.0, 5.0)]
    out = smote(spark.createDataFrame(rows, "y string, a double, b double"), ["a", "b"], "y", k=5)
    n = {r.y: (r.n, r.s) for r in out.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.col("synthetic").cast("int")).alias("s")).collect()}
    assert n == {"big": (60, 0), "small": (60, 48), "one": (60, 59)}
    made = [r.a for r in out.where("synthetic and y = 'small'").collect()]
    assert all(0 <= a <= 11 for a in made)
    assert out.where("synthetic and y = 'one' and a = 5.0").count() == 59  # a class of one row is repeated


def test_hot_patient_is_split(spark):
    """W1's join has both sides straight from exchanges, so AQE splits a patient with a third of the rows."""
    from wardflow.operators.features import patient_aggregates

    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("patient_id"),
                               F.col("id").alias("visit_id"), F.rand(1).alias("length_of_stay_hours"),
                               F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = patient_aggregates(df)
        assert out.where("patient_id = 0").count() == n // 3
        out.write.format("noop").mode("overwrite").save()
        joined = out.select("*")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_psi_scans_each_feature_alone(spark, monkeypatch):
    rows = [(float(i % 7), float(i), None if i % 5 else float(i)) for i in range(200)]
    old = spark.createDataFrame(rows, "a double, b double, c double")
    new = spark.createDataFrame([(x + 1, y * 2, z) for x, y, z in rows], old.schema)
    plans, write = [], D.write_table
    monkeypatch.setattr(D, "write_table", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    for variant in ("utils", "notebook"):
        got = {r.feature: r.psi for r in D.psi_table(old, new, ["a", "b", "c"], variant).collect()}
        for at, f in enumerate("abc"):
            e = [r[at] for r in rows if r[at] is not None]
            a = [r[f] for r in new.collect() if r[f] is not None]
            edges = np.quantile(e, np.linspace(0, 1, 11))
            edges = np.unique(edges) if variant == "utils" else edges
            n = len(edges) - 1
            bins = lambda xs: np.array([sum(
                lo <= x and (x < hi or (variant == "utils" and i == n - 1 and x == hi)) for x in xs)
                for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))], float)
            if variant == "utils":
                p, q = ((bins(xs) + 1e-4) / (len(xs) + 1e-4 * n) for xs in (e, a))
            else:
                p, q = (np.maximum(bins(xs) / len(xs), 1e-4) for xs in (e, a))
            assert abs(got[f] - ((q - p) * np.log(q / p)).sum()) < (1e-9 if variant == "utils" else 1e-4)
    assert all("Generate" not in p for p in plans)
