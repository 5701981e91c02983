import itertools

import numpy as np

from wardflow.operators import evaluate as V

CL = ["a", "b", "c"]


def _df(spark, rows):
    return spark.createDataFrame(rows, "label string, prediction string, seg string, probs array<double>")


def test_report_zero_division_and_never_predicted(spark):
    rows = [("a", "a", "x", [0.9, 0.05, 0.05]), ("a", "b", "x", [0.2, 0.7, 0.1]),
            ("b", "b", "y", [0.1, 0.8, 0.1]), ("c", "b", "y", [0.3, 0.4, 0.3])]
    rep = {r.label: r for r in V.v1_classification_report(_df(spark, rows), CL).collect()}
    assert rep["c"].precision == 0.0 and rep["c"].recall == 0.0 and rep["c"].f1_score == 0.0
    assert rep["b"].precision == 1 / 3 and rep["b"].recall == 1.0
    assert rep["accuracy"].precision == 0.5
    assert abs(rep["macro avg"].f1_score - np.mean([2 / 3, 0.5, 0.0])) < 1e-12
    cm = {(r.actual, r.predicted): r["count"] for r in V.v2_confusion_matrix(_df(spark, rows), CL).collect()}
    assert len(cm) == 9 and cm[("c", "c")] == 0


def test_fairness_segment_lacking_class(spark):
    rows = [("a", "a", "x", [0.9, 0.05, 0.05]), ("b", "b", "x", [0.1, 0.8, 0.1]),
            ("b", "b", "y", [0.1, 0.8, 0.1]), ("c", "b", "y", [0.3, 0.4, 0.3])]
    df = _df(spark, rows)
    f = {r.segment_value: r for r in V.v5_fairness(df, ["seg"], CL, "a").collect()}
    assert f["y"].critical_recall == 0.0      # class 'a' absent: recall by label is 0
    assert f["x"].macro_f1 == 1.0             # macro over classes present in the segment


def test_auc_matches_pairwise_brute_force(spark):
    rng = np.random.default_rng(11)
    labels = rng.choice(CL, 300)
    raw = np.round(rng.random((300, 3)), 2)
    probs = raw / raw.sum(1, keepdims=True)
    rows = [(str(l), "a", "x", [float(v) for v in p]) for l, p in zip(labels, probs)]
    got = {r.class_name: r.auc for r in V.v7_roc_auc(_df(spark, rows), CL).collect()}
    for i, c in enumerate(CL):
        pos, neg = probs[labels == c, i], probs[labels != c, i]
        wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg))
        assert abs(got[c] - wins / (len(pos) * len(neg))) < 1e-12
    pts = V.v7_roc_points(_df(spark, rows), CL).where("class_name = 'a'").collect()
    assert max(p.tpr for p in pts) == 1.0 and min(p.fpr for p in pts) == 0.0


def test_per_class_metrics_unlisted_null_and_empty(spark):
    """Cells outside the class list or NULL count only where sklearn with
    ``labels=`` would count them; an empty input still lists every class."""
    rows = [("a", "a", "x", None), ("a", "z", "x", None), ("z", "a", "x", None),
            (None, "b", "x", None), ("b", None, "x", None), ("b", "b", "x", None)]
    m = {r.class_name: r for r in V.per_class_metrics(_df(spark, rows), CL).collect()}
    assert set(m) == set(CL)
    # 'a': support counts (a,a),(a,z); predicted counts (a,a),(z,a)
    assert (m["a"].support, m["a"].predicted, m["a"].tp) == (2, 2, 1)
    # 'b': support (b,None),(b,b); predicted (None,b),(b,b)
    assert (m["b"].support, m["b"].predicted, m["b"].tp) == (2, 2, 1)
    assert (m["c"].support, m["c"].predicted, m["c"].tp) == (0, 0, 0)
    empty = _df(spark, rows).where("false")
    rep = {r.label: r for r in V.v1_classification_report(empty, CL).collect()}
    assert {c for c in CL} <= set(rep) and rep["a"].support == 0
    cm = V.v2_confusion_matrix(_df(spark, rows), CL).collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 2


def test_accuracy_is_over_all_rows(spark):
    rows = [("a", "a", "x", None), ("a", "a", "x", None), ("z", "a", "x", None), (None, "a", "x", None)]
    rep = {r.label: r for r in V.v1_classification_report(_df(spark, rows), CL).collect()}
    assert (rep["accuracy"].precision, rep["accuracy"].support) == (0.5, 4)
    assert V.v3_business_metrics(_df(spark, rows), CL, "a").first().overall_accuracy == 0.5
    f = V.v5_fairness(_df(spark, rows), ["seg"], CL, "a").first()
    assert (f.n_records, f.overall_acc) == (4, 0.5)
