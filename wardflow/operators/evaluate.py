"""Evaluation over (label, prediction, probs) rows.

Every metric starts from one ``groupBy(label, prediction).count()`` (at
most k x k rows for k classes, whatever the row count), so the heavy part
is a single partial aggregation; the rest is arithmetic on tiny frames.
Class lists are passed explicitly and metrics are keyed by label, never by
position.  Zero division gives 0 (sklearn ``zero_division=0``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow import constants as K
from wardflow.functions.prefix import totals_before


def _classes(spark, classes: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(classes)], "class_idx int, class_name string")


def _safe(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def per_class_metrics(df: DataFrame, classes: list[str], label: str = "label",
                      pred: str = "prediction", by: list[str] = ()) -> DataFrame:
    """(by..., class_name, tp, support, predicted, precision, recall, f1).

    One linear plan: the confusion cells (at most k x k per ``by`` group)
    each explode into their support / predicted / tp contributions plus a
    zero row for every listed class, and one small ``groupBy`` sums them.
    No join, so the scored rows are scanned once.  Labels or predictions
    outside ``classes`` (and NULL) get no row, as with a class grid, but
    ``n_rows`` counts every row given, and accuracies are shares of it.
    """
    by = list(by)
    cm = df.groupBy(*by, F.col(label).alias("_l"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("bigint")
    parts = [
        F.struct(F.col("_l").alias("class_name"), F.col("_n").alias("support"), zero.alias("predicted"),
                 F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(zero).alias("tp")),
        F.struct(F.col("_p").alias("class_name"), zero.alias("support"), F.col("_n").alias("predicted"),
                 zero.alias("tp")),
        *[F.struct(F.lit(c).alias("class_name"), zero.alias("support"), zero.alias("predicted"), zero.alias("tp"))
          for c in classes],
    ]
    cells = cm.select(*by, F.explode(F.array(*parts)).alias("_s")).select(*by, "_s.*")
    if not by:  # an empty input still reports every class with zeros
        cells = cells.unionByName(_classes(df.sparkSession, classes).select(
            "class_name", zero.alias("support"), zero.alias("predicted"), zero.alias("tp")))
    # every unlisted label counts as one class, so that n_rows is over all rows given
    listed = F.when(F.col("class_name").isin(list(classes)), F.col("class_name"))
    m = (
        cells.groupBy(*by, listed.alias("class_name"))
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
        .withColumn("n_rows", F.sum("support").over(Window.partitionBy(*(by or [F.lit(1)]))))  # k + 1 rows a window
        .where(F.col("class_name").isNotNull())
    )
    p = _safe(F.col("tp").cast("double"), F.col("predicted"))
    r = _safe(F.col("tp").cast("double"), F.col("support"))
    return m.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def v1_classification_report(df: DataFrame, classes: list[str], label: str = "label",
                             pred: str = "prediction") -> DataFrame:
    """Per-class rows plus 'accuracy', 'macro avg', 'weighted avg' rows.

    The k per-class rows are gathered into one array (k is the length of
    the class list) next to the totals, then exploded with the three
    summary rows: the metrics plan is read once.
    """
    m = per_class_metrics(df, classes, label, pred)
    one = m.agg(
        F.collect_list(F.struct(F.col("class_name").alias("label"), "precision", "recall",
                                F.col("f1").alias("f1_score"),
                                F.col("support").cast("bigint").alias("support"))).alias("cs"),
        F.sum("support").alias("n"), F.max("n_rows").alias("n_rows"), F.sum("tp").alias("tp_all"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        _safe(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        _safe(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        _safe(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    acc = _safe(F.col("tp_all").cast("double"), F.col("n_rows"))
    n, n_rows = F.col("n").cast("bigint"), F.col("n_rows").cast("bigint")
    summary = F.array(
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1_score"), n_rows.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1_score"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1_score"), n.alias("support")),
    )
    return one.select(F.explode(F.concat("cs", summary)).alias("s")).select("s.*")


def v2_confusion_matrix(df: DataFrame, classes: list[str], label: str = "label",
                        pred: str = "prediction") -> DataFrame:
    """Every (actual, predicted) cell incl. zeros, with row-normalised share.

    Observed cells are unioned with the zero k x k grid and summed (no
    join); row totals come from a window over the k x k result.
    """
    cm = df.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    cls = _classes(df.sparkSession, classes)
    grid = cls.select(F.col("class_name").alias("actual")).crossJoin(
        cls.select(F.col("class_name").alias("predicted"))).select(
        "actual", "predicted", F.lit(0).cast("bigint").alias("count"))
    out = (
        cm.where(F.col("actual").isin(list(classes)) & F.col("predicted").isin(list(classes)))
        .unionByName(grid).groupBy("actual", "predicted").agg(F.sum("count").alias("count"))
    )
    row = F.sum("count").over(Window.partitionBy("actual"))  # k rows per window
    return out.select("actual", "predicted", "count", _safe(F.col("count").cast("double"), row).alias("row_share"))


def _summary_row(m: DataFrame, critical: str) -> DataFrame:
    return m.agg(
        _safe(F.sum("tp").cast("double"), F.max("n_rows")).alias("overall_accuracy"),
        F.avg("f1").alias("macro_f1"),
        _safe(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.max(F.when(F.col("class_name") == critical, F.col("recall"))).alias("critical_recall"),
        F.max(F.when(F.col("class_name") == critical, F.col("precision"))).alias("critical_precision"),
        F.max(F.when(F.col("class_name") == critical, F.col("f1"))).alias("critical_f1"),
        F.max(F.when(F.col("class_name") == critical, F.col("support"))).cast("bigint").alias("critical_support"),
        F.max(F.when(F.col("class_name") == critical, F.col("support") - F.col("tp"))).cast("bigint")
        .alias("critical_missed"),
    )


def v3_business_metrics(df: DataFrame, classes: list[str], critical: str, label: str = "label",
                        pred: str = "prediction", amount_col: str | None = None,
                        recall_target: float | None = None) -> DataFrame:
    """Accuracy, F1s and critical-class numbers; revenue at risk = missed x mean amount."""
    s = _summary_row(per_class_metrics(df, classes, label, pred), critical)
    if amount_col:
        s = s.crossJoin(df.agg(F.avg(amount_col).alias("_avg_amt"))).withColumn(
            "revenue_at_risk", F.col("critical_missed") * F.col("_avg_amt")).drop("_avg_amt")
    if recall_target is not None:
        s = s.withColumn("below_target", F.col("critical_recall") < F.lit(recall_target))
    return s


def v4_overfit_gap(train_pred: DataFrame, test_pred: DataFrame, classes: list[str],
                   label: str = "label", pred: str = "prediction",
                   flag: float = K.OVERFIT_GAP_FLAG) -> DataFrame:
    """Train - test accuracy and macro F1, flagged above ``flag``."""
    def one(df, name):
        m = per_class_metrics(df, classes, label, pred)
        return m.agg(_safe(F.sum("tp").cast("double"), F.max("n_rows")).alias("accuracy"), F.avg("f1").alias("macro_f1")) \
            .unpivot([], ["accuracy", "macro_f1"], "metric", name)
    out = one(train_pred, "train").join(one(test_pred, "test"), "metric")
    gap = F.col("train") - F.col("test")
    return out.select("metric", "train", "test", gap.alias("gap"), (gap > flag).alias("overfit"))


def v5_fairness(df: DataFrame, segments: list[str], classes: list[str], critical: str,
                label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per segment column and value: n, accuracy, macro F1 (classes present in the
    segment), critical recall by label, band and segment-column mean of that recall."""
    segs = [s for s in segments if s in df.columns]
    long = df.select(F.col(label).alias("_lab"), F.col(pred).alias("_prd"),
                     *[F.col(s).cast("string").alias(s) for s in segs]).unpivot(
        ["_lab", "_prd"], segs, "segment_column", "segment_value")
    m = per_class_metrics(long, classes, "_lab", "_prd", by=["segment_column", "segment_value"])
    present = (F.col("support") > 0) | (F.col("predicted") > 0)
    agg = m.groupBy("segment_column", "segment_value").agg(
        F.max("n_rows").cast("bigint").alias("n_records"),
        _safe(F.sum("tp").cast("double"), F.max("n_rows")).alias("overall_acc"),
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1"),
        F.max(F.when(F.col("class_name") == critical, F.col("recall"))).alias("critical_recall"),
    ).where(F.col("n_records") > 0)
    lo, hi = K.FAIRNESS_BANDS
    # one window per segment column (its distinct values), no self-join of ``agg``
    mean = F.avg("critical_recall").over(Window.partitionBy("segment_column"))
    return agg.withColumn("segment_mean_recall", mean).withColumn(
        "band", F.when(F.col("critical_recall") < lo, F.lit("red"))
        .when(F.col("critical_recall") < hi, F.lit("amber")).otherwise(F.lit("green")))


def v6_segment_performance(df: DataFrame, segments: list[str], classes: list[str], critical: str,
                           label: str = "label", pred: str = "prediction",
                           flag: float = K.SEGMENT_GAP_FLAG) -> DataFrame:
    """Segment macro F1 minus overall macro F1, flagged below ``flag``."""
    fair = v5_fairness(df, segments, classes, critical, label, pred)
    overall = per_class_metrics(df, classes, label, pred).agg(F.avg("f1").alias("overall_macro_f1"))
    gap = F.col("macro_f1") - F.col("overall_macro_f1")
    return fair.crossJoin(F.broadcast(overall)).select(
        "segment_column", "segment_value", "n_records", "macro_f1", "overall_macro_f1",
        gap.alias("f1_gap"), (gap < flag).alias("underperforming"))


def _score_counts(df: DataFrame, classes: list[str], label: str, probs: str) -> DataFrame:
    """(class_name, score, pos, neg): one row per class and distinct score."""
    rows = df.select(
        F.col(label).alias("_lab"),
        F.posexplode(F.col(probs)).alias("_ci", "score"),
    ).join(F.broadcast(_classes(df.sparkSession, classes)), F.col("_ci") == F.col("class_idx"))
    return rows.groupBy("class_name", "score").agg(
        F.count(F.when(F.col("_lab") == F.col("class_name"), 1)).alias("pos"),
        F.count(F.when(F.col("_lab") != F.col("class_name"), 1)).alias("neg"))


def v7_roc_auc(df: DataFrame, classes: list[str], label: str = "label", probs: str = "probs") -> DataFrame:
    """One-vs-rest AUC per class (Mann-Whitney with tie credit = trapezoid AUC)."""
    sc = totals_before(_score_counts(df, classes, label, probs), ["class_name"], "score", ["neg"])
    return sc.groupBy("class_name").agg(
        (F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg")))
         / (F.sum("pos") * F.sum("neg"))).alias("auc"),
        F.sum("pos").cast("bigint").alias("n_pos"), F.sum("neg").cast("bigint").alias("n_neg"))


def v7_roc_points(df: DataFrame, classes: list[str], label: str = "label", probs: str = "probs") -> DataFrame:
    """(class_name, threshold, fpr, tpr) at every distinct score, plus the origin."""
    sc = totals_before(_score_counts(df, classes, label, probs), ["class_name"], "score", ["pos", "neg"])
    tot = sc.groupBy("class_name").agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pts = sc.join(F.broadcast(tot), "class_name").select(
        "class_name", F.col("score").alias("threshold"),
        _safe((F.col("_N") - F.col("neg_before")).cast("double"), F.col("_N")).alias("fpr"),
        _safe((F.col("_P") - F.col("pos_before")).cast("double"), F.col("_P")).alias("tpr"))
    origin = tot.select("class_name", F.lit(float("inf")).alias("threshold"),
                        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def v10_model_card(model: str, report: DataFrame, business: DataFrame, fairness: DataFrame) -> DataFrame:
    """Model card as (model, section, name, metric, value) rows."""
    rep = report.unpivot(["label"], ["precision", "recall", "f1_score"], "metric", "value").select(
        F.lit("report").alias("section"), F.col("label").alias("name"), "metric", "value")
    num = [c for c, t in business.dtypes if t in ("double", "bigint", "int")]
    bus = business.select(*[F.col(c).cast("double") for c in num]).unpivot([], num, "metric", "value").select(
        F.lit("business").alias("section"), F.lit("overall").alias("name"), "metric", "value")
    fair = fairness.select(
        F.lit("fairness").alias("section"),
        F.concat_ws("=", "segment_column", "segment_value").alias("name"),
        F.lit("critical_recall").alias("metric"), F.col("critical_recall").alias("value"))
    return rep.unionByName(bus).unionByName(fair).select(F.lit(model).alias("model"), "*")
