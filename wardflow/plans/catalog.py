"""Registry of named queries: (spark, sf_dir) -> DataFrame.

Each query reads the given tables through the test-data adapter, so its
work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardflow import constants as K
from wardflow.operators import evaluate as V
from wardflow.operators import features as E
from wardflow.operators import models as M
from wardflow.operators import monitor as D
from wardflow.operators import quality as Q
from wardflow.operators import stats as A
from wardflow.operators import reports as R
from wardflow.operators import scoring as S
from wardflow.sources import logs as L
from wardflow.functions.scalar import decode, iso_timestamp, map_lookup, model_version
from wardflow.session import materialize, new_folder
from wardflow.sources.tables import HEAVY_ROWS, Tables, from_testdata, merged_frame

QueryFn = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, QueryFn] = {}


def merged_table(t: Tables, columns: list[str] | None = None):
    """The merged frame (or some of its columns) written once, for queries that scan it several times.

    Queries of one pass take the lazy ``merged_frame``, so their columns and
    filters reach the scans of the source tables.
    """
    m = merged_frame(t, HEAVY_ROWS)
    return materialize(m.select(*columns) if columns else m)


def register(name: str, fn: Callable[[Tables], DataFrame]) -> None:
    _REGISTRY[name] = lambda spark, sf_dir: fn(from_testdata(spark, sf_dir))


for _name, _fn in [
    ("r1_department_volume", R.r1_department_volume),
    ("r2_department_los", R.r2_department_los),
    ("r3_department_risk_mix", R.r3_department_risk_mix),
    ("r4_city_visits_per_patient", R.r4_city_visits_per_patient),
    ("r5_top_doctors_high_risk", R.r5_top_doctors_high_risk),
    ("r6_insurer_billed", R.r6_insurer_billed),
    ("r7_insurer_rejection", R.r7_insurer_rejection),
    ("r8_insurer_payment_delay", R.r8_insurer_payment_delay),
    ("r9_department_realization", R.r9_department_realization),
    ("r10_high_bills_without_approval", R.r10_high_bills_without_approval),
    ("r11_kpi_snapshot", R.r11_kpi_snapshot),
]:
    register(_name, _fn)


for _name, _fn in [
    ("q1_visits_without_billing", Q.q1_visits_without_billing),
    ("q2_orphan_billing", Q.q2_orphan_billing),
    ("q3_duplicate_patient_ids", Q.q3_duplicate_patient_ids),
    ("q3_duplicate_bill_ids", Q.q3_duplicate_bill_ids),
    ("q4_invalid_field_summary", Q.q4_invalid_field_summary),
    ("q5_missing_insurance", Q.q5_missing_insurance),
    ("q6_missing_value_summary", lambda t: Q.q6_missing_value_summary(merged_frame(t))),
    ("q7_nulls_by_month", lambda t: Q.q7_nulls_by_month(merged_frame(t))),
    ("q8_nulls_by_status", lambda t: Q.q8_nulls_by_status(merged_frame(t))),
    ("q9_constraint_check", Q.q9_constraint_check),
    ("q10_missing_values", lambda t: Q.q10_missing_values(merged_frame(t))),
    ("q10_range_violations", lambda t: Q.q10_range_violations(merged_frame(t))),
    ("q10_unseen_categories", lambda t: Q.q10_unseen_categories(merged_frame(t))),
    ("q11_quality_status", lambda t: Q.q11_quality_status(merged_frame(t))),
]:
    register(_name, _fn)


TESTDATA_SPLIT_DATE = "2000-01-01"
IQR_COLS = ["billed_amount", "payment_days", "length_of_stay_hours"]
CORR_COLS = ["age", "chronic_flag", "length_of_stay_hours", "billed_amount", "approved_amount", "payment_days"]
DESCRIBE_COLS = ["age", "length_of_stay_hours", "billed_amount", "approved_amount", "payment_days"]
ENGINEERED = ["visit_frequency", "avg_los_per_patient", "provider_rejection_rate",
              "days_since_registration", "approval_ratio", "billed_amount_capped",
              "payment_days_capped", "los_capped", "visit_month", "visit_dayofweek", "visit_quarter"]


def _model_table(t: Tables, columns: list[str] | None = None, merged: DataFrame | None = None):
    """The model table, or some of its columns made from no more of the merged frame than they need.

    ``merged`` is the written merged frame of a query that also reads it for something else.
    """
    base = merged_table(t, E.inputs_of(columns) if columns else None) if merged is None else merged
    return E.build_model_table(base, K.testdata_encoding_maps(), columns=columns)


def _features_n(t: Tables):
    f = E.encode_alphabetical(E.engineer_features_n(merged_table(t)))
    return f.select("visit_id", "patient_id", "bill_id", "days_since_registration", "visit_month",
                    "visit_day_of_week", "patient_visit_frequency", "avg_los_per_patient",
                    "approved_amount", "payment_days", "approval_ratio",
                    *[c + "_enc" for c in K.CATEGORY_FIELDS])


def _time_split(t: Tables):
    from pyspark.sql import functions as F

    train, test = E.time_split(merged_frame(t), "visit_date", TESTDATA_SPLIT_DATE)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return E.split_summary(both)


for _name, _fn in [
    ("e7_model_table", _model_table),
    ("e8_features_n", _features_n),
    ("w2_positional_split", lambda t: E.split_summary(E.positional_split(
        merged_table(t, ["visit_date", "visit_id", "bill_id"])))),
    ("e10_time_split", _time_split),
    ("a1_value_counts", lambda t: A.a1_value_counts(merged_frame(t), ["visit_type", "claim_status", "risk_score"])),
    ("a2_crosstab_department_risk",
     lambda t: A.a2_crosstab(merged_frame(t), "department", "risk_score", ["Low", "Medium", "High"])),
    ("a3_rejection_rate_by_insurer", lambda t: A.a3_rejection_rate_by_insurer(merged_frame(t))),
    ("a4_city_billing", lambda t: A.a4_city_billing(merged_frame(t))),
    ("a5_histogram_billed", lambda t: A.a5_histogram(merged_frame(t), "billed_amount", 50)),
    ("a6_box_billed_by_insurer",
     lambda t: A.a6_box_summary(merged_table(t, ["insurance_provider", "billed_amount"]), "insurance_provider",
                                ["billed_amount"])),
    ("a7_iqr_summary", lambda t: A.a7_iqr_summary(merged_table(t, IQR_COLS), IQR_COLS)),
    ("a8_zscore_summary", lambda t: A.a8_zscore_summary(merged_frame(t), IQR_COLS)),
    ("a9_correlation_pairs", lambda t: A.a9_correlation_pairs(merged_frame(t), CORR_COLS)),
    ("a10_overview", lambda t: A.a10_overview(merged_frame(t))),
    ("a11_describe", lambda t: A.a11_describe(merged_table(t, DESCRIBE_COLS), DESCRIBE_COLS)),
    ("a12_rate_per_insurer",
     lambda t: A.a12_first_per_group(E.provider_rejection_rate(
         merged_table(t, ["insurance_provider", "claim_status"])), "insurance_provider", "provider_rejection_rate")),
    ("a13_feature_profile", lambda t: A.a13_feature_profile(_model_table(t), K.MODEL_FEATURES_U)),
    ("a14_medians", lambda t: A.a14_medians(merged_table(t))),
    ("a17_engineered_profile",
     lambda t: A.a17_engineered_profile(E.engineer_features(merged_table(t)), ENGINEERED)),
]:
    register(_name, _fn)


def _written_model_table(t: Tables, *columns: str) -> DataFrame:
    """The dates and the given columns of the model table, written once for everything in a query that reads them."""
    return materialize(_model_table(t, list(dict.fromkeys(["visit_date", *columns]))))


def _train_new(t: Tables, columns: list[str] | None = None, table: DataFrame | None = None):
    if table is None:
        table = _written_model_table(t, *columns) if columns else materialize(_model_table(t))
    return E.time_split(table, "visit_date", TESTDATA_SPLIT_DATE)


def _d3(t: Tables, table: DataFrame | None = None):
    tr, nw = _train_new(t, K.DRIFT_FEATURES_N, table)
    return D.d3_feature_drift(tr, nw, K.DRIFT_FEATURES_N)


def _d2(t: Tables):
    tr, nw = _train_new(t, K.DRIFT_FEATURES_N)
    return D.d2_feature_drift_notebook(tr, nw, K.DRIFT_FEATURES_N)


def _d4(t: Tables, table: DataFrame | None = None):
    tr, nw = _train_new(t, ["risk_score_encoded"], table)
    return D.d4_prediction_drift(tr, nw, K.RISK_CLASSES, pred_col="risk_score_encoded")


for _name, _fn in [("d3_feature_drift", _d3), ("d2_feature_drift_notebook", _d2),
                   ("d4_prediction_drift", _d4)]:
    register(_name, _fn)


CLAIM_CENTROID_FEATURES = ["approval_ratio", "payment_days_capped", "billed_amount_capped", "los_capped"]
FAIRNESS_SEGMENTS = ["gender", "city", "insurance_provider"]


RISK_CENTROID_FEATURES = ["age", "los_capped", "avg_los_per_patient", "visit_frequency"]
CC, CRIT = K.CLAIM_CLASSES, K.REJECTED_CLASS
#: model name -> (features, label, classes, critical class, recall target)
BASELINES = {
    "claim": (CLAIM_CENTROID_FEATURES, "claim_status", CC, CRIT, K.REJECTED_RECALL_TARGET),
    "risk": (RISK_CENTROID_FEATURES, "risk_score", K.RISK_CLASSES, "High", K.HIGH_RISK_RECALL_TARGET),
}


def _prediction_columns(name: str) -> list[str]:
    """Columns of the model table that a baseline model and the metrics of its predictions read."""
    features, label, _, _, _ = BASELINES[name]
    return [label, *FAIRNESS_SEGMENTS, *features, "billed_amount_capped"]


def _predictions(t: Tables, name: str, feature_sets=None, table: DataFrame | None = None,
                 columns: list[str] | None = None):
    """Baseline models fitted on the train dates, applied to both splits: one pair a feature set.

    ``table`` is a written model table that holds the columns; ``columns`` are those that the caller reads.
    """
    from pyspark.sql import functions as F

    features, label, classes, _, _ = BASELINES[name]
    if table is None:
        columns = ["visit_date", *(columns or _prediction_columns(name))]
        table = materialize(_model_table(t, list(dict.fromkeys(columns))).where(F.col(label).isNotNull()))
    tr, te = E.time_split(table.where(F.col(label).isNotNull()), "visit_date", TESTDATA_SPLIT_DATE)
    out = []
    for feats in feature_sets or [features]:
        # the 1-row fitted model is the cut: scoring is a row-wise projection over the
        # written model table, so a split that a metric never reads is never scored
        model = materialize(M.centroid_fit(tr, feats, label, classes))
        out.append(tuple(M.centroid_predict(df, model, feats, classes).withColumn("label", F.col(label))
                         for df in (tr, te)))
    return out


def _claim_predictions(t: Tables, table: DataFrame | None = None):
    return _predictions(t, "claim", table=table)[0]


def _v3(te, name: str):
    _, _, classes, critical, target = BASELINES[name]
    return V.v3_business_metrics(te, classes, critical, amount_col="billed_amount_capped", recall_target=target)


def _v3b(t: Tables, name: str):
    """Critical recall and caught rows of a two-feature and the full baseline model, side by side."""
    from pyspark.sql import functions as F

    features = BASELINES[name][0]
    rows = None
    for model, (_, te) in zip(("two_features", "all_features"), _predictions(t, name, [features[:2], features]), strict=True):
        one = _v3(te, name).select(
            F.lit(model).alias("model"), "critical_recall",
            (F.col("critical_support") - F.col("critical_missed")).alias("critical_caught"), "critical_support", "below_target")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _register_evaluation(name: str) -> None:
    features, label, classes, critical, _ = BASELINES[name]
    for query, fn in {
        "v1_report": lambda tr, te: V.v1_classification_report(te, classes),
        "v2_confusion": lambda tr, te: V.v2_confusion_matrix(te, classes),
        "v3_business": lambda tr, te: _v3(te, name),
        "v4_overfit": lambda tr, te: V.v4_overfit_gap(tr, te, classes),
        "v5_fairness": lambda tr, te: V.v5_fairness(te, FAIRNESS_SEGMENTS, classes, critical),
        "v6_segments": lambda tr, te: V.v6_segment_performance(te, FAIRNESS_SEGMENTS, classes, critical),
        "v7_auc": lambda tr, te: V.v7_roc_auc(te, classes),
        "v7_roc_points": lambda tr, te: V.v7_roc_points(te, classes),
    }.items():
        only = [label, *features] if query.startswith("v7_") else None  # curves need no segments or amounts
        register(f"{query}_{name}", lambda t, fn=fn, only=only: fn(*_predictions(t, name, columns=only)[0]))
    register(f"v3b_critical_recall_{name}", lambda t: _v3b(t, name))


for _name in BASELINES:
    _register_evaluation(_name)


# ----------------------------------------------------------- scoring and logs
def _requests(t: Tables):
    """Claim requests derived from the tables: merged rows plus variant-N fields."""
    return E.engineer_features_n(merged_table(t))


def _e9(t: Tables):
    m = merged_table(t)
    f = S.scoring_features(m, K.testdata_encoding_maps(), E.rejection_rates_from_data(m))
    return f.select("visit_id", "bill_id", "visit_frequency", "avg_los_per_patient", "provider_rejection_rate",
                    "days_since_registration", "approval_ratio", "billed_amount_capped", "payment_days_capped",
                    "los_capped", "visit_month", "visit_dayofweek", "visit_quarter",
                    *[c + "_encoded" for c in K.CATEGORY_FIELDS])


def _q14_risk(t: Tables):
    v = S.validate_requests(_requests(t), S.RISK_REQUEST_BOUNDS, S.RISK_REQUEST_CATEGORIES, K.testdata_encoding_maps())
    return S.validation_summary(v)


def _q14(t: Tables):
    v = S.validate_requests(_requests(t), S.CLAIM_REQUEST_BOUNDS, S.CLAIM_REQUEST_CATEGORIES,
                            K.testdata_encoding_maps())
    return S.validation_summary(v)


def _claim_split(t: Tables, merged: DataFrame | None = None, keyed: bool = False):
    """Dates, labels and features of the labelled rows before and from the split date.

    With ``keyed``, ``row_key`` hashes all columns of a row's model table.
    """
    from pyspark.sql import functions as F

    columns = ["visit_date", "claim_status", *K.MODEL_FEATURES_U]
    mt = _model_table(t, None if keyed else columns, merged).where(F.col("claim_status").isNotNull())
    if keyed:
        mt = mt.select(*columns, F.xxhash64(*mt.columns).alias("row_key"))
    return E.time_split(materialize(mt), "visit_date", TESTDATA_SPLIT_DATE)


def _claim_rf(t: Tables, merged: DataFrame | None = None, keyed: bool = False):
    """Claim model (variant U features, balanced weights) and the rows on either side of the split."""
    tr, te = _claim_split(t, merged, keyed)
    w = E.balanced_class_weights(tr, "claim_status")
    (model,) = M.train_forests(w, [K.MODEL_FEATURES_U], "claim_status", K.CLAIM_CLASSES, weight_col="weight")
    return model, tr, te


HASH_FIELDS = ["visit_id", "patient_id", "age", "gender", "city", "chronic_flag", "department", "visit_type",
               "insurance_provider", "length_of_stay_hours", "billed_amount", "approved_amount", "payment_days"]


def _m6(t: Tables):
    """Score every row as a claim request, decided or not (E9 -> model -> response)."""
    from pyspark.sql import functions as F

    req = merged_table(t)  # both the requests and the training rows
    model, _, _ = _claim_rf(t, req)
    feats = S.scoring_features(req, K.testdata_encoding_maps(), E.rejection_rates_from_data(req))
    return S.score_requests(model, feats, K.CLAIM_CLASSES, HASH_FIELDS, version="v1",
                            clock=F.lit("2026-01-01 00:00:00").cast("timestamp"))


def _m7(t: Tables):
    model, _, _ = _claim_rf(t)
    return M.feature_importances(model, K.MODEL_FEATURES_U)


def _m7_permuted(t: Tables):
    """Permutation importances of the baseline claim model on the new rows."""
    from pyspark.sql import functions as F

    feats, label = CLAIM_CENTROID_FEATURES, "claim_status"
    base = merged_table(t, ["visit_id", "bill_id", *E.inputs_of(["visit_date", label, *feats])])
    # the keys go through the feature projection as they are
    rows = E.engineer_features(base, only=feats).select("visit_id", "bill_id", "visit_date", label, *feats)
    tr, te = E.time_split(materialize(rows.where(F.col(label).isNotNull())), "visit_date", TESTDATA_SPLIT_DATE)
    model = materialize(M.centroid_fit(tr, feats, label, K.CLAIM_CLASSES))
    return M.permutation_importances(
        te, feats, label, F.concat_ws("-", "visit_id", "bill_id"),
        lambda df: M.centroid_predict(df, model, feats, K.CLAIM_CLASSES), feats)


def _m9(t: Tables):
    from pyspark.sql import functions as F

    rf, tr, te = _claim_rf(t)
    lr = M.train_logistic(E.balanced_class_weights(tr, "claim_status"), K.MODEL_FEATURES_U, "claim_status",
                          K.CLAIM_CLASSES, weight_col="weight")
    rows = None
    for name, m in [("logistic_regression", lr), ("random_forest", rf)]:
        p = M.predict(m, te, K.CLAIM_CLASSES).select(
            F.col("claim_status").alias("label"), F.col("predicted_class").alias("prediction"))
        b = V.v3_business_metrics(p, K.CLAIM_CLASSES, K.REJECTED_CLASS).select(
            F.lit(name).alias("model"), "overall_accuracy", "macro_f1", "weighted_f1", "critical_recall")
        rows = b if rows is None else rows.unionByName(b)
    return M.model_comparison(rows)


def _m8(t: Tables):
    """Leakage ablation: the variant-N claim rows refit without the two leaking features."""
    from pyspark.sql import functions as F

    # codes first: they are fitted on the written frame, not on the joins of the features
    rows = E.engineer_features_n(E.encode_alphabetical(merged_table(t))).where(F.col("claim_status").isNotNull())
    tr, te = E.time_split(materialize(rows.select("visit_date", "claim_status", *K.CLAIM_FEATURES_N)),
                          "visit_date", TESTDATA_SPLIT_DATE)
    kept = [f for f in K.CLAIM_FEATURES_N if f not in ("approval_ratio", "approved_amount")]
    rf, ab = M.train_forests(tr, [K.CLAIM_FEATURES_N, kept], "claim_status", K.CLAIM_CLASSES, max_depth=12)

    def acc(m, name):
        p = M.predict(m, te, K.CLAIM_CLASSES)
        return p.agg(F.avg((F.col("claim_status") == F.col("predicted_class")).cast("double")).alias("accuracy")) \
            .select(F.lit(name).alias("variant"), "accuracy")
    both = materialize(acc(rf, "all_features").unionByName(acc(ab, "without_leak_features")))  # read twice
    full = both.where(F.col("variant") == "all_features").select(F.col("accuracy").alias("_full"))
    return both.crossJoin(full).withColumn("accuracy_drop", F.col("_full") - F.col("accuracy")).drop("_full")


def _log_dir(t: Tables, name: str) -> str:
    return new_folder(t.spark, name)


#: What a claim request must carry to be scored; others are answered with a rejection.
REQUIRED_FIELDS = ["billed_amount", "length_of_stay_hours"]


def _claim_centroids(t: Tables, merged: DataFrame | None = None) -> DataFrame:
    """The baseline claim model, fitted on the columns that it reads."""
    from pyspark.sql import functions as F

    columns = ["visit_date", "claim_status", *CLAIM_CENTROID_FEATURES]
    labelled = _model_table(t, columns, merged).where(F.col("claim_status").isNotNull())
    tr, _ = E.time_split(materialize(labelled), "visit_date", TESTDATA_SPLIT_DATE)
    return materialize(M.centroid_fit(tr, CLAIM_CENTROID_FEATURES, "claim_status", K.CLAIM_CLASSES))


def _baseline_responses(t: Tables):
    """Every row answered: scored by the baseline claim model, which SQL can replay, or rejected with codes."""
    from pyspark.sql import functions as F

    req = merged_table(t)  # both the requests and the training rows
    model = _claim_centroids(t, req)
    feats = S.scoring_features(req, K.testdata_encoding_maps(), E.rejection_rates_from_data(req))
    return S.score_with_centroids(model, feats, CLAIM_CENTROID_FEATURES, K.CLAIM_CLASSES, HASH_FIELDS, version="v1",
                                  clock=F.col("visit_date").cast("timestamp"), required=REQUIRED_FIELDS)


def _m6_baseline(t: Tables):
    from pyspark.sql import functions as F

    return _baseline_responses(t).select(
        "visit_id", "predicted_class", "confidence", F.col("probabilities")[K.REJECTED_CLASS].alias("rejected_probability"),
        F.concat_ws(",", "errors").alias("errors"))


def _a15(t: Tables):
    path = _log_dir(t, "prediction-log")
    L.append_prediction_log(_baseline_responses(t), "claim_centroid", path)
    return L.prediction_log_summary(L.load_prediction_log(t.spark, path))


def _a16(t: Tables):
    path = _log_dir(t, "service-log")
    L.service_log_lines(_baseline_responses(t), "/predict/claim").write.mode("append").text(path)
    return L.prediction_monitoring(L.read_service_log(t.spark, path))


def _w5(t: Tables):
    path = _log_dir(t, "prediction-log")
    L.append_prediction_log(_baseline_responses(t), "claim_centroid", path)
    return L.recent_rows(L.load_prediction_log(t.spark, path), 10).select(
        "timestamp", "model", "visit_id", "predicted_class", "model_version", "total_logged", "returned")


def _t2(t: Tables):
    from wardflow.streaming.scoring_stream import class_mix

    return class_mix(_events(t), "ts", "event_type", "1 day")


#: Most rows of a file of the request feed, and most files of one micro-batch.
FEED_FILE_ROWS, FEED_BATCH_FILES = 100_000, 96


def _t1(t: Tables):
    """The merged rows as a feed of packed JSON files, scored as available-now micro-batches.

    The stream is run twice on one checkpoint, and its last epoch a third time: neither adds a row.
    """
    from wardflow.streaming import scoring_stream as ST

    fields = ST.CLAIM_REQUEST_SCHEMA.fieldNames()
    merged = merged_table(t, list(dict.fromkeys([*fields, "claim_status"])))  # both the feed and the training rows
    model = _claim_centroids(t, merged)
    feed, logs, checkpoint = (new_folder(t.spark, x) for x in ("request-feed", "request-log", "request-checkpoint"))
    n = merged.count()
    rows = max(1, min(FEED_FILE_ROWS, -(-n // 6)))
    merged.select(*fields).write.option("compression", "gzip").option("maxRecordsPerFile", rows).json(feed)
    batch = max(1, min(FEED_BATCH_FILES, -(-n // rows) // 2))

    def scorer(rows: DataFrame) -> DataFrame:
        return M.centroid_predict(rows, model, CLAIM_CENTROID_FEATURES, K.CLAIM_CLASSES).withColumnRenamed(
            "prediction", "predicted_class")

    def run() -> None:
        ST.t1_score_request_stream(
            t.spark, feed, None, K.CLAIM_CLASSES, K.testdata_encoding_maps(), ST.CLAIM_FEED_BOUNDS,
            S.CLAIM_REQUEST_CATEGORIES, logs, checkpoint, "claim_centroid", files_per_batch=batch, scorer=scorer,
        ).awaitTermination()

    run()
    run()
    L.remove_last(t.spark, f"{checkpoint}/commits")  # as if the last epoch had stopped before its commit
    run()
    return ST.stream_summary(t.spark, logs)


def _t2_stream(t: Tables):
    """Events in five files by time, one a micro-batch; every 40th event comes with the last file, late."""
    from pyspark.sql import functions as F

    from wardflow.streaming.scoring_stream import t2_class_mix_stream

    ts = F.col("ts").cast("timestamp")
    events = materialize(_events(t).select("event_id", ts.alias("ts"), "event_type", F.unix_micros(ts).alias("us")))
    feed, out = new_folder(t.spark, "event-feed"), new_folder(t.spark, "event-mix")
    first, last = events.agg(F.min("us"), F.max("us")).first()
    placed = events.withColumn("arrival", F.when(F.col("event_id") % 40 == 0, 4).otherwise(
        F.expr(f"(us - {first or 0}) * 5 div {(last or 0) - (first or 0) + 1}"))).drop("us")
    for k in range(5):
        placed.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.mode("append").parquet(feed)
    stream = t.spark.readStream.schema(placed.drop("arrival").schema).option("maxFilesPerTrigger", 1).parquet(feed)
    t2_class_mix_stream(stream, "ts", "event_type", "1 day", "2 days").writeStream.outputMode("append") \
        .format("parquet").option("path", out).option("checkpointLocation", new_folder(t.spark, "event-checkpoint")) \
        .trigger(availableNow=True).start().awaitTermination()
    mix = t.spark.read.parquet(out)
    return mix.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.startswith("window") else c for c in mix.columns])


def _events(t: Tables) -> DataFrame:
    return t.spark.read.parquet(f"{t.folder}/events.parquet")


def _d5(t: Tables):
    """Drift and macro-F1 rules together; the baseline F1 is that of the training rows."""
    from pyspark.sql import functions as F

    table = _written_model_table(t, *K.DRIFT_FEATURES_N, *_prediction_columns("claim"))
    f1 = V.v4_overfit_gap(*_claim_predictions(t, table), CC).where("metric = 'macro_f1'").select(
        F.col("test").alias("current_macro_f1"), F.col("train").alias("baseline_macro_f1"))
    alert = D.d5_retraining_alert(_d3(t, table), f1, clock=F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return alert.withColumn("reasons", F.transform("reasons", lambda r: r["code"]))


def _q12(t: Tables):
    tr, nw = _train_new(t)
    schema = A.a13_feature_profile(tr, K.MODEL_FEATURES_U)
    return Q.q12_validate_input_schema(nw, schema)


def _q13(t: Tables):
    from pyspark.sql import functions as F

    tr, nw = _train_new(t)
    schema = A.a13_feature_profile(tr, K.MODEL_FEATURES_U)
    v = S.validate_against_schema(nw, schema, K.testdata_encoding_maps())
    return v.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("valid").cast("int")).alias("n_valid"),
                 F.sum(F.size("warnings")).alias("n_warnings"), F.sum(F.size("errors")).alias("n_errors"))


def _s15(t: Tables):
    table = _written_model_table(t, *K.DRIFT_FEATURES_N, "risk_score_encoded")
    return D.s15_drift_summary(_d3(t, table), _d4(t, table), report_date="2026-01-01")


def _v10(t: Tables):
    tr, te = _claim_predictions(t)
    return V.v10_model_card("claim_centroid", V.v1_classification_report(te, CC),
                            V.v3_business_metrics(te, CC, CRIT, amount_col="billed_amount_capped"),
                            V.v5_fairness(te, FAIRNESS_SEGMENTS, CC, CRIT))


for _name, _fn in [
    ("e9_scoring_features", _e9),
    ("q14_request_validation", _q14),
    ("q14_risk_request_validation", _q14_risk),
    ("q15_null_cells_model_table", lambda t: Q.q15_null_cells(_model_table(t))),
    ("t1_scored_request_stream", _t1),
    ("t2_event_mix_daily", _t2),
    ("t2_event_mix_stream", _t2_stream),
    ("d5_retraining_alert", _d5),
    ("q12_validate_input_schema", _q12),
    ("q13_validate_against_schema", _q13),
    ("s15_drift_summary", _s15),
    ("v10_model_card", _v10),
    ("m6_score_test_visits", _m6),
    ("m6_score_baseline", _m6_baseline),
    ("m7_feature_importances", _m7),
    ("m7_permutation_importances", _m7_permuted),
    ("m8_leakage_ablation", _m8),
    ("m9_model_comparison", _m9),
    ("a15_prediction_log_summary", _a15),
    ("a16_prediction_monitoring", _a16),
    ("w5_recent_predictions", _w5),
]:
    register(_name, _fn)


def _e11(t: Tables):
    """SMOTE on the claim training rows: per-class totals after oversampling."""
    from pyspark.sql import functions as F

    from wardflow.operators.smote import smote

    tr, _ = _claim_split(t)
    out = smote(tr, K.MODEL_FEATURES_U, "claim_status", k=5)
    return out.groupBy("claim_status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("synthetic").cast("int")).cast("bigint").alias("n_synthetic"))


def _v8(t: Tables):
    from wardflow.operators import attribution as X

    model, tr, te = _claim_rf(t, keyed=True)
    return X.v8_mean_abs_attribution(
        X.shapley_values(model, te, tr, K.MODEL_FEATURES_U, K.CLAIM_CLASSES, "row_key"))


def _v8_linear(t: Tables):
    """V8 on a score whose Shapley values are known: the sum of the features in standard deviations.

    One row a feature: the mean absolute value, the largest standard error, and the largest gap between the sum
    of a row's values and its score less the base value.
    """
    from pyspark.sql import functions as F

    from wardflow.operators import attribution as X

    feats = CLAIM_CENTROID_FEATURES
    tr, te = E.time_split(materialize(_model_table(t, ["visit_date", *feats]).dropna()), "visit_date", TESTDATA_SPLIT_DATE)
    spread = tr.agg(*[F.stddev_samp(f).alias(f) for f in feats]).first()  # one number a feature
    total = sum((F.col(f) / F.lit(spread[f]) for f in feats), F.lit(0.0))
    rows = te.select(*[F.col(f).cast("double").alias(f) for f in feats]).withColumn("row_key", F.xxhash64(*feats))
    rows = materialize(rows.dropDuplicates(["row_key"]))  # equal rows have one key
    values = materialize(X.shapley_values(
        None, rows, tr, feats, ["score"], "row_key", n_perm=4, score=lambda df: df.withColumn("_prob", F.array(total)),
        max_error=1e-6, max_rounds=2))
    gap = values.groupBy("row_key").agg(F.sum("shap").alias("told"), F.first("base_value").alias("base")).join(
        rows.select("row_key", total.alias("score")), "row_key").agg(
        F.max(F.abs(F.col("told") - (F.col("score") - F.col("base")))).alias("gap"))
    return values.groupBy("feature").agg(
        F.round(F.avg(F.abs("shap")), 6).alias("mean_abs_shap"), F.round(F.max("std_error"), 6).alias("max_error"),
        F.count(F.lit(1)).alias("n_rows")).crossJoin(F.broadcast(gap.select(F.round("gap", 6).alias("additivity_gap"))))


def _v9(t: Tables):
    """Attribution of one row, the one with the smallest key."""
    from pyspark.sql import functions as F

    from wardflow.operators import attribution as X

    model, tr, te = _claim_rf(t, keyed=True)
    first = te.agg(F.min("row_key")).first()[0]
    rows = te.where(F.col("row_key") == F.lit(first)).limit(1)
    s = X.shapley_values(model, rows, tr, K.MODEL_FEATURES_U, K.CLAIM_CLASSES, "row_key")
    return X.v9_explain_row(s, "row_key", first, K.REJECTED_CLASS)


def _d7(t: Tables):
    """The new period's risk labels against a bootstrap of the same labels."""
    from pyspark.sql import functions as F

    risk = materialize(merged_frame(t).where(F.col("visit_date") >= F.lit(TESTDATA_SPLIT_DATE).cast("date")).select(
        F.expr("concat(visit_id, '-', coalesce(cast(bill_id as string), ''))").alias("row_name"),
        map_lookup({c: i for i, c in enumerate(K.RISK_CLASSES)}, F.col("risk_score"), "int").alias("code"),
    ).where("code is not null"))
    return D.d4_prediction_drift(risk, D.d7_bootstrap(risk, "row_name", seed=42), K.RISK_CLASSES, pred_col="code")


for _name, _fn in [("e11_smote_class_counts", _e11), ("v8_attribution_claim", _v8), ("v8_linear_attribution", _v8_linear),
                   ("v9_explain_one_claim", _v9), ("d7_bootstrap_prediction_drift", _d7)]:
    register(_name, _fn)


#: The rejection report over the joined view, by the bill's status share.
FIN02_SQL = """
SELECT insurance_provider, count(*) AS total_claims, count_if(claim_status = 'Rejected') AS rejected,
       count_if(claim_status = 'Paid') AS paid, count_if(claim_status = 'Pending') AS pending,
       round(100 * avg(double(claim_status = 'Rejected')), 2) AS rejection_rate_pct
FROM vw_hospital_master GROUP BY insurance_provider"""


def _csv_tables(t: Tables):
    """S7 then S1: the tables written as header CSV and read back with the declared schemas."""
    from wardflow.sources.tables import read_csv_tables

    paths = [_log_dir(t, name) for name in ("patients-csv", "visits-csv", "billing-csv")]
    for df, path in zip((t.patients, t.visits, t.billing), paths, strict=True):
        L.write_csv(df, path)
    return read_csv_tables(t.spark, *paths)


def _s9(t: Tables):
    """S8 then S9: the feature schema of the training rows as JSON and back."""
    path = _log_dir(t, "feature-schema")
    tr, _ = _train_new(t, K.MODEL_FEATURES_U)
    L.write_json(A.a13_feature_profile(tr, K.MODEL_FEATURES_U), path)
    return L.read_json(t.spark, path, L.FEATURE_SCHEMA_SCHEMA)


def _s13(t: Tables):
    """Audit log: one row a prediction and one drift event, then its summary."""
    path = _log_dir(t, "audit-log")
    L.append_audit_predictions(_baseline_responses(t), "claim_centroid", path)
    L.append_audit_event(t.spark, path, "drift_alert", "feature drift", timestamp="1990-01-01T00:00:00.000000")
    return L.audit_log_summary(L.load_audit_log(t.spark, path))


def _f11(t: Tables):
    """Every category encoded and decoded again, counted by its label."""
    from pyspark.sql import functions as F

    maps = K.testdata_encoding_maps()
    cols = [decode(maps[c], map_lookup(maps[c], F.col(c), "int")).alias(c) for c in K.CATEGORY_FIELDS]
    return A.a1_value_counts(merged_frame(t).select(*cols), K.CATEGORY_FIELDS).select("column_name", "value", "count")


def _e12(t: Tables):
    """Balanced class weights as they stand on the rows."""
    from pyspark.sql import functions as F

    rows = merged_frame(t).where("claim_status is not null").select("claim_status")
    return E.balanced_class_weights(rows, "claim_status").groupBy("claim_status").agg(
        F.min("weight").alias("weight"), F.sum("weight").alias("total_weight"))


def _s5(t: Tables):
    """S2 + S5: register the tables and views, run a report given as SQL text."""
    from wardflow.sources.tables import register_views, run_query

    register_views(t)
    return run_query(t.spark, FIN02_SQL)


def _f18(t: Tables):
    return S.rejection_action_rows(_baseline_responses(t)).groupBy("recommended_action").count()


#: Rounds of the registered boosting run; the operator's default is 100.
BOOSTING_ROUNDS = 4


def _m4(t: Tables):
    """M4 held to its invariants: the loss falls each round, probabilities sum to 1, a saved model predicts the same."""
    from pyspark.sql import functions as F

    from wardflow.operators.boosting import BoostedTrees, fit_boosting

    tr, te = _claim_split(t)
    model = fit_boosting(tr, K.MODEL_FEATURES_U, "claim_status", K.CLAIM_CLASSES, rounds=BOOSTING_ROUNDS)
    path = new_folder(t.spark, "boosted-model")
    model.save(t.spark, path)
    again = BoostedTrees.load(t.spark, path)
    first = model.predict(te.select("claim_status", *K.MODEL_FEATURES_U)).withColumnRenamed("probs", "p1")
    both = again.predict(first.drop("predicted_class", "confidence")).withColumnRenamed("probs", "p2")
    total = F.aggregate("p1", F.lit(0.0), lambda a, x: a + x)
    falls = all(b < a for a, b in zip(model.losses, model.losses[1:], strict=False))
    return both.agg(
        F.lit(len(model.losses) - 1).alias("rounds"), F.lit(falls).alias("loss_falls"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.abs(total - 1) > 1e-9).alias("sums_off"), F.count_if(F.col("p1") != F.col("p2")).alias("reload_differences"))


def _s14(t: Tables):
    """A fitted pipeline saved and loaded; rows that the two predict differently."""
    from pyspark.sql import functions as F

    model, _, te = _claim_rf(t)
    path = new_folder(t.spark, "saved-model")
    M.save_model(model, path)
    first = M.predict(model, te, K.CLAIM_CLASSES).withColumnRenamed("probs", "p1").drop(
        "predicted_class", "confidence", "probabilities")
    both = M.predict(M.load_model(path), first, K.CLAIM_CLASSES)
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("p1") != F.col("probs")).alias("differences"))


def _s6(t: Tables):
    """The catalog's tables and views with the rows of each."""
    from pyspark.sql import functions as F

    from wardflow.sources.tables import list_catalog, register_views

    register_views(t)
    names = ["patients", "visits", "billing", "vw_hospital_master", "vw_visits_patients"]
    counts = None
    for name in names:
        one = t.spark.table(name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return list_catalog(t.spark).join(counts, "name")


def _s16(t: Tables):
    """Every frame of the one-call load with its rows and columns."""
    from pyspark.sql import functions as F

    from wardflow.sources.tables import load_all

    frames = {k: v for k, v in load_all(t.spark, t.folder).items() if k != "tables"}
    rows = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("frame"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _f12(t: Tables):
    """the input hash of every request."""
    req = merged_frame(t)
    return req.select("visit_id", S.input_hash(req, HASH_FIELDS).alias("input_hash"))


def _f14(t: Tables):
    """version and timestamp texts by the day of a visit."""
    from pyspark.sql import functions as F

    return t.visits.groupBy(model_version(clock=F.col("visit_date")).alias("model_version"),
                            iso_timestamp(F.col("visit_date").cast("timestamp")).alias("timestamp")).agg(
        F.count(F.lit(1)).alias("n_visits"))


def _m10(t: Tables):
    model, tr, _ = _claim_rf(t)
    return M.model_metadata(model, "claim_rf", "v1", K.MODEL_FEATURES_U, K.CLAIM_CLASSES, "claim_status", tr)


def _d6(t: Tables):
    from pyspark.sql import functions as F

    table = _written_model_table(t, *K.DRIFT_FEATURES_N, *[c for name in BASELINES for c in _prediction_columns(name)])
    psi = materialize(_d3(t, table).agg(F.max("psi").alias("max_psi")))
    rows = None
    for name in BASELINES:
        recall = F.col("critical_recall") if name == "claim" else F.lit(None).cast("double")
        one = _v3(_predictions(t, name, table=table)[0][1], name).crossJoin(psi).select(
            F.lit(name).alias("model"), "macro_f1", recall.alias("rejected_recall"), "max_psi")
        rows = one if rows is None else rows.unionByName(one)
    return D.d6_retrain_rules(rows)


for _name, _fn in [
    ("s3_hospital_master", lambda t: __import__("wardflow.sources.tables", fromlist=["x"]).hospital_master(t)),
    ("s4_visits_patients", lambda t: __import__("wardflow.sources.tables", fromlist=["x"]).visits_patients(t)),
    ("j2_merged_frame", lambda t: merged_frame(t, HEAVY_ROWS)),
    ("s1_csv_kpi_snapshot", lambda t: R.r11_kpi_snapshot(_csv_tables(t))),
    ("s5_sql_fin02", _s5),
    ("s9_feature_schema_json", _s9),
    ("s13_audit_summary", _s13),
    ("f11_decoded_categories", _f11),
    ("e12_class_weights", _e12),
    ("f18_rejection_actions", _f18),
    ("m10_model_metadata", _m10),
    ("m4_softmax_boosting", _m4),
    ("s14_saved_model", _s14),
    ("s6_catalog", _s6),
    ("s16_load_all", _s16),
    ("f12_input_hashes", _f12),
    ("f14_model_versions", _f14),
    ("d6_retrain_rules", _d6),
]:
    register(_name, _fn)


def queries() -> dict[str, QueryFn]:
    return dict(_REGISTRY)
