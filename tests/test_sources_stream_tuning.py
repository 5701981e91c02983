import json
import os

from fixtures import hand_tables
import pytest
from pyspark.sql import functions as F

from wardflow import constants as K
from wardflow.operators import models as M
from wardflow.operators import scoring as S
from wardflow.sources import logs as L
from wardflow.sources import tables as TB
from wardflow.streaming.scoring_stream import CLAIM_FEED_BOUNDS, CLAIM_REQUEST_SCHEMA, t1_score_request_stream


def test_csv_scan_nulls_not_nan_and_views(spark, scratch):
    t = hand_tables(spark)
    paths = []
    for name, df in [("patients", t.patients), ("visits", t.visits), ("billing", t.billing)]:
        p = os.path.join(scratch, name)
        L.write_csv(df, p)
        paths.append(p)
    loaded = TB.load_all(spark, csv_paths=tuple(paths))
    b = loaded["billing"]
    assert b.where(F.col("approved_amount").isNull()).count() == 2
    assert b.where(F.isnan("approved_amount")).count() == 0
    names = {r.name for r in TB.list_catalog(spark).collect()}
    assert {"patients", "visits", "billing", "vw_hospital_master", "vw_visits_patients"} <= names
    assert TB.run_query(spark, "SELECT COUNT(*) FROM vw_hospital_master").first()[0] == 5  # duplicate patient doubles a visit
    assert loaded["merged"].count() == 6


def test_json_sink_and_source(spark, scratch):
    prof = spark.createDataFrame([("age", "int", 1.0, 9.0, 5.0, 2.0, 0)],
                                 "feature string, dtype string, min double, max double, mean double, std double, "
                                 "nulls long")
    p = os.path.join(scratch, "schema")
    L.write_json(prof, p)
    back = L.read_json(spark, p, L.FEATURE_SCHEMA_SCHEMA)
    assert back.first().max == 9.0
    try:
        L.read_json(spark, os.path.join(scratch, "absent"), L.FEATURE_SCHEMA_SCHEMA)
        raise AssertionError("missing schema file must fail")
    except FileNotFoundError:
        pass


def _claims(spark, n=240):
    rows = []
    for i in range(n):
        status = ["Paid", "Pending", "Rejected"][i % 3]
        approved = {"Paid": 900.0, "Pending": None, "Rejected": 0.0}[status]
        rows.append((i, 1, "2025-12-01", "2025-01-01", 40, i % 2, "ICU", "ER", "M", "Pune", "CareOne",
                     float(i % 30), 1000.0 + i, approved, None if status == "Pending" else 10.0, status))
    return spark.createDataFrame(rows, CLAIM_REQUEST_SCHEMA.simpleString()[:-1] + ",claim_status:string>")


def test_gbt_one_vs_rest_and_tuning(spark):
    df = S.scoring_features(_claims(spark), K.HOSPITAL_ENCODING_MAPS, K.HOSPITAL_PROVIDER_REJECTION_RATES)
    feats = ["approval_ratio", "billed_amount_capped", "los_capped", "payment_days_capped"]
    gbt = M.train_model(df, feats, "claim_status", K.CLAIM_CLASSES, "gradient_boosting", n_estimators=5, max_depth=2)
    pred = M.predict(gbt, df, K.CLAIM_CLASSES)
    acc = pred.agg(F.avg((F.col("claim_status") == F.col("predicted_class")).cast("double"))).first()[0]
    assert acc > 0.9
    cv = M.tune_model(df, feats, "claim_status", K.CLAIM_CLASSES, grid={"numTrees": [3, 5], "maxDepth": [2]},
                      folds=3, parallelism=1)
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > 0.9


def test_t1_request_stream(spark, scratch):
    df = _claims(spark, 60)
    feats = ["approval_ratio", "billed_amount_capped", "los_capped", "payment_days_capped"]
    model = M.train_model(S.scoring_features(df, K.HOSPITAL_ENCODING_MAPS), feats, "claim_status",
                          K.CLAIM_CLASSES, "random_forest", n_estimators=5, max_depth=3)
    inbox = os.path.join(scratch, "inbox")
    os.makedirs(inbox)
    reqs = [r.asDict() for r in df.drop("claim_status").collect()]
    reqs[0]["department"] = "Space"  # unseen category -> quarantine
    with open(os.path.join(inbox, "batch1.json"), "w") as fh:
        for r in reqs:
            fh.write(json.dumps(r) + "\n")
    q = t1_score_request_stream(spark, inbox, model, K.CLAIM_CLASSES, K.HOSPITAL_ENCODING_MAPS,
                                CLAIM_FEED_BOUNDS, ["department", "visit_type", "gender", "insurance_provider"],
                                os.path.join(scratch, "log"), os.path.join(scratch, "ck"), "claim", "v1")
    q.awaitTermination(180)
    scored = spark.read.json(os.path.join(scratch, "log", "predictions"))
    quarantine = spark.read.json(os.path.join(scratch, "log", "quarantine"))
    # approval_ratio / patient fields absent from raw requests are derived; range rules still apply
    assert scored.count() + quarantine.count() == 60
    assert quarantine.where(F.array_contains("errors", "department: not allowed value Space")).count() == 1
    assert scored.select("visit_id").distinct().count() == scored.count() and "epoch" in scored.columns
    batch = S.scoring_features(spark.read.schema(CLAIM_REQUEST_SCHEMA).json(inbox), K.HOSPITAL_ENCODING_MAPS)
    hashes = batch.select(S.input_hash(batch, CLAIM_REQUEST_SCHEMA.fieldNames()).alias("input_hash"))
    assert scored.join(hashes, "input_hash", "left_anti").count() == 0  # the batch hash of the same request
    with pytest.raises(ValueError):
        t1_score_request_stream(spark, inbox, model, K.CLAIM_CLASSES, K.HOSPITAL_ENCODING_MAPS,
                                S.CLAIM_REQUEST_BOUNDS, [], os.path.join(scratch, "l2"), os.path.join(scratch, "c2"))


def test_cuts_are_deleted_with_their_block(spark):
    from wardflow import session

    with session.cuts(spark):
        kept = session.write_table(spark.range(5))
        folder = session._written[-1]
        with session.cuts(spark):
            assert session.write_table(spark.range(3)).count() == 3
        assert kept.count() == 5
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_packed_feed_and_logs(spark, scratch):
    """A gzip-packed feed is read, and the logs of the stream are packed too."""
    from wardflow.streaming.scoring_stream import stream_summary

    feed, log = os.path.join(scratch, "feed"), os.path.join(scratch, "log")
    df = _claims(spark, 40).drop("claim_status")
    df.coalesce(1).write.option("compression", "gzip").option("maxRecordsPerFile", 10).json(feed)
    t1_score_request_stream(
        spark, feed, None, K.CLAIM_CLASSES, K.HOSPITAL_ENCODING_MAPS, CLAIM_FEED_BOUNDS, [], log, os.path.join(scratch, "ck"),
        files_per_batch=2, scorer=lambda rows: rows.withColumn("predicted_class", F.lit("Paid")).withColumn(
            "confidence", F.lit(1.0))).awaitTermination(180)
    for kind in ("predictions", "quarantine"):
        assert sorted(os.listdir(f"{log}/{kind}")) == ["epoch=0", "epoch=1"]
        parts = [f for _, _, names in os.walk(f"{log}/{kind}") for f in names if f.startswith("part-")]
        assert parts and all(f.endswith(".json.gz") for f in parts)
    rows = stream_summary(spark, log).where("outcome != 'error'").collect()
    assert sum(r.n for r in rows) == 40
