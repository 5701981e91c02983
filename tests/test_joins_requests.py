"""Joins with a hot key, requests that cannot be scored, and tables that are folders of part files."""

import os
from statistics import median

from pyspark.sql import functions as F

from wardflow.operators import scoring as S
from wardflow.plans import catalog
from wardflow.sources import logs as L
from wardflow.sources.tables import from_testdata, merged_frame, split_left_join


def test_split_left_join_equals_the_plain_join(spark):
    left = spark.createDataFrame([(k, f"v{i}") for i, k in enumerate([1, 1, 2, 3, 4, None, 7])], "k long, a string")
    right = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 1), (2, 1), (9, 5), (None, 3), (3, None)]
                                  + [(7, i) for i in range(25)], "k long, b long")
    want = sorted(map(tuple, left.join(right, "k", "left").collect()), key=str)
    for heavy in (1, 10, 30, 1000):
        assert sorted(map(tuple, split_left_join(left, right, "k", heavy).collect()), key=str) == want
    assert split_left_join(left.limit(0), right, "k", 10).count() == 0
    assert split_left_join(left, right.limit(0), "k", 10).count() == 7


def test_a_third_of_all_bills_on_one_visit_is_dealt_over_tasks(spark):
    visits = spark.range(10_000).select(F.col("id").alias("k"), F.lit("v").alias("a"))
    bills = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id") % 10_000).alias("k"),
                                       F.col("id").alias("b"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = split_left_join(visits, bills, "k", 20).withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in out.groupBy("task").count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    unmatched = 10_000 - len({i % 10_000 for i in range(30_000) if i % 3} | {77})
    assert sum(tasks) == 30_000 + unmatched
    assert max(tasks) <= 2 * median(tasks)


def test_requests_without_amounts_are_answered_and_counted(spark, scratch):
    t = from_testdata(spark, "/root/testdata/sf0.001")
    n = merged_frame(t).count()
    missing = merged_frame(t).where("billed_amount is null or length_of_stay_hours is null").count()
    rows = catalog._baseline_responses(t).cache()
    assert rows.count() == n and missing > 0
    bad = rows.where("predicted_class is null")
    assert bad.count() == missing == rows.where(F.size("errors") > 0).count()
    assert {tuple(r.errors) for r in bad.collect()} == {("missing_billed_amount",)}
    assert bad.where("confidence is not null or probabilities is not null or input_hash is null").count() == 0
    path = os.path.join(scratch, "log")
    L.append_prediction_log(rows, "m", path)
    summary = {(r.kind, r.key): r.n for r in L.prediction_log_summary(L.load_prediction_log(spark, path)).collect()}
    assert summary["by_model", "m"] == n and summary["by_prediction", L.REJECTED] == missing
    L.append_audit_predictions(rows, "m", os.path.join(scratch, "audit"))
    audit = {(r.kind, r.key): r.n for r in L.audit_log_summary(L.load_audit_log(spark, os.path.join(scratch, "audit"))).collect()}
    assert audit["by_event_type", "prediction"] == n - missing and audit["by_event_type", "rejected_request"] == missing
    L.service_log_lines(rows, "/predict/claim").write.text(os.path.join(scratch, "svc"))
    mon = L.prediction_monitoring(L.read_service_log(spark, os.path.join(scratch, "svc"))).first()
    assert (mon.total_predictions, mon.rejected_requests) == (n - missing, missing)
    actions = {r.recommended_action: r["count"] for r in S.rejection_action_rows(rows).groupBy("recommended_action").count().collect()}
    assert actions[None] == missing and sum(actions.values()) == n
    rows.unpersist()


def test_tables_that_are_folders_of_part_files(spark, scratch):
    for name in ("customer", "nation", "orders", "lineitem", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{scratch}/{name}.parquet")
    queries = catalog.queries()
    for name in ("t2_event_mix_daily", "r7_insurer_rejection"):
        want = sorted(map(str, queries[name](spark, "/root/testdata/sf0.001").collect()))
        assert sorted(map(str, queries[name](spark, scratch).collect())) == want


