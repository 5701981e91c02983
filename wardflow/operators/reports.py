"""Operational and financial reports.

Scale notes
-----------
* The financial reports (R6-R9) aggregate billing to one row per visit
  *before* the joins (eager aggregation).  Bills shuffle once on visit_id;
  the per-visit result keeps that hash partitioning, so the join with
  visits adds no second exchange on the billing side, and the later join on
  patient_id moves one row per patient instead of one row per bill.
  Catalyst does not push aggregates below joins on its own.
* Low-cardinality group keys (insurer, department, city) are handled by the
  partial (map-side) hash aggregate, so a key holding a third of all rows
  never reaches one reducer as raw rows.
* Hot patients / visits in joins are split by AQE skew-join handling.
* Scalar subqueries become 1-row aggregates cross-joined back (a broadcast
  of a proven single row).
* Top-k reports end in ``orderBy(...).limit(k)`` which plans as
  TakeOrderedAndProject (per-partition top-k, no global sort); the group
  key is the last sort key so ties are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.functions.scalar import flag_sum, pct, ratio
from wardflow.sources.tables import Tables


def _one_row(df: DataFrame) -> DataFrame:
    """Mark a 1-row aggregate for broadcast (its size is bounded by construction)."""
    return F.broadcast(df)


# ----------------------------------------------------------------- operational
def r1_department_volume(t: Tables, k: int = 10) -> DataFrame:
    """OPS-01: visits per department with share of all visits, top k."""
    total = _one_row(t.visits.agg(F.count(F.lit(1)).alias("_n_all")))
    return (
        t.visits.groupBy("department")
        .agg(F.count("visit_id").alias("total_visits"))
        .crossJoin(total)
        .select("department", "total_visits", pct(F.col("total_visits"), F.col("_n_all")).alias("pct_of_total"))
        .orderBy(F.desc("total_visits"), F.asc_nulls_last("department"))
        .limit(k)
    )


def r2_department_los(t: Tables, k: int = 5) -> DataFrame:
    """OPS-02: length-of-stay statistics per department, top k by mean."""
    los = F.col("length_of_stay_hours")
    return (
        t.visits.where(los.isNotNull())
        .groupBy("department")
        .agg(
            F.count("visit_id").alias("total_visits"),
            F.round(F.avg(los), 2).alias("avg_los_hours"),
            F.round(F.min(los), 2).alias("min_los_hours"),
            F.round(F.max(los), 2).alias("max_los_hours"),
        )
        .orderBy(F.desc("avg_los_hours"), F.asc_nulls_last("department"))
        .limit(k)
    )


def r3_department_risk_mix(t: Tables) -> DataFrame:
    """OPS-03: High / Medium / Low counts and High share per department."""
    risk = F.col("risk_score")
    return (
        t.visits.groupBy("department")
        .agg(
            F.count("visit_id").alias("total_visits"),
            flag_sum(risk == "High").alias("high_risk"),
            flag_sum(risk == "Medium").alias("medium_risk"),
            flag_sum(risk == "Low").alias("low_risk"),
        )
        .withColumn("high_risk_pct", pct(F.col("high_risk"), F.col("total_visits")))
        .orderBy(F.desc("high_risk_pct"), F.asc_nulls_last("department"))
    )


def r4_city_visits_per_patient(t: Tables) -> DataFrame:
    """OPS-04: per city, patients and visits per patient (zero-visit patients count).

    Visits are counted per patient first (partial aggregate, one shuffle),
    then left-joined to patients 1:1, instead of joining every visit row.
    """
    per_patient = t.visits.groupBy("patient_id").agg(F.count("visit_id").alias("_n"))
    pvc = (
        t.patients.select("city", "patient_id")
        .join(per_patient, "patient_id", "left")
        .groupBy("city", "patient_id")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("visit_count"))
    )
    return (
        pvc.groupBy("city")
        .agg(
            F.count("patient_id").alias("total_patients"),
            F.sum("visit_count").cast("bigint").alias("total_visits"),
            F.round(F.avg("visit_count"), 2).alias("avg_visits_per_patient"),
            F.max("visit_count").alias("max_visits_single_patient"),
        )
        .orderBy(F.desc("avg_visits_per_patient"), F.asc_nulls_last("city"))
    )


def r5_top_doctors_high_risk(t: Tables, k: int = 10) -> DataFrame:
    """OPS-05: doctors with the most High risk visits."""
    high = F.col("risk_score") == "High"
    return (
        t.visits.groupBy("doctor_id")
        .agg(
            F.count("visit_id").alias("total_visits"),
            flag_sum(high).alias("high_risk_visits"),
            F.count_distinct("department").alias("depts_covered"),
        )
        .withColumn("high_risk_pct", pct(F.col("high_risk_visits"), F.col("total_visits")))
        .select("doctor_id", "total_visits", "high_risk_visits", "high_risk_pct", "depts_covered")
        .orderBy(F.desc("high_risk_visits"), F.asc_nulls_last("doctor_id"))
        .limit(k)
    )


# ------------------------------------------------------------------- financial
def _bill_facts_per_visit(billing: DataFrame) -> DataFrame:
    """Every per-bill aggregate the insurer reports need, at visit grain.

    Unused aggregate columns are pruned by Catalyst per report.
    """
    status, pd_ = F.col("claim_status"), F.col("payment_days")
    return billing.groupBy("visit_id").agg(
        F.count("bill_id").alias("n_claims"),
        F.sum("billed_amount").alias("s_billed"),
        F.count("billed_amount").alias("n_billed"),
        flag_sum(status == "Rejected").alias("n_rejected"),
        flag_sum(status == "Paid").alias("n_paid"),
        flag_sum(status == "Pending").alias("n_pending"),
        flag_sum(pd_.isNull()).alias("n_unpaid"),
        F.sum(pd_).alias("s_pd"),
        F.count(pd_).alias("n_pd"),
        F.min(pd_).alias("min_pd"),
        F.max(pd_).alias("max_pd"),
    )


def _bill_facts_per_insurer_patient(t: Tables) -> DataFrame:
    """Bill facts rolled up to (insurance_provider, patient_id) through both joins."""
    per_visit = _bill_facts_per_visit(t.billing)
    per_patient = (
        per_visit.join(t.visits.select("visit_id", "patient_id"), "visit_id", "inner")
        .groupBy("patient_id")
        .agg(
            F.sum("n_claims").alias("n_claims"),
            F.sum("s_billed").alias("s_billed"),
            F.sum("n_billed").alias("n_billed"),
            F.sum("n_rejected").alias("n_rejected"),
            F.sum("n_paid").alias("n_paid"),
            F.sum("n_pending").alias("n_pending"),
            F.sum("n_unpaid").alias("n_unpaid"),
            F.sum("s_pd").alias("s_pd"),
            F.sum("n_pd").alias("n_pd"),
            F.min("min_pd").alias("min_pd"),
            F.max("max_pd").alias("max_pd"),
        )
    )
    return per_patient.join(
        t.patients.select("patient_id", "insurance_provider"), "patient_id", "inner"
    )


def r6_insurer_billed(t: Tables) -> DataFrame:
    """FIN-01: patients, claims, total and mean billed per insurer."""
    f = _bill_facts_per_insurer_patient(t)
    return (
        f.groupBy("insurance_provider")
        .agg(
            F.count_distinct("patient_id").alias("total_patients"),
            F.sum("n_claims").cast("bigint").alias("total_claims"),
            F.round(F.sum("s_billed"), 2).alias("total_billed"),
            F.round(ratio(F.sum("s_billed"), F.sum("n_billed")), 2).alias("avg_billed_per_claim"),
        )
        .orderBy(F.desc("total_billed"), F.asc_nulls_last("insurance_provider"))
    )


def r7_insurer_rejection(t: Tables) -> DataFrame:
    """FIN-02: claim status counts and rejection rate per insurer."""
    f = _bill_facts_per_insurer_patient(t)
    return (
        f.groupBy("insurance_provider")
        .agg(
            F.sum("n_claims").cast("bigint").alias("total_claims"),
            F.sum("n_rejected").cast("bigint").alias("rejected"),
            F.sum("n_paid").cast("bigint").alias("paid"),
            F.sum("n_pending").cast("bigint").alias("pending"),
        )
        .withColumn("rejection_rate_pct", pct(F.col("rejected"), F.col("total_claims")))
        .orderBy(F.desc("rejection_rate_pct"), F.asc_nulls_last("insurance_provider"))
    )


def r8_insurer_payment_delay(t: Tables) -> DataFrame:
    """FIN-03: unpaid count and payment-day statistics per insurer (NULLs skipped)."""
    f = _bill_facts_per_insurer_patient(t)
    return (
        f.groupBy("insurance_provider")
        .agg(
            F.sum("n_claims").cast("bigint").alias("total_claims"),
            F.sum("n_unpaid").cast("bigint").alias("claims_unpaid"),
            F.round(ratio(F.sum("s_pd"), F.sum("n_pd")), 2).alias("avg_payment_days"),
            F.round(F.min("min_pd"), 2).alias("min_payment_days"),
            F.round(F.max("max_pd"), 2).alias("max_payment_days"),
        )
        .orderBy(F.desc_nulls_last("avg_payment_days"), F.asc_nulls_last("insurance_provider"))
    )


def r9_department_realization(t: Tables) -> DataFrame:
    """FIN-04: approved / billed per department over bills with an approval."""
    per_visit = (
        t.billing.where(F.col("approved_amount").isNotNull())
        .groupBy("visit_id")
        .agg(
            F.count("bill_id").alias("n_claims"),
            F.sum("billed_amount").alias("s_billed"),
            F.sum("approved_amount").alias("s_appr"),
        )
    )
    agg = (
        per_visit.join(t.visits.select("visit_id", "department"), "visit_id", "inner")
        .groupBy("department")
        .agg(
            F.sum("n_claims").cast("bigint").alias("total_claims"),
            F.sum("s_billed").alias("_billed"),
            F.sum("s_appr").alias("_appr"),
        )
    )
    r = ratio(F.col("_appr"), F.col("_billed"))
    return (
        agg.select(
            "department",
            "total_claims",
            F.round("_billed", 2).alias("total_billed"),
            F.round("_appr", 2).alias("total_approved"),
            F.round(r, 4).alias("realization_ratio"),
            F.round((F.lit(1.0) - r) * F.lit(100.0), 2).alias("leakage_pct"),
        )
        .orderBy(F.asc_nulls_last("realization_ratio"), F.asc_nulls_last("department"))
    )


def r10_high_bills_without_approval(t: Tables, k: int = 15) -> DataFrame:
    """FIN-05: above-average bills with zero or NULL approval, top k by amount.

    The selective bill filter runs before both joins.
    """
    avg_bill = _one_row(t.billing.agg(F.avg("billed_amount").alias("_avg_billed")))
    appr = F.col("approved_amount")
    bills = (
        t.billing.crossJoin(avg_bill)
        .where((F.col("billed_amount") > F.col("_avg_billed")) & (appr.isNull() | (appr == 0)))
        .select("visit_id", "billed_amount", "approved_amount", "claim_status", "billing_date")
    )
    rows = (
        bills.join(t.visits.select("visit_id", "patient_id", "department", "visit_type", "risk_score"),
                   "visit_id", "inner")
        .join(t.patients.select("patient_id", "insurance_provider"), "patient_id", "inner")
    )
    return (
        rows.select(
            "visit_id", "department", "visit_type", "risk_score", "insurance_provider",
            F.round("billed_amount", 2).alias("billed_amount"),
            "approved_amount", "claim_status", "billing_date",
        )
        .orderBy(
            F.desc("billed_amount"), F.asc("visit_id"), F.asc_nulls_last("approved_amount"),
            F.asc_nulls_last("claim_status"), F.asc_nulls_last("billing_date"),
            F.asc_nulls_last("insurance_provider"),
        )
        .limit(k)
    )


def r11_kpi_snapshot(t: Tables) -> DataFrame:
    """Dashboard: nine KPIs in one row, one aggregate per table."""
    appr_known = F.col("approved_amount").isNotNull()
    p = t.patients.agg(F.count(F.lit(1)).alias("total_patients"))
    v = t.visits.agg(
        F.count(F.lit(1)).alias("total_visits"),
        F.round(F.avg("length_of_stay_hours"), 2).alias("avg_los_hours"),
        F.round(
            F.try_divide(flag_sum(F.col("risk_score") == "High").cast("double"), F.count(F.lit(1)))
            * F.lit(100.0), 2).alias("high_risk_visit_pct"),
    )
    b = t.billing.agg(
        F.count(F.lit(1)).alias("total_bills"),
        F.round(F.sum("billed_amount"), 2).alias("total_billed"),
        F.round(F.sum(F.when(appr_known, F.col("approved_amount"))), 2).alias("total_approved"),
        F.round(
            ratio(F.sum(F.when(appr_known, F.col("approved_amount"))),
                  F.sum(F.when(appr_known, F.col("billed_amount")))), 4).alias("realization_ratio"),
        F.round(
            F.try_divide(flag_sum(F.col("claim_status") == "Rejected").cast("double"), F.count(F.lit(1)))
            * F.lit(100.0), 2).alias("rejection_rate_pct"),
    )
    return p.crossJoin(v).crossJoin(b).select(
        "total_patients", "total_visits", "total_bills", "total_billed", "total_approved",
        "realization_ratio", "rejection_rate_pct", "avg_los_hours", "high_risk_visit_pct",
    )
