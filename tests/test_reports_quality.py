from fixtures import hand_tables

from wardflow.operators import quality as Q
from wardflow.operators import reports as R
from wardflow.sources.tables import merged_frame


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_r1_volume_share(spark):
    out = rows(R.r1_department_volume(hand_tables(spark)), "department")
    assert out["ICU"]["total_visits"] == 2 and out["ICU"]["pct_of_total"] == 40.0
    assert out["ER"]["pct_of_total"] == 20.0


def test_r2_skips_null_los(spark):
    out = rows(R.r2_department_los(hand_tables(spark)), "department")
    assert "ER" not in out  # its only visit has NULL length of stay
    assert out["General"]["avg_los_hours"] == 15.0 and out["General"]["min_los_hours"] == 0.0


def test_r4_counts_patients_without_visits(spark):
    out = rows(R.r4_city_visits_per_patient(hand_tables(spark)), "city")
    assert out["Mumbai"]["total_patients"] == 1 and out["Mumbai"]["total_visits"] == 0
    # duplicate patient 2 doubles its visit count, as the SQL join does
    assert out["Delhi"]["total_visits"] == 2 and out["Delhi"]["total_patients"] == 1


def test_r6_r7_pre_aggregation_matches_join(spark):
    t = hand_tables(spark)
    r6 = rows(R.r6_insurer_billed(t), "insurance_provider")
    # CareOne: patient 1, bills 100 and 101
    assert r6["CareOne"]["total_claims"] == 2 and r6["CareOne"]["total_billed"] == 6000.0
    # HealthPlus: patient 2 is duplicated -> its bill counted twice, one distinct patient
    assert r6["HealthPlus"]["total_claims"] == 2 and r6["HealthPlus"]["total_patients"] == 1
    r7 = rows(R.r7_insurer_rejection(t), "insurance_provider")
    assert r7["HealthPlus"]["rejection_rate_pct"] == 100.0 and r7["CareOne"]["pending"] == 1


def test_r9_nullif_guard(spark):
    out = rows(R.r9_department_realization(hand_tables(spark)), "department")
    assert out["ICU"]["realization_ratio"] == 0.9
    assert out["ER"]["realization_ratio"] == 0.0 and out["ER"]["leakage_pct"] == 100.0


def test_r11_kpi_row(spark):
    k = R.r11_kpi_snapshot(hand_tables(spark)).first()
    assert (k.total_patients, k.total_visits, k.total_bills) == (5, 5, 5)
    assert k.rejection_rate_pct == 40.0 and k.high_risk_visit_pct == 40.0


def test_q1_q2_q3_q5(spark):
    t = hand_tables(spark)
    assert Q.q1_visits_without_billing(t).first()[0] == 1
    assert Q.q2_orphan_billing(t).first()[0] == 1
    assert [r.patient_id for r in Q.q3_duplicate_patient_ids(t).collect()] == [2]
    assert Q.q5_missing_insurance(t).first()[0] == 2


def test_q9_constraints(spark):
    t = hand_tables(spark)
    maps = {"department": {"ICU": 0, "ER": 1, "General": 2}, "visit_type": {"ER": 0, "ICU": 1, "OPD": 2},
            "risk_score": {"High": 0, "Low": 1, "Medium": 2},
            "claim_status": {"Paid": 0, "Pending": 1, "Rejected": 2}}
    out = {(r.table_name, r.constraint_name): r.violations for r in Q.q9_constraint_check(t, maps).collect()}
    assert out[("patients", "pk_patient_id")] == 1
    assert out[("billing", "fk_visit_id")] == 1
    assert out[("visits", "check_length_of_stay_hours")] == 0  # NULL passes a CHECK


def test_q6_missing_summary(spark):
    m = merged_frame(hand_tables(spark))
    out = rows(Q.q6_missing_value_summary(m), "column_name")
    assert out["approved_amount"]["dtype"] == "double"
    assert "age" not in out


def test_q10_q11_status(spark):
    m = merged_frame(hand_tables(spark))
    st = Q.q11_quality_status(m).first()
    assert st.status == "WARNING"  # NULLs present, no range violation
