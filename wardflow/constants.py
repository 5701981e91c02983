"""Fixed values that must equal the original workload's for equal results.

Everything in the block below is stated as plain data, in natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original workload)
# ---------------------------------------------------------------------------

# Category -> code maps for the hospital data set (variant U encoding).
HOSPITAL_ENCODING_MAPS = {
    "department": {
        "Cardiology": 0,
        "ER": 1,
        "General": 2,
        "ICU": 3,
        "Neurology": 4,
        "Orthopedics": 5,
    },
    "visit_type": {"ER": 0, "ICU": 1, "OPD": 2},
    "gender": {"F": 0, "M": 1},
    "city": {
        "Bangalore": 0,
        "Chennai": 1,
        "Delhi": 2,
        "Hyderabad": 3,
        "Mumbai": 4,
        "Pune": 5,
    },
    "insurance_provider": {
        "CareOne": 0,
        "HealthPlus": 1,
        "MediCareX": 2,
        "SecureLife": 3,
    },
    "risk_score": {"High": 0, "Low": 1, "Medium": 2},
    "claim_status": {"Paid": 0, "Pending": 1, "Rejected": 2},
}

# Historical rejection rate per insurer; unknown insurer -> mean of these.
HOSPITAL_PROVIDER_REJECTION_RATES = {
    "CareOne": 0.148655,
    "HealthPlus": 0.149678,
    "MediCareX": 0.152480,
    "SecureLife": 0.156915,
}

# Class lists in code order.
RISK_CLASSES = ["High", "Low", "Medium"]
CLAIM_CLASSES = ["Paid", "Pending", "Rejected"]
HIGH_RISK_CLASS = "High"
REJECTED_CLASS = "Rejected"
# The drift notebook orders risk classes differently.
RISK_CLASSES_DRIFT_ORDER = ["Low", "Medium", "High"]

# Date cut of the time split (variant U).
SPLIT_DATE = "2025-11-08"

# PSI thresholds.
PSI_NO_CHANGE = 0.10
PSI_SIGNIFICANT = 0.25
PSI_SMOOTHING = 0.0001

# Retraining and alert rules.
PREDICTION_SHIFT_ALERT_PCT = 5.0
SEVERE_DRIFT_FEATURES_FOR_RETRAIN = 3
MACRO_F1_DROP_THRESHOLD = 0.05
RISK_MODEL_MIN_MACRO_F1 = 0.28
CLAIM_MODEL_MIN_REJECTED_RECALL = 0.85
HIGH_RISK_RECALL_TARGET = 0.70
REJECTED_RECALL_TARGET = 0.60
OVERFIT_GAP_FLAG = 0.20
SEGMENT_GAP_FLAG = -0.05
FAIRNESS_BANDS = (0.65, 0.75)

# Scoring-time (frozen) feature defaults.
SCORING_VISIT_FREQUENCY = 5
SCORING_AVG_LOS = 19.55
SCORING_DEFAULT_REJECTION_RATE = 0.152
SCORING_BILLED_CAP = 53621.49
SCORING_PAYMENT_DAYS_CAP = 30.5
SCORING_LOS_CAP = 53.34

# Validation ranges of the monitoring notebook.
MONITOR_NUMERIC_RANGES = {
    "age": (0, 120),
    "visit_month": (1, 12),
    "visit_dayofweek": (0, 6),
    "chronic_flag": (0, 1),
    "approval_ratio": (0, 1),
    "length_of_stay_hours": (0, 500),
    "payment_days": (0, 365),
}

# Rejection-risk bands (percent) -> action text.
REJECTION_RISK_BANDS = [
    (70, "HIGH REJECTION RISK — review and correct before submission"),
    (40, "MODERATE REJECTION RISK — verify supporting documentation"),
    (0, "LOW REJECTION RISK — proceed with standard submission"),
]

# Feature lists of variant U (same for both models).
MODEL_FEATURES_U = [
    "age", "chronic_flag", "los_capped", "visit_frequency",
    "avg_los_per_patient", "days_since_registration",
    "billed_amount_capped", "approval_ratio", "provider_rejection_rate",
    "payment_days_capped", "visit_month", "visit_dayofweek", "visit_quarter",
    "department_encoded", "visit_type_encoded", "gender_encoded",
    "city_encoded", "insurance_provider_encoded",
]

# Feature lists of variant N.
RISK_FEATURES_N = [
    "age", "chronic_flag", "length_of_stay_hours", "patient_visit_frequency",
    "avg_los_per_patient", "days_since_registration", "visit_month",
    "visit_day_of_week", "department_enc", "visit_type_enc", "gender_enc",
    "city_enc",
]
CLAIM_FEATURES_N = [
    "billed_amount", "approved_amount", "approval_ratio", "length_of_stay_hours",
    "age", "chronic_flag", "patient_visit_frequency", "days_since_registration",
    "visit_month", "department_enc", "visit_type_enc", "insurance_provider_enc",
    "gender_enc",
]

# Columns of the 30-column model table (variant U).
MODEL_TABLE_COLUMNS = [
    "visit_id", "patient_id", "visit_date",
    "age", "chronic_flag", "los_capped", "visit_frequency",
    "avg_los_per_patient", "days_since_registration",
    "billed_amount_capped", "approval_ratio",
    "provider_rejection_rate", "payment_days_capped",
    "visit_month", "visit_dayofweek", "visit_quarter",
    "department", "visit_type", "gender", "city", "insurance_provider",
    "department_encoded", "visit_type_encoded", "gender_encoded",
    "city_encoded", "insurance_provider_encoded",
    "risk_score", "risk_score_encoded",
    "claim_status", "claim_status_encoded",
]

# Numeric features checked by the drift notebook.
DRIFT_FEATURES_N = [
    "age", "los_capped", "visit_frequency", "avg_los_per_patient",
    "days_since_registration", "billed_amount_capped", "approval_ratio",
    "payment_days_capped",
]

CATEGORY_FIELDS = ["department", "visit_type", "gender", "city", "insurance_provider"]

# ---------------------------------------------------------------------------
# Derived values (computed, not fixed)
# ---------------------------------------------------------------------------

HOSPITAL_DEFAULT_REJECTION_RATE = round(
    sum(HOSPITAL_PROVIDER_REJECTION_RATES.values()) / len(HOSPITAL_PROVIDER_REJECTION_RATES), 6
)


def _alphabetic_codes(values: list[str]) -> dict[str, int]:
    return {v: i for i, v in enumerate(sorted(values))}


def testdata_encoding_maps(n_nations: int = 25) -> dict[str, dict[str, int]]:
    """Encoding maps for the TPC-H-shaped test tables (built by rule).

    The adapter maps nation -> city, market segment -> insurer and order
    priority -> department, so those domains differ from the hospital data
    set; codes are assigned alphabetically like the hospital maps.
    """
    return {
        "department": _alphabetic_codes(
            ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
        ),
        "visit_type": dict(HOSPITAL_ENCODING_MAPS["visit_type"]),
        "gender": dict(HOSPITAL_ENCODING_MAPS["gender"]),
        "city": _alphabetic_codes([f"NATION_{i}" for i in range(n_nations)]),
        "insurance_provider": _alphabetic_codes(
            ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
        ),
        "risk_score": dict(HOSPITAL_ENCODING_MAPS["risk_score"]),
        "claim_status": dict(HOSPITAL_ENCODING_MAPS["claim_status"]),
    }
