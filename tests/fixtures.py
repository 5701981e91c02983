"""Hand-built tables with the edge cases of FIXTURES.md section 4."""

import datetime as dt

from wardflow.sources.tables import BILLING_SCHEMA, PATIENTS_SCHEMA, VISITS_SCHEMA, Tables

D = dt.date


def hand_tables(spark) -> Tables:
    patients = [
        (1, 30, "F", "Pune", "CareOne", 0, D(2024, 1, 1)),
        (2, 70, "M", "Delhi", "HealthPlus", 1, D(2024, 2, 1)),
        (3, 45, "F", "Pune", "", 0, D(2024, 3, 1)),          # blank insurer
        (4, 50, "M", "Mumbai", "CareOne", 1, D(2024, 1, 1)),  # no visits
        (2, 71, "M", "Delhi", "HealthPlus", 1, D(2024, 2, 1)),  # duplicate patient_id
    ]
    visits = [
        (10, 1, D(2025, 1, 6), "ICU", "ER", 10.0, "High", 7),     # Monday
        (11, 1, D(2025, 1, 7), "ICU", "OPD", 20.0, "Low", 7),
        (12, 2, D(2025, 1, 8), "ER", "ER", None, "Medium", 8),
        (13, 3, D(2025, 1, 9), "General", "ICU", 30.0, "High", 9),
        (14, 3, D(2025, 1, 10), "General", "OPD", 0.0, "Low", 9),  # visit without bill
    ]
    billing = [
        (100, 10, 1000.0, 900.0, "Paid", 10.0, D(2025, 1, 6)),
        (101, 11, 5000.0, None, "Pending", None, D(2025, 1, 7)),
        (102, 12, 8000.0, 0.0, "Rejected", 20.0, D(2025, 2, 8)),
        (103, 13, 0.0, None, "Rejected", 5.0, D(2025, 2, 9)),     # zero billed, null approval
        (104, 99, 300.0, 300.0, "Paid", 3.0, D(2025, 3, 1)),      # bill without visit
    ]
    return Tables(
        patients=spark.createDataFrame(patients, PATIENTS_SCHEMA),
        visits=spark.createDataFrame(visits, VISITS_SCHEMA),
        billing=spark.createDataFrame(billing, BILLING_SCHEMA),
    )
