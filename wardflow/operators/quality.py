"""Data quality and constraint checks.

Every check is one scan with all counters in a single aggregate, then an
``unpivot`` to long form; key checks are ``groupBy`` (partial aggregation)
and referential checks are ``left_anti`` joins, so nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow import constants as K
from wardflow.functions.scalar import count_if, flag_sum, is_blank, map_lookup, pct, year_month
from wardflow.sources.tables import Tables


# ------------------------------------------------------------------ Q1 - Q5
def q1_visits_without_billing(t: Tables) -> DataFrame:
    """DQ-01: visits with no bill (anti join)."""
    return (
        t.visits.select("visit_id")
        .join(t.billing.select("visit_id"), "visit_id", "left_anti")
        .agg(F.count(F.lit(1)).alias("visits_without_billing"))
    )


def q2_orphan_billing(t: Tables) -> DataFrame:
    """DQ-02: bills whose visit does not exist (anti join)."""
    return (
        t.billing.select("visit_id")
        .join(t.visits.select("visit_id"), "visit_id", "left_anti")
        .agg(F.count(F.lit(1)).alias("orphan_billing_records"))
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Q3: keys occurring more than once, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def q3_duplicate_patient_ids(t: Tables) -> DataFrame:
    """DQ-03 on patients.patient_id."""
    return duplicate_keys(t.patients, "patient_id")


def q3_duplicate_bill_ids(t: Tables) -> DataFrame:
    """DQ-03 applied to billing.bill_id (not unique in the mapped test data)."""
    return duplicate_keys(t.billing, "bill_id")


def q4_invalid_field_summary(t: Tables) -> DataFrame:
    """DQ-04: invalid / missing counts of three fields, as one long table."""
    los, pdays, appr = F.col("length_of_stay_hours"), F.col("payment_days"), F.col("approved_amount")
    v = t.visits.agg(
        F.count(F.lit(1)).alias("total_records"),
        flag_sum(los.isNull() | (los <= 0)).alias("invalid_count"),
    ).select(F.lit("visits").alias("source_table"), F.lit("length_of_stay_hours").alias("field_name"), "*")
    b = t.billing.agg(
        F.count(F.lit(1)).alias("n"),
        flag_sum(pdays.isNull() | (pdays < 0)).alias("bad_pd"),
        flag_sum(appr.isNull()).alias("bad_appr"),
    )
    b_long = b.select(
        F.lit("billing").alias("source_table"),
        F.explode(F.array(
            F.struct(F.lit("payment_days").alias("f"), F.col("bad_pd").alias("c")),
            F.struct(F.lit("approved_amount").alias("f"), F.col("bad_appr").alias("c")),
        )).alias("x"),
        F.col("n").alias("total_records"),
    ).select("source_table", F.col("x.f").alias("field_name"), "total_records",
             F.col("x.c").alias("invalid_count"))
    return v.unionByName(b_long).withColumn(
        "invalid_pct", pct(F.col("invalid_count"), F.col("total_records"))
    )


def q5_missing_insurance(t: Tables) -> DataFrame:
    """DQ-05: visits whose patient has a NULL or blank insurer."""
    blank = t.patients.where(is_blank(F.col("insurance_provider"))).select("patient_id")
    return (
        t.visits.select("patient_id").join(blank, "patient_id", "inner")
        .agg(F.count(F.lit(1)).alias("visits_missing_insurance"))
    )


# ----------------------------------------------------------------- Q6 - Q8
def _null_counts_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """One aggregate of per-column NULL counts, unpivoted to (column_name, null_count)."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    return wide.unpivot("_rows", columns, "column_name", "null_count")


def q6_missing_value_summary(df: DataFrame) -> DataFrame:
    """missing_value_summary: columns with NULLs, count, pct(2), Spark type."""
    dtypes = dict(df.dtypes)
    long = _null_counts_long(df, df.columns)
    return (
        long.where(F.col("null_count") > 0)
        .select(
            "column_name",
            "null_count",
            pct(F.col("null_count"), F.col("_rows")).alias("null_pct"),
            map_lookup(dtypes, F.col("column_name")).alias("dtype"),
        )
        .orderBy(F.desc("null_count"), "column_name")
    )


def q7_nulls_by_month(df: DataFrame, columns: list[str] = ("approved_amount", "payment_days"),
                      date_col: str = "billing_date") -> DataFrame:
    """NULL counts per 'yyyy-MM' of a date column, long (month, column_name, null_count)."""
    cols = list(columns)
    wide = df.groupBy(year_month(F.col(date_col)).alias("month")).agg(
        *[count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    return wide.unpivot("month", cols, "column_name", "null_count")


def q8_nulls_by_status(df: DataFrame, columns: list[str] = ("approved_amount", "payment_days"),
                       by: str = "claim_status") -> DataFrame:
    """Per status: rows, NULLs and NULL pct(1) of each column."""
    cols = list(columns)
    wide = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(F.col(c).isNull()).alias(c) for c in cols],
    )
    long = wide.unpivot([by, "total"], cols, "column_name", "nulls")
    return long.select("column_name", by, "total", "nulls",
                       pct(F.col("nulls"), F.col("total"), 1).alias("null_pct"))


# ---------------------------------------------------------------------- Q9
def _violations(table: str, df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Count rows failing each check (CHECK semantics: NULL passes)."""
    names = list(checks)
    wide = df.agg(*[count_if(~checks[n]).alias(n) for n in names])
    return wide.unpivot([], names, "constraint_name", "violations").select(
        F.lit(table).alias("table_name"), "constraint_name", "violations"
    )


def _dup_rows(table: str, df: DataFrame, key: str) -> DataFrame:
    """PRIMARY KEY: rows beyond the first per key (NULL keys count under NOT NULL)."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("violations"))
        .select(F.lit(table).alias("table_name"), F.lit(f"pk_{key}").alias("constraint_name"), "violations")
    )


def _orphans(table: str, child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """FOREIGN KEY: child rows whose non-NULL key is missing in the parent."""
    return (
        child.select(key).where(F.col(key).isNotNull())
        .join(parent.select(key), key, "left_anti")
        .agg(F.count(F.lit(1)).alias("violations"))
        .select(F.lit(table).alias("table_name"), F.lit(f"fk_{key}").alias("constraint_name"), "violations")
    )


def q9_constraint_check(t: Tables, maps: dict | None = None) -> DataFrame:
    """Declared DDL constraints checked as jobs: PK, FK, NOT NULL, CHECK."""
    maps = maps or K.testdata_encoding_maps()
    c = F.col
    p_checks = {f"not_null_{n}": c(n).isNotNull() for n in
                ["patient_id", "age", "gender", "city", "insurance_provider", "chronic_flag",
                 "registration_date"]}
    p_checks.update({
        "check_age": c("age").between(0, 120),
        "check_gender": c("gender").isin("M", "F"),
        "check_chronic_flag": c("chronic_flag").isin(0, 1),
    })
    v_checks = {f"not_null_{n}": c(n).isNotNull() for n in
                ["visit_id", "patient_id", "visit_date", "department", "visit_type", "risk_score",
                 "doctor_id"]}
    v_checks.update({
        "check_department": c("department").isin(*maps["department"].keys()),
        "check_visit_type": c("visit_type").isin(*maps["visit_type"].keys()),
        "check_length_of_stay_hours": c("length_of_stay_hours") >= 0,
        "check_risk_score": c("risk_score").isin(*maps["risk_score"].keys()),
    })
    b_checks = {f"not_null_{n}": c(n).isNotNull() for n in
                ["bill_id", "visit_id", "billed_amount", "claim_status", "billing_date"]}
    b_checks.update({
        "check_billed_amount": c("billed_amount") >= 0,
        "check_claim_status": c("claim_status").isin(*maps["claim_status"].keys()),
    })
    parts = [
        _violations("patients", t.patients, p_checks),
        _violations("visits", t.visits, v_checks),
        _violations("billing", t.billing, b_checks),
        _dup_rows("patients", t.patients, "patient_id"),
        _dup_rows("visits", t.visits, "visit_id"),
        _dup_rows("billing", t.billing, "bill_id"),
        _orphans("visits", t.visits, t.patients, "patient_id"),
        _orphans("billing", t.billing, t.visits, "visit_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -------------------------------------------------------------- Q10 / Q11
def q10_missing_values(df: DataFrame) -> DataFrame:
    """validate_dataframe, part 1: NULL count of every column."""
    return _null_counts_long(df, df.columns).select(
        "column_name", F.col("null_count").alias("missing_count"))


def q10_range_violations(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """validate_dataframe, part 2: values outside [low, high]; NULLs not counted."""
    ranges = ranges or K.MONITOR_NUMERIC_RANGES
    cols = [c for c in ranges if c in df.columns]
    wide = df.agg(*[
        count_if((F.col(c) < F.lit(ranges[c][0])) | (F.col(c) > F.lit(ranges[c][1]))).alias(c)
        for c in cols
    ])
    return wide.unpivot([], cols, "column_name", "violation_count")


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each (column_name, value) pair of several string columns (one shuffle)."""
    cols = [c for c in columns if c in df.columns]
    return (
        df.select(*cols).unpivot([], cols, "column_name", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    )


def unseen_counts(df: DataFrame, maps: dict) -> DataFrame:
    """(column_name, value, n_rows) of the category values absent from the maps."""
    known = df.sparkSession.createDataFrame(
        [(c, v) for c, m in maps.items() for v in m], "column_name string, value string"
    )
    return category_counts(df, list(maps)).join(F.broadcast(known), ["column_name", "value"], "left_anti")


def q10_unseen_categories(df: DataFrame, maps: dict | None = None) -> DataFrame:
    """validate_dataframe, part 3 / W8: category values absent from the maps."""
    return unseen_counts(df, maps or K.testdata_encoding_maps()).select(
        "column_name", F.col("value").alias("unseen_value"))


def q11_quality_status(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """Overall PASS / WARNING / FAIL from total missing and range violations, in one scan."""
    ranges = ranges or K.MONITOR_NUMERIC_RANGES
    outside = [(F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi)) for c, (lo, hi) in ranges.items() if c in df.columns]
    total = lambda tests: sum((count_if(x) for x in tests), F.lit(0)).cast("bigint")
    return df.agg(  # one scan for both totals
        total([F.col(c).isNull() for c in df.columns]).alias("total_missing"), total(outside).alias("total_violations"),
    ).withColumn(
        "status",
        F.when((F.col("total_missing") == 0) & (F.col("total_violations") == 0), F.lit("PASS"))
        .when(F.col("total_violations") == 0, F.lit("WARNING"))
        .otherwise(F.lit("FAIL")),
    )


# --------------------------------------------------------------------- Q12
def q12_validate_input_schema(new_df: DataFrame, schema_df: DataFrame, maps: dict | None = None) -> DataFrame:
    """Check new data against a feature schema (feature, min, max, nulls ...).

    Rows: (feature, check_name, status, n_values, pct, detail) with check_name
    in MISSING / NULLS / RANGE / OK / UNSEEN_CATEGORY and status OK / WARN /
    ERROR.  An unseen category value is a row of its own: ``detail`` is the
    value and ``n_values`` the rows that hold it.
    The schema is a small per-feature frame (bounded by the number of
    features), joined by broadcast.
    """
    maps = maps or K.testdata_encoding_maps()
    spark = new_df.sparkSession
    feats = [r["feature"] for r in schema_df.select("feature").collect()]  # schema is tiny
    present = [f for f in feats if f in new_df.columns]
    missing = [f for f in feats if f not in new_df.columns]
    sch = schema_df.select("feature", F.col("min").alias("_min"), F.col("max").alias("_max"))
    long = new_df.select(*[F.col(f).cast("double").alias(f) for f in present]).unpivot(
        [], present, "feature", "value")
    stats = (
        long.join(F.broadcast(sch), "feature")
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            count_if(F.col("value").isNull()).alias("_nulls"),
            count_if((F.col("value") < F.col("_min") * 0.5) | (F.col("value") > F.col("_max") * 1.5)
                     ).alias("_out"),
        )
        .withColumn("_null_pct", F.col("_nulls") * 100.0 / F.col("_rows"))
    )
    nulls = stats.where(F.col("_null_pct") > 10).select(
        "feature", F.lit("NULLS").alias("check_name"), F.lit("WARN").alias("status"),
        F.col("_nulls").alias("n_values"), F.round("_null_pct", 1).alias("pct"))
    rng = stats.where(F.col("_out") > 0).select(
        "feature", F.lit("RANGE").alias("check_name"),
        F.when(F.col("_out") / F.col("_rows") < 0.05, F.lit("WARN")).otherwise(F.lit("ERROR")).alias("status"),
        F.col("_out").alias("n_values"), F.round(F.col("_out") * 100.0 / F.col("_rows"), 1).alias("pct"))
    ok = stats.where((F.col("_out") == 0) & (F.col("_null_pct") <= 10)).select(
        "feature", F.lit("OK").alias("check_name"), F.lit("OK").alias("status"),
        F.lit(0).cast("bigint").alias("n_values"), F.lit(0.0).alias("pct"))
    unseen = unseen_counts(new_df, {k: v for k, v in maps.items() if k in K.CATEGORY_FIELDS}).select(
        F.col("column_name").alias("feature"), F.lit("UNSEEN_CATEGORY").alias("check_name"), F.lit("ERROR").alias("status"),
        F.col("n_rows").alias("n_values"), F.lit(None).cast("double").alias("pct"), F.col("value").alias("detail"))
    out = nulls.unionByName(rng).unionByName(ok).unionByName(unseen, allowMissingColumns=True)
    if missing:
        out = out.unionByName(spark.createDataFrame(
            [(f, "MISSING", "ERROR", 0, None, None) for f in missing],
            "feature string, check_name string, status string, n_values bigint, pct double, detail string"))
    return out


def q15_null_cells(df: DataFrame) -> DataFrame:
    """Total NULL cells and their share of all cells (model table export check)."""
    n_cols = len(df.columns)
    long = _null_counts_long(df, df.columns)
    return long.agg(
        F.sum("null_count").cast("bigint").alias("total_nulls"),
        (F.max("_rows") * F.lit(n_cols)).cast("bigint").alias("total_cells"),
    ).withColumn("null_pct", pct(F.col("total_nulls"), F.col("total_cells")))
