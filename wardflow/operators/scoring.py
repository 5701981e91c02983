"""Batch scoring: request validation, scoring-time features, hashing, responses.

The original scored one HTTP request at a time; here a *batch* (or a
stream, see ``wardflow.streaming``) of requests is one DataFrame:

* Q14 ``validate_requests``: fixed field bounds and category domains per
  model -> ``errors`` array; invalid rows are quarantined with a reason
  instead of failing the whole call.
* Q13 ``validate_against_schema``: feature-schema range warnings (outside
  min x 0.5 .. max x 1.5), missing-feature warnings, unseen categories.
* E9 ``scoring_features``: frozen defaults and caps (no data-dependent
  parameters at scoring time).
* F12 ``input_hash``: SHA-256 of the canonical JSON text, first 16 hex, in
  built-in expressions (``functions.canonical_json``).
* M6 ``score_requests``: class, confidence, probabilities map, version,
  timestamp, hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardflow import constants as K
from wardflow.functions.canonical_json import canonical_json
from wardflow.session import write_table
from wardflow.functions.scalar import clip, iso_timestamp, map_lookup, model_version, weekday_monday0

# ---------------------------------------------------------------------------
# FIXED VALUES: request field bounds of the two scoring endpoints
# (field -> (lower bound, upper bound); None = unbounded)
# ---------------------------------------------------------------------------
RISK_REQUEST_BOUNDS = {
    "age": (0, 120),
    "chronic_flag": (0, 1),
    "length_of_stay_hours": (0, None),
    "patient_visit_frequency": (1, None),
    "avg_los_per_patient": (0, None),
    "days_since_registration": (0, None),
    "visit_month": (1, 12),
    "visit_day_of_week": (0, 6),
}
RISK_REQUEST_CATEGORIES = ["gender", "city", "department", "visit_type"]
CLAIM_REQUEST_BOUNDS = {
    "billed_amount": (0, None),
    "approved_amount": (0, None),
    "approval_ratio": (0, 1),
    "length_of_stay_hours": (0, None),
    "age": (0, 120),
    "chronic_flag": (0, 1),
    "patient_visit_frequency": (1, None),
    "days_since_registration": (0, None),
    "visit_month": (1, 12),
}
CLAIM_REQUEST_CATEGORIES = ["department", "visit_type", "gender", "insurance_provider"]


# --------------------------------------------------------------------- Q14
def request_errors(bounds: dict, categories: list[str], maps: dict) -> Column:
    """Array of error strings for one request row (empty when valid)."""
    checks = []
    for f, (lo, hi) in bounds.items():
        c = F.col(f)
        checks.append(F.when(c.isNull(), F.lit(f"{f}: missing")))
        if lo is not None:
            checks.append(F.when(c < F.lit(lo), F.lit(f"{f}: below {lo}")))
        if hi is not None:
            checks.append(F.when(c > F.lit(hi), F.lit(f"{f}: above {hi}")))
    for f in categories:
        allowed = list(maps[f])
        checks.append(F.when(F.col(f).isNull() | ~F.col(f).isin(*allowed),
                             F.concat(F.lit(f"{f}: not allowed value "), F.coalesce(F.col(f), F.lit("NULL")))))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate_requests(df: DataFrame, bounds: dict, categories: list[str], maps: dict) -> DataFrame:
    """Q14: adds ``errors`` (array) and ``valid`` (no errors)."""
    return df.withColumn("errors", request_errors(bounds, categories, maps)).withColumn(
        "valid", F.size("errors") == 0)


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows for scoring; the rest is a quarantine with its reasons."""
    return validated.where(F.col("valid")), validated.where(~F.col("valid"))


def validation_summary(validated: DataFrame) -> DataFrame:
    """(error, n_rows) over all errors plus a '__valid__' row count."""
    errs = validated.select(F.explode("errors").alias("e")).select(
        F.regexp_replace("e", " value .*$", "").alias("error"))
    ok = validated.where(F.col("valid")).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("__valid__").alias("error"), "n_rows")
    return errs.groupBy("error").agg(F.count(F.lit(1)).alias("n_rows")).unionByName(ok)


# --------------------------------------------------------------------- Q13
def validate_against_schema(df: DataFrame, schema_df: DataFrame, maps: dict,
                            categories: list[str] = tuple(K.CATEGORY_FIELDS)) -> DataFrame:
    """Q13: ``warnings`` / ``errors`` arrays of (code, field, value, low, high) and ``valid`` per request row.

    The feature schema (one row per feature) is a small parameter frame
    collected once to build the column expressions.
    """
    rows = schema_df.select("feature", "min", "max").collect()  # bounded by #features

    def finding(code: str, field: str, value: Column, low=None, high=None) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), value.cast("string").alias("value"),
                        F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"))

    none = F.lit(None)
    warns, errs = [], []
    for r in rows:
        f, low, high = r["feature"], r["min"], r["max"]
        if f not in df.columns:
            warns.append(finding("missing_feature", f, none, low, high))
        elif low is not None and high is not None:  # a feature without training values has no range
            v = F.col(f).cast("double")
            warns.append(F.when((v < F.lit(low * 0.5)) | (v > F.lit(high * 1.5)), finding("out_of_range", f, v, low, high)))
    for c in categories:
        if c in df.columns:  # NULL is not a known category
            errs.append(F.when(F.col(c).isNull() | ~F.col(c).isin(*list(maps[c])), finding("unseen_category", c, F.col(c))))
    kind = "array<struct<code:string,field:string,value:string,low:double,high:double>>"
    w = F.filter(F.array(*warns), lambda x: x.isNotNull()) if warns else F.array().cast(kind)
    e = F.filter(F.array(*errs), lambda x: x.isNotNull()) if errs else F.array().cast(kind)
    return df.withColumn("warnings", w).withColumn("errors", e).withColumn("valid", F.size("errors") == 0)


# ---------------------------------------------------------------------- E9
def scoring_features(req: DataFrame, maps: dict, rates: dict | DataFrame | None = None) -> DataFrame:
    """Request rows -> model features with frozen defaults and caps.

    ``rates`` maps the insurer to its rejection rate, as a dict or as an
    (insurance_provider, rate) frame of one row an insurer; others get the default.
    """
    if isinstance(rates, DataFrame):
        table = write_table(rates.where("insurance_provider is not null").select(
            F.col("insurance_provider").alias("_insurer"), F.col("rate").alias("_rate")))
        req = req.join(table, F.col("insurance_provider") == F.col("_insurer"), "left").drop("_insurer")
        known = F.col("_rate")
    else:
        known = map_lookup(rates, F.col("insurance_provider")) if rates else F.lit(None)
    approved, billed = F.col("approved_amount"), F.col("billed_amount")
    pdays = F.col("payment_days") if "payment_days" in req.columns else F.lit(None).cast("double")
    out = (
        req.withColumn("visit_date", F.to_date("visit_date"))
        .withColumn("registration_date", F.to_date("registration_date"))
        .withColumn("visit_frequency", F.lit(K.SCORING_VISIT_FREQUENCY))
        .withColumn("avg_los_per_patient", F.lit(K.SCORING_AVG_LOS))
        .withColumn("provider_rejection_rate",
                    F.coalesce(known, F.lit(K.SCORING_DEFAULT_REJECTION_RATE)).cast("double"))
        .drop("_rate")
        .withColumn("days_since_registration",
                    clip(F.datediff("visit_date", "registration_date").cast("double"), lower=0.0).cast("int"))
        .withColumn("approval_ratio",
                    F.when(approved.isNotNull() & (billed > 0), approved / billed).otherwise(F.lit(0.0)))
        .withColumn("billed_amount_capped", clip(billed.cast("double"), upper=K.SCORING_BILLED_CAP))
        .withColumn("payment_days_capped",
                    F.coalesce(clip(pdays.cast("double"), upper=K.SCORING_PAYMENT_DAYS_CAP), F.lit(0.0)))
        .withColumn("los_capped", clip(F.col("length_of_stay_hours").cast("double"), upper=K.SCORING_LOS_CAP))
        .withColumn("visit_month", F.month("visit_date"))
        .withColumn("visit_dayofweek", weekday_monday0(F.col("visit_date")))
        .withColumn("visit_quarter", F.quarter("visit_date"))
    )
    for c, m in maps.items():
        if c in out.columns:
            out = out.withColumn(c + "_encoded", map_lookup(m, F.col(c), "int"))
    return out


# --------------------------------------------------------------------- F12
def input_hash(df: DataFrame, fields: list[str]) -> Column:
    """first 16 hex of SHA-256 over ``json.dumps(row, sort_keys=True)``."""
    return F.substring(F.sha2(canonical_json(df.schema, fields).cast("binary"), 256), 1, 16)


# ---------------------------------------------------------------------- M6
def score_requests(model, req_features: DataFrame, classes: list[str], hash_fields: list[str],
                   version: str | None = None, clock: Column | None = None) -> DataFrame:
    """M6: response rows (visit_id, predicted_class, confidence, probabilities,
    model_version, timestamp, input_hash)."""
    from wardflow.operators.models import predict

    with_hash = req_features.withColumn("input_hash", input_hash(req_features, hash_fields))
    return _responses(predict(model, with_hash, classes), version, clock)


def score_with_centroids(model: DataFrame, req_features: DataFrame, features: list[str], classes: list[str],
                         hash_fields: list[str], version: str | None = None, clock: Column | None = None,
                         required: list[str] = ()) -> DataFrame:
    """M6 by the baseline centroid model (a 1-row frame): the same response rows.

    A request without a required field is answered too: no class, confidence or
    probabilities, and ``errors`` holds a code ``missing_<field>`` for each.
    """
    from wardflow.operators.models import centroid_predict

    with_hash = req_features.withColumn("input_hash", input_hash(req_features, hash_fields))
    scored = centroid_predict(with_hash, model, features, classes).withColumnRenamed("prediction", "predicted_class")
    names = F.array(*[F.lit(c) for c in classes])
    scored = scored.withColumn("probabilities", F.map_from_arrays(names, F.transform("probs", lambda p: F.round(p, 4))))
    codes = F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in required]).cast("array<string>")
    scored = scored.withColumn("errors", F.filter(codes, lambda x: x.isNotNull()))
    for c in ("predicted_class", "confidence", "probabilities"):
        scored = scored.withColumn(c, F.when(F.size("errors") == 0, F.col(c)))
    return _responses(scored, version, clock)


def _responses(scored: DataFrame, version: str | None, clock: Column | None) -> DataFrame:
    ver = F.lit(version) if version else model_version()
    return scored.select(
        "visit_id", "predicted_class", "confidence", "probabilities",
        ver.alias("model_version"), iso_timestamp(clock).alias("timestamp"), "input_hash",
        *[c for c in scored.columns if c == "errors"])


def rejection_action_rows(scored: DataFrame) -> DataFrame:
    """rejection risk (percent of the Rejected probability) -> action text; NULL for a rejected request."""
    from wardflow.functions.scalar import rejection_action

    risk = F.round(F.col("probabilities").getItem(K.REJECTED_CLASS) * 100.0, 1)
    return scored.withColumn("rejection_risk", risk).withColumn(
        "recommended_action", F.when(risk.isNotNull(), rejection_action(risk)))
