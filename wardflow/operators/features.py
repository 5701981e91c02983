"""Feature engineering, encoding and splits.

Two diverging pipelines are kept as named variants:

* variant U (``engineer_features`` / ``build_model_table``): clipped
  registration age, status-aware approval ratio, IQR-capped amounts, fixed
  encoding maps with suffix ``_encoded``, date split;
* variant N (``engineer_features_n`` / ``encode_alphabetical``): unclipped
  registration age, ``coalesce(approved, 0) / (billed + 1)``, median-filled
  payment days, alphabetical codes with suffix ``_enc``, positional 80/20
  split.

Scale notes: patient aggregates (W1) are a ``groupBy`` joined back on the
key instead of an unordered window, so a patient holding a third of all
rows is pre-aggregated map-side.  The aggregate is written before the join:
AQE splits a hot partition only where both sides of a join come straight
from an exchange.  Insurer rates (E4) are written too, so the planner knows
that they are a few rows and does not shuffle the frame on five keys.
Fences and medians come from the distributed exact quantile helper as 1-row
parameter frames cross-joined (broadcast) to the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardflow import constants as K
from wardflow.functions.prefix import row_numbers
from wardflow.functions.quantiles import exact_quantiles
from wardflow.functions.scalar import clip, map_lookup, weekday_monday0
from wardflow.session import write_table

CAP_COLUMNS = {
    "billed_amount": "billed_amount_capped",
    "payment_days": "payment_days_capped",
    "length_of_stay_hours": "los_capped",
}


#: Columns of the merged frame that each derived column of variant U is made of; others are made of themselves.
FEATURE_INPUTS = {
    "visit_frequency": ["patient_id", "visit_id"],
    "avg_los_per_patient": ["patient_id", "length_of_stay_hours"],
    "provider_rejection_rate": ["insurance_provider", "claim_status"],
    "approval_ratio": ["approved_amount", "billed_amount", "claim_status"],
    "days_since_registration": ["visit_date", "registration_date"],
    "visit_month": ["visit_date"], "visit_dayofweek": ["visit_date"], "visit_quarter": ["visit_date"],
    **{dst: [src] for src, dst in CAP_COLUMNS.items()},
}


def inputs_of(columns: list[str]) -> list[str]:
    """The columns of the merged frame that the model-table columns need."""
    out = [x for c in columns for x in FEATURE_INPUTS.get(c, [c.removesuffix("_encoded")])]
    return list(dict.fromkeys(out))


# ------------------------------------------------------------------ W1 / E1
def patient_aggregates(df: DataFrame, count_col: str = "visit_frequency",
                       avg_col: str = "avg_los_per_patient", distinct_visits: bool = False) -> DataFrame:
    """Per-patient visit count and mean stay, broadcast back to every row.

    Counts rows of ``df`` (bill grain after the billing join, like the
    original); ``distinct_visits=True`` counts distinct visits instead.
    """
    cnt = F.count_distinct("visit_id") if distinct_visits else F.count("visit_id")
    agg = write_table(df.groupBy("patient_id").agg(
        cnt.alias(count_col), F.avg("length_of_stay_hours").alias(avg_col)))
    return df.join(agg, "patient_id", "left")


def iqr_fences(df: DataFrame, columns: list[str]) -> DataFrame:
    """1-row frame: exact Q1/Q3 and fences [max(0, Q1-1.5IQR), Q3+1.5IQR] per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "value")
    q = exact_quantiles(long, ["feature"], "value", [0.25, 0.75])
    iqr = F.col("q1") - F.col("q0")
    fences = q.select(
        "feature",
        F.col("q0").alias("q1"), F.col("q1").alias("q3"),
        F.greatest(F.lit(0.0), F.col("q0") - 1.5 * iqr).alias("lower"),
        (F.col("q1") + 1.5 * iqr).alias("upper"),
    )
    return fences.groupBy().pivot("feature", list(columns)).agg(
        F.first("lower").alias("lower"), F.first("upper").alias("upper"))


def iqr_cap(df: DataFrame, columns: dict[str, str] | list[str]) -> DataFrame:
    """Clip each column to its IQR fences; NULL stays NULL."""
    mapping = columns if isinstance(columns, dict) else {c: c for c in columns}
    fences = iqr_fences(df, list(mapping))
    out = df.crossJoin(F.broadcast(fences))
    for src, dst in mapping.items():
        out = out.withColumn(dst, clip(F.col(src), F.col(f"{src}_lower"), F.col(f"{src}_upper")))
    return out.drop(*[f"{c}_{s}" for c in mapping for s in ("lower", "upper")])


# -------------------------------------------------------------------- E4
def rejection_rates_from_data(df: DataFrame) -> DataFrame:
    """A3 as a lookup table: share of Rejected bills per insurer."""
    return df.groupBy("insurance_provider").agg(
        F.avg(F.when(F.col("claim_status") == "Rejected", 1.0).otherwise(0.0)).alias("rate"))


def provider_rejection_rate(df: DataFrame, rates: dict | DataFrame | None = None) -> DataFrame:
    """Insurer -> rejection rate; unknown insurer -> mean of the table.

    ``rates`` is a fixed dict (literal map) or a (insurance_provider, rate)
    frame computed from data (one row per insurer; Spark's size check
    decides on broadcasting it).
    """
    if rates is None:
        rates = rejection_rates_from_data(df)
    if not isinstance(rates, dict):
        rates = write_table(rates)
    if isinstance(rates, dict):
        default = round(sum(rates.values()) / len(rates), 6)
        return df.withColumn(
            "provider_rejection_rate",
            F.coalesce(map_lookup(rates, F.col("insurance_provider")), F.lit(default)))
    mean = rates.agg(F.avg("rate").alias("_mean_rate"))
    return (
        df.join(rates.withColumnRenamed("rate", "_rate"), "insurance_provider", "left")
        .crossJoin(F.broadcast(mean))
        .withColumn("provider_rejection_rate", F.coalesce(F.col("_rate"), F.col("_mean_rate")))
        .drop("_rate", "_mean_rate")
    )


# --------------------------------------------------------------------- E2
def feature_parameters(df: DataFrame, wanted: set[str] | None = None) -> DataFrame | None:
    """1-row frame of every data-derived scalar that the wanted features need, by one exact-quantile job.

    IQR fences of the capped columns and the median approval ratio of
    Pending bills (0.5 when there is none) come from a long (feature, value)
    frame of the *input* rows.  None if no wanted feature needs one.
    """
    caps = [src for src, dst in CAP_COLUMNS.items() if wanted is None or dst in wanted]
    ratio = F.try_divide(F.col("approved_amount"), F.col("billed_amount"))
    with_ratio = wanted is None or "approval_ratio" in wanted
    pieces = []
    if caps:
        pieces.append(df.select(*[F.col(c).cast("double").alias(c) for c in caps]).unpivot([], caps, "feature", "value"))
    if with_ratio:
        pieces.append(df.where(F.col("claim_status") == "Pending").select(
            F.lit("pending_ratio").alias("feature"), ratio.alias("value")))
    if not pieces:
        return None
    q = exact_quantiles(reduce(DataFrame.unionByName, pieces), ["feature"], "value", [0.25, 0.5, 0.75])
    iqr = F.col("q2") - F.col("q0")
    q = q.select("feature", F.greatest(F.lit(0.0), F.col("q0") - 1.5 * iqr).alias("lower"),
                 (F.col("q2") + 1.5 * iqr).alias("upper"), F.col("q1").alias("median"))
    wide = q.groupBy().pivot("feature", caps + ["pending_ratio"] * with_ratio).agg(
        F.first("lower").alias("lower"), F.first("upper").alias("upper"), F.first("median").alias("median"))
    return wide.select(
        *[F.col(f"{c}_{s}") for c in caps for s in ("lower", "upper")],
        *[F.coalesce(F.col("pending_ratio_median"), F.lit(0.5)).alias("_pm")] * with_ratio,
    )


def engineer_features(df: DataFrame, rates: dict | DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """The eleven variant-U features on the merged frame, or ``only`` some of them.

    Every parameter (patient aggregates, insurer rates, fences, Pending
    median) is computed from ``df`` itself, so the upstream plan is not
    re-run inside each parameter job; parameters that no wanted feature
    needs are not computed.
    """
    wanted = None if only is None else set(only)
    want = lambda *names: wanted is None or bool(wanted & set(names))
    params = feature_parameters(df, wanted)
    out = patient_aggregates(df) if want("visit_frequency", "avg_los_per_patient") else df
    if want("provider_rejection_rate"):
        out = provider_rejection_rate(out, rates if rates is not None else rejection_rates_from_data(df))
    if params is not None:
        out = out.crossJoin(F.broadcast(params))
    if want("approval_ratio"):
        raw = F.try_divide(F.col("approved_amount"), F.col("billed_amount"))
        status = F.col("claim_status")
        out = out.withColumn(
            "approval_ratio",
            F.when(raw.isNull() & (status == "Rejected"), F.lit(0.0))
            .when(raw.isNull() & (status == "Pending"), F.col("_pm"))
            .when(raw.isNull() & (status == "Paid"), F.lit(1.0))
            .otherwise(raw),
        )
    for src, dst in CAP_COLUMNS.items():
        if want(dst):
            capped = clip(F.col(src), F.col(f"{src}_lower"), F.col(f"{src}_upper"))
            out = out.withColumn(dst, F.coalesce(capped, F.lit(0.0)) if src == "payment_days" else capped)
    out = out.drop("_pm", *[f"{c}_{s}" for c in CAP_COLUMNS for s in ("lower", "upper")])
    if want("days_since_registration"):
        out = out.withColumn(
            "days_since_registration",
            clip(F.datediff("visit_date", "registration_date").cast("double"), lower=0.0).cast("int"))
    for name, value in (("visit_month", F.month("visit_date")), ("visit_dayofweek", weekday_monday0(F.col("visit_date"))),
                        ("visit_quarter", F.quarter("visit_date"))):
        if want(name):
            out = out.withColumn(name, value)
    return out


# ---------------------------------------------------------------- E5 - E7
def encode_fixed(df: DataFrame, maps: dict, suffix: str = "_encoded") -> DataFrame:
    """E5: fixed category -> code maps; unseen -> NULL."""
    for c, m in maps.items():
        if c in df.columns:
            df = df.withColumn(c + suffix, map_lookup(m, F.col(c), "int"))
    return df


def encode_alphabetical(df: DataFrame, columns: list[str] = tuple(K.CATEGORY_FIELDS),
                        suffix: str = "_enc") -> DataFrame:
    """Codes fitted on the data in alphabetical order (LabelEncoder).

    ``StringIndexer(stringOrderType="alphabetAsc")`` fits all columns in one
    aggregation pass; its label arrays are bounded by category cardinality
    and applied row-wise without joins.  NULL or unseen values get the
    extra code ``numLabels`` (``handleInvalid="keep"``).
    """
    from pyspark.ml.feature import StringIndexer

    cols = [c for c in columns if c in df.columns]
    tmp = [f"__{c}_idx" for c in cols]
    model = StringIndexer(inputCols=cols, outputCols=tmp, stringOrderType="alphabetAsc",
                          handleInvalid="keep").fit(df)
    out = model.transform(df)
    for c, t in zip(cols, tmp):
        out = out.withColumn(c + suffix, F.col(t).cast("int")).drop(t)
    return out


def build_model_table(df: DataFrame, maps: dict | None = None,
                      rates: dict | DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """E2 -> E5 -> the 30 model columns that exist (P10), or only the given ones.

    For some columns, ``df`` needs no more than ``inputs_of`` them.
    """
    maps = maps or K.testdata_encoding_maps()
    out = encode_fixed(engineer_features(df, rates, columns), maps)
    return out.select(*[c for c in columns or K.MODEL_TABLE_COLUMNS if c in out.columns])


# --------------------------------------------------------------------- E8
def engineer_features_n(df: DataFrame) -> DataFrame:
    """Variant-N features (notebook pipeline)."""
    out = patient_aggregates(df, count_col="patient_visit_frequency")
    med = exact_quantiles(df.select(F.lit(1).alias("_k"), "payment_days"), ["_k"],
                          "payment_days", [0.5]).select(F.col("q0").alias("_pd_median"))
    out = out.crossJoin(F.broadcast(med.groupBy().agg(F.first("_pd_median").alias("_pd_median"))))
    return (
        out.withColumn("days_since_registration", F.datediff("visit_date", "registration_date"))
        .withColumn("visit_month", F.month("visit_date"))
        .withColumn("visit_day_of_week", weekday_monday0(F.col("visit_date")))
        .withColumn("approved_amount", F.coalesce(F.col("approved_amount"), F.lit(0.0)))
        .withColumn("payment_days", F.coalesce(F.col("payment_days"), F.col("_pd_median")))
        .withColumn("approval_ratio", F.col("approved_amount") / (F.col("billed_amount") + F.lit(1.0)))
        .drop("_pd_median")
    )


# ------------------------------------------------------------- E10 / W2
def time_split(df: DataFrame, date_col: str = "visit_date",
               split_date: str = K.SPLIT_DATE) -> tuple[DataFrame, DataFrame]:
    """Rows before the date train, the rest test (two pushed-down filters)."""
    d = F.col(date_col)
    cut = F.lit(split_date).cast("date")
    return df.where(d < cut), df.where(d >= cut)


def positional_split(df: DataFrame, frac: float = 0.8, date_col: str = "visit_date",
                     tie_cols: tuple[str, ...] = ("visit_id", "bill_id")) -> DataFrame:
    """First ``floor(n * frac)`` rows in date order -> ``split = 'train'``.

    Daily counts (bounded by the calendar) are prefix-summed to find the
    cutoff date; only rows *on* that date are ranked, by ``tie_cols``,
    with distributed row numbers (no single-task window).
    Returns ``df`` with a ``split`` column ('train' / 'test').
    """
    days = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("_day_n"))
    w = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    cum = (
        days.withColumn("_cum", F.sum("_day_n").over(w))
        .crossJoin(F.broadcast(total))
        .withColumn("_k", F.floor(F.col("_n") * F.lit(frac)).cast("long"))
    )
    cutoff = cum.where((F.col("_cum") - F.col("_day_n") <= F.col("_k")) & (F.col("_k") <= F.col("_cum"))) \
        .orderBy(date_col).limit(1) \
        .select(F.col(date_col).alias("_cut"), (F.col("_k") - (F.col("_cum") - F.col("_day_n"))).alias("_take"))
    out = df.crossJoin(F.broadcast(cutoff))
    d = F.col(date_col)
    # rows of the cutoff date are numbered by a range-partitioned sort, so a
    # date holding a third of all rows is still spread over many tasks
    on_cut = row_numbers(out.where(d == F.col("_cut")), [F.asc_nulls_last(c) for c in tie_cols], "_rn")
    on_cut = on_cut.withColumn(
        "split", F.when(F.col("_rn") < F.col("_take"), F.lit("train")).otherwise(F.lit("test"))).drop("_rn")
    rest = out.where((d != F.col("_cut")) | d.isNull()).withColumn(
        "split", F.when(d < F.col("_cut"), F.lit("train")).otherwise(F.lit("test")))
    return on_cut.unionByName(rest).drop("_cut", "_take")


def split_summary(df: DataFrame, date_col: str = "visit_date") -> DataFrame:
    """Rows and date range per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(date_col).alias("min_date"),
        F.max(date_col).alias("max_date"),
    )


# -------------------------------------------------------------------- E12
def balanced_class_weights(df: DataFrame, label_col: str, weight_col: str = "weight") -> DataFrame:
    """N / (k * n_c) per class, joined to each row (k = number of classes)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    weights = counts.crossJoin(tot).select(
        label_col, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(weight_col))
    return df.join(F.broadcast(weights), label_col, "left")
