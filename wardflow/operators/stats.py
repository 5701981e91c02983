"""Distribution and summary statistics.

Several columns are profiled by one wide aggregate that is turned into one
row a column afterwards; only quantiles unpivot to (feature, value).
Quantiles are exact (distributed rank selection, see functions.quantiles).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.functions.quantiles import exact_quantiles
from wardflow.functions.scalar import count_if, map_lookup, pct
from wardflow.session import write_table


def per_column(df: DataFrame, columns: list[str], aggregates) -> DataFrame:
    """One row a column from one wide aggregate (rows are not multiplied by the columns).

    ``aggregates(name, value)`` gives the aliased aggregates of a column's values as double.
    """
    rows = [F.struct(F.lit(c).alias("feature"), *aggregates(c, F.col(c).cast("double"))) for c in columns]
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def _long(df: DataFrame, columns: list[str], ids: list[str] = ()) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), "feature", "value")


def a1_value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """value_counts of several columns with pct(2) of all rows (NULL kept as a value)."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("column_name").agg(F.sum("count").alias("_n"))
    return counts.join(F.broadcast(totals), "column_name").select(
        "column_name", "value", "count", pct(F.col("count"), F.col("_n")).alias("pct"))


def a2_crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """row x column counts with explicit column values, missing cells 0."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0, subset=values)


def a3_rejection_rate_by_insurer(df: DataFrame) -> DataFrame:
    """Rejected share (pct) per insurer and the mean of those rates."""
    rates = df.groupBy("insurance_provider").agg(
        (F.avg(F.when(F.col("claim_status") == "Rejected", 1.0).otherwise(0.0)) * 100.0)
        .alias("rejection_rate_pct"))
    mean = rates.agg(F.avg("rejection_rate_pct").alias("mean_rate_pct"))
    return rates.crossJoin(F.broadcast(mean))


def a4_city_billing(df: DataFrame) -> DataFrame:
    """Rows and mean billed amount per city."""
    return df.groupBy("city").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("billed_amount").alias("avg_billed"))


def a5_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram between min and max; the last bin is closed."""
    x = F.col(column).cast("double")
    rng = df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    w = (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))
    binned = (
        df.select(x.alias("_x")).where(F.col("_x").isNotNull())
        .crossJoin(F.broadcast(rng))
        .withColumn("bin", F.when(w > 0, F.least(F.floor((F.col("_x") - F.col("_mn")) / w),
                                                  F.lit(bins - 1))).otherwise(F.lit(0)).cast("int"))
    )
    return binned.groupBy("bin", "_mn", "_mx").agg(F.count(F.lit(1)).alias("count")).select(
        "bin",
        (F.col("_mn") + F.col("bin") * (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))).alias("lower"),
        (F.col("_mn") + (F.col("bin") + 1) * (F.col("_mx") - F.col("_mn")) / F.lit(float(bins))).alias("upper"),
        "count",
    )


def a6_box_summary(df: DataFrame, group_col: str, features: list[str]) -> DataFrame:
    """Box-plot numbers per group and feature: quartiles and 1.5 IQR whiskers."""
    long = _long(df, features, [group_col]).withColumnRenamed(group_col, "group_value")
    q = exact_quantiles(long, ["group_value", "feature"], "value", [0.25, 0.5, 0.75])
    # written: its size grows with the groups, and the planner decides on broadcasting it
    q = write_table(q.select("group_value", "feature", "n", F.col("q0").alias("q1"), F.col("q1").alias("median"),
                             F.col("q2").alias("q3")))
    iqr = F.col("q3") - F.col("q1")
    whisk = (
        long.where(F.col("value").isNotNull())
        .join(q.select("group_value", "feature", "q1", "q3"), ["group_value", "feature"])
        .groupBy("group_value", "feature")
        .agg(
            F.min(F.when(F.col("value") >= F.col("q1") - 1.5 * iqr, F.col("value"))).alias("whisker_low"),
            F.max(F.when(F.col("value") <= F.col("q3") + 1.5 * iqr, F.col("value"))).alias("whisker_high"),
        )
    )
    return q.join(whisk, ["group_value", "feature"]).select(
        F.lit(group_col).alias("group_col"), "group_value", "feature", "n", "q1", "median", "q3",
        "whisker_low", "whisker_high")


def a7_iqr_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q1, Q3, fences (lower >= 0), outliers and their pct of all rows (NULLs included).

    One exact-quantile job gives Q1/Q3 for every column; the fences of all
    columns are one row, and one wide aggregate counts against it.
    """
    long = _long(df, columns)
    q = exact_quantiles(long, ["feature"], "value", [0.25, 0.75]).select(
        "feature", F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    fences = write_table(q.select("feature", "q1", "q3", iqr.alias("iqr"),
                                  F.greatest(F.lit(0.0), F.col("q1") - 1.5 * iqr).alias("lower_fence"),
                                  (F.col("q3") + 1.5 * iqr).alias("upper_fence")))
    by_feature = fences.agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("lower_fence", "upper_fence")))).alias("_f"))  # one row, an entry a column
    counts = per_column(df.crossJoin(F.broadcast(by_feature)), columns, lambda c, v: [
        F.count(F.lit(1)).alias("n_rows"),
        count_if((v < F.col("_f")[c]["lower_fence"]) | (v > F.col("_f")[c]["upper_fence"])).alias("n_outliers")])
    return fences.join(counts, "feature").select(
        "feature", "q1", "q3", "iqr", "lower_fence", "upper_fence",
        "n_outliers", pct(F.col("n_outliers"), F.col("n_rows")).alias("outlier_pct"))


def a8_zscore_summary(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """Count of |z| > threshold with population std over non-NULL values; pct over all rows."""
    st = write_table(per_column(df, columns, lambda c, v: [
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"), F.count(F.lit(1)).alias("n_rows")]))
    by_feature = st.agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("mean", "std_pop")))).alias("_f"))  # one row, an entry a column
    counts = per_column(df.crossJoin(F.broadcast(by_feature)), columns, lambda c, v: [
        count_if(F.abs(v - F.col("_f")[c]["mean"]) / F.col("_f")[c]["std_pop"] > F.lit(threshold)).alias("n_outliers")])
    out = st.join(counts, "feature")
    return out.select("feature", "mean", "std_pop", "n_outliers",
                      pct(F.col("n_outliers"), F.col("n_rows")).alias("outlier_pct"))


def a9_correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair (strict lower triangle), pairwise complete."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
                    for a, b in pairs])
    names = [f"{a}__{b}" for a, b in pairs]
    long = wide.unpivot([], names, "_pair", "corr")
    return long.select(
        F.split("_pair", "__").getItem(1).alias("col_a"),
        F.split("_pair", "__").getItem(0).alias("col_b"),
        "corr")


def a10_overview(df: DataFrame) -> DataFrame:
    """Rows, visit date range, distinct patients and visits."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("visit_date").alias("min_visit_date"),
        F.max("visit_date").alias("max_visit_date"),
        F.count_distinct("patient_id").alias("n_patients"),
        F.count_distinct("visit_id").alias("n_visits"),
    )


def a11_describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column."""
    long = _long(df, columns)
    basic = per_column(df, columns, lambda c, v: [
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max")])
    q = exact_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75]).select(
        "feature", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    return basic.join(q, "feature", "left").select(
        "feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def a12_first_per_group(df: DataFrame, group_col: str, value_col: str, digits: int = 4) -> DataFrame:
    """One value per group (min, deterministic stand-in for 'first') rounded."""
    return df.groupBy(group_col).agg(F.round(F.min(value_col), digits).alias(value_col))


def a13_feature_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature schema rows: dtype, min, max, mean, sample std, NULL count."""
    dtypes = dict(df.dtypes)
    return per_column(df, features, lambda c, v: [
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        count_if(v.isNull()).alias("nulls")]).select("feature", map_lookup(dtypes, F.col("feature")).alias("dtype"),
             "min", "max", "mean", "std", "nulls")


def a14_medians(df: DataFrame) -> DataFrame:
    """Global median of payment_days and median approval ratio of Pending bills."""
    ratio = F.try_divide(F.col("approved_amount"), F.col("billed_amount"))
    long = df.select(
        F.lit("payment_days").alias("feature"), F.col("payment_days").alias("value")
    ).unionByName(
        df.where(F.col("claim_status") == "Pending").select(
            F.lit("pending_approval_ratio").alias("feature"), ratio.alias("value")))
    q = exact_quantiles(long, ["feature"], "value", [0.5])
    return q.groupBy().pivot("feature", ["payment_days", "pending_approval_ratio"]).agg(
        F.first("q0")).select(F.col("payment_days").alias("median_payment_days"),
                              F.col("pending_approval_ratio").alias("median_pending_approval_ratio"))


def a17_engineered_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """dtype, NULLs, min and max of engineered columns."""
    return a13_feature_profile(df, features).select("feature", "dtype", "nulls", "min", "max")
