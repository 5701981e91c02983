"""Append-only logs and file sinks (S7-S13, S15 sink) and their summaries.

Logs are directories of part files appended with ``mode("append")``, so
every scoring job (batch or streaming micro-batch) adds files instead of
rewriting one shared file; readers always pass a declared schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of requests without a prediction in the summaries.
REJECTED = "rejected_request"

PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("visit_id", T.LongType()),
    T.StructField("predicted_class", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("input_hash", T.StringType()),
])

AUDIT_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("visit_id", T.LongType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("detail", T.StringType()),
    T.StructField("logged_by", T.StringType()),
])

SERVICE_RECORD_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("input", T.MapType(T.StringType(), T.StringType())),
    T.StructField("prediction", T.StringType()),
    T.StructField("model_version", T.StringType()),
])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def remove_last(spark: SparkSession, path: str) -> None:
    """Delete the file with the largest number as its name, such as a stream's last commit mark."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().isdigit()]
    if files:
        fs.delete(max(files, key=lambda f: int(f.getName())), False)


# ------------------------------------------------------------------ S7, S8, S9
def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV sink (overwrite)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON-lines sink (overwrite)."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Declared-schema JSON source; a missing path is an error."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).json(path)


FEATURE_SCHEMA_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("dtype", T.StringType()),
    T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType()),
    T.StructField("nulls", T.LongType()),
])


# ------------------------------------------------------------------ S12, S10
def append_prediction_log(responses: DataFrame, model_name: str, path: str) -> None:
    """Append 7-column prediction rows."""
    responses.select(
        "timestamp", F.lit(model_name).alias("model"), F.col("visit_id").cast("long"),
        "predicted_class", F.col("confidence").cast("double"), "model_version", "input_hash",
    ).write.mode("append").json(path)


def load_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """S10 / S12 load: declared schema; an absent log is an empty frame (zero report)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], PREDICTION_LOG_SCHEMA)
    return spark.read.schema(PREDICTION_LOG_SCHEMA).json(path)


# ------------------------------------------------------------------------ S13
def append_audit_predictions(responses: DataFrame, model_name: str, path: str,
                             logged_by: str = "wardflow") -> None:
    """S13 log_prediction for a batch (confidence rounded to 4); a rejected request is an event of its own kind."""
    errors = F.concat_ws(",", "errors") if "errors" in responses.columns else F.lit("")
    responses.select(
        "timestamp", F.when(errors == "", "prediction").otherwise(REJECTED).alias("event_type"),
        F.lit(model_name).alias("model"),
        F.col("visit_id").cast("long"), F.col("predicted_class").alias("prediction"),
        F.round("confidence", 4).alias("confidence"), errors.alias("detail"),
        F.lit(logged_by).alias("logged_by"),
    ).write.mode("append").json(path)


def append_audit_event(spark: SparkSession, path: str, event_type: str, detail: str, model: str = "",
                       logged_by: str = "wardflow", timestamp: str | None = None) -> None:
    """S13 log_event: one system event (drift alert, retraining trigger ...)."""
    ts = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    spark.range(1).select(
        ts.alias("timestamp"), F.lit(event_type).alias("event_type"), F.lit(model).alias("model"),
        F.lit(None).cast("long").alias("visit_id"), F.lit(None).cast("string").alias("prediction"),
        F.lit(None).cast("double").alias("confidence"), F.lit(detail).alias("detail"),
        F.lit(logged_by).alias("logged_by"),
    ).write.mode("append").json(path)


def load_audit_log(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], AUDIT_LOG_SCHEMA)
    return spark.read.schema(AUDIT_LOG_SCHEMA).json(path)


# ------------------------------------------------------------------------ S11
def service_log_lines(responses: DataFrame, endpoint: str) -> DataFrame:
    """S11 write format: ``yyyy-MM-dd HH:mm:ss,SSS - {json}`` per scored row.

    The JSON carries the input hash and probabilities, not raw patient
    fields.
    """
    rec = F.to_json(F.struct(
        F.col("timestamp"), F.lit(endpoint).alias("endpoint"),
        F.create_map(F.lit("input_hash"), F.col("input_hash"),
                     F.lit("probabilities"), F.to_json("probabilities")).alias("input"),
        F.col("predicted_class").alias("prediction"), F.col("model_version")))
    asctime = F.date_format(F.to_timestamp("timestamp"), "yyyy-MM-dd HH:mm:ss,SSS")
    return responses.select(F.concat(asctime, F.lit(" - "), rec).alias("value"))


def parse_service_log(lines: DataFrame) -> DataFrame:
    """S11 read: text lines -> prefix time + parsed JSON record."""
    m = F.regexp_extract("value", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (\{.*\})$", 2)
    parsed = lines.select(
        F.regexp_extract("value", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - ", 1).alias("asctime"),
        F.from_json(m, SERVICE_RECORD_SCHEMA).alias("r"))
    return parsed.where(F.col("r").isNotNull()).select("asctime", "r.*")


def read_service_log(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("asctime", T.StringType())]
                                                      + SERVICE_RECORD_SCHEMA.fields))
    return parse_service_log(spark.read.text(path))


# ---------------------------------------------------------------- A15, A16, W5
def prediction_log_summary(log: DataFrame, class_col: str = "predicted_class") -> DataFrame:
    """Totals by model and by class plus the time range, as (kind, key, n) rows.

    Requests that were rejected stand in the log without a class: their key is ``rejected_request``.
    """
    by_model = log.groupBy("model").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("by_model").alias("kind"), F.col("model").alias("key"), "n")
    by_cls = log.groupBy(class_col).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("by_prediction").alias("kind"), F.coalesce(F.col(class_col), F.lit(REJECTED)).alias("key"), "n")
    tot = log.agg(F.count(F.lit(1)).alias("n"),
                  F.concat_ws(" -> ", F.min("timestamp"), F.max("timestamp")).alias("key")).select(
        F.lit("total").alias("kind"), "key", "n")
    return tot.unionByName(by_model).unionByName(by_cls)


def audit_log_summary(log: DataFrame) -> DataFrame:
    """A15 for the audit log: by event type, by model, date range (dates only)."""
    by_evt = log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("by_event_type").alias("kind"), F.col("event_type").alias("key"), "n")
    by_model = log.groupBy("model").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("by_model").alias("kind"), F.col("model").alias("key"), "n")
    tot = log.agg(F.count(F.lit(1)).alias("n"),
                  F.concat_ws(" -> ", F.substring(F.min("timestamp"), 1, 10),
                              F.substring(F.max("timestamp"), 1, 10)).alias("key")).select(
        F.lit("total_events").alias("kind"), "key", "n")
    return tot.unionByName(by_evt).unionByName(by_model)


def prediction_monitoring(service_log: DataFrame) -> DataFrame:
    """Predictions, rejected requests, distinct endpoints, last model version (by time)."""
    return service_log.agg(
        F.count("prediction").alias("total_predictions"),
        F.count_if(F.col("prediction").isNull()).alias("rejected_requests"),
        F.count_distinct("endpoint").alias("endpoints"),
        F.max_by("model_version", "timestamp").alias("last_model_version"))


def recent_rows(log: DataFrame, n: int = 10, cap: int = 100) -> DataFrame:
    """The last min(n, cap) rows by timestamp (a top-k report), with the totals of the log.

    Ties go to the larger visit, then to the class in text order, then to the larger hash.  Every row carries
    ``total_logged`` (rows of the log) and ``returned`` (rows of the report).
    """
    k = max(0, min(int(n), cap))
    total = log.agg(F.count(F.lit(1)).alias("total_logged"))
    last = log.orderBy(F.desc("timestamp"), F.desc("visit_id"), "predicted_class", F.desc("input_hash")).limit(k)
    return last.crossJoin(F.broadcast(total)).withColumn("returned", F.least(F.col("total_logged"), F.lit(k)))
