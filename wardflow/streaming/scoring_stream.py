"""Structured Streaming re-aims of the per-request service.

T1: request files arriving in a folder are validated, featurized, scored
and written to the prediction log.  Each micro-batch overwrites its own
``epoch=N`` folder of the log and of the quarantine, so a batch that is
replayed after a failure replaces its rows instead of repeating them.  The
logs are gzip-packed JSON lines, which every reader here takes as they are.
T2: class mix per event-time window with a watermark, so late rows inside
the watermark still count and state for old windows is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from wardflow.operators.models import predict
from wardflow.operators.scoring import CLAIM_REQUEST_BOUNDS, input_hash, request_errors, scoring_features
from wardflow.sources.logs import PREDICTION_LOG_SCHEMA

#: The claim rules on the fields that this feed carries or E9 derives (frozen defaults are not checked).
CLAIM_FEED_BOUNDS = {k: v for k, v in CLAIM_REQUEST_BOUNDS.items() if k != "patient_visit_frequency"}

CLAIM_REQUEST_SCHEMA = T.StructType([
    T.StructField("visit_id", T.LongType()), T.StructField("patient_id", T.LongType()),
    T.StructField("visit_date", T.StringType()), T.StructField("registration_date", T.StringType()),
    T.StructField("age", T.IntegerType()), T.StructField("chronic_flag", T.IntegerType()),
    T.StructField("department", T.StringType()), T.StructField("visit_type", T.StringType()),
    T.StructField("gender", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("insurance_provider", T.StringType()),
    T.StructField("length_of_stay_hours", T.DoubleType()), T.StructField("billed_amount", T.DoubleType()),
    T.StructField("approved_amount", T.DoubleType()), T.StructField("payment_days", T.DoubleType()),
])


def t1_score_request_stream(spark: SparkSession, request_dir: str, model, classes: list[str],
                            maps: dict, bounds: dict, categories: list[str], log_dir: str,
                            checkpoint: str, model_name: str = "model", version: str = "v1",
                            schema: T.StructType = CLAIM_REQUEST_SCHEMA,
                            available_now: bool = True, files_per_batch: int = 1000,
                            scorer: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Score request JSON files as they land; log valid scores and quarantine the rest.

    A rule on a field that the feed neither carries nor derives is an error.
    ``scorer`` adds ``predicted_class`` and ``confidence`` to feature rows; without
    it they come from the pipeline ``model``.
    """
    scorer = scorer or (lambda rows: predict(model, rows, classes))
    known = scoring_features(spark.createDataFrame([], schema), maps).columns
    if unknown := sorted((set(bounds) | set(categories)) - set(known)):
        raise ValueError(f"rules on fields that the feed does not have: {unknown}")
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(request_dir)

    def batch(df: DataFrame, epoch_id: int) -> None:
        feats = scoring_features(df, maps)
        checked = feats.withColumn("errors", request_errors(bounds, categories, maps))
        # both outputs read the batch's features and hash, which are computed once
        checked = checked.withColumn("input_hash", input_hash(checked, schema.fieldNames())).persist(
            StorageLevel.MEMORY_AND_DISK)
        try:
            scorer(checked.where(F.size("errors") == 0)).select(
                F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                F.lit(model_name).alias("model"), F.col("visit_id").cast("long"), "predicted_class",
                "confidence", F.lit(version).alias("model_version"), "input_hash") \
                .write.mode("overwrite").option("compression", "gzip").json(f"{log_dir}/predictions/epoch={epoch_id}")
            checked.where(F.size("errors") > 0).select("visit_id", "errors") \
                .write.mode("overwrite").option("compression", "gzip").json(f"{log_dir}/quarantine/epoch={epoch_id}")
        finally:
            checked.unpersist()

    writer = raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def class_mix(df: DataFrame, ts_col: str, class_col: str, window: str = "1 day") -> DataFrame:
    """Batch form of T2: rows and share per (window, class)."""
    counts = df.groupBy(F.window(ts_col, window).alias("w"), F.col(class_col).alias("class_name")).agg(
        F.count(F.lit(1)).alias("n"))
    tot = counts.groupBy("w").agg(F.sum("n").alias("_tot"))
    return counts.join(tot, "w").select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "class_name", "n",
        F.round(F.col("n") * 100.0 / F.col("_tot"), 2).alias("share_pct"))


def t2_class_mix_stream(stream: DataFrame, ts_col: str, class_col: str, window: str = "1 day",
                        watermark: str = "1 day") -> DataFrame:
    """Streaming T2: class counts and shares per closed window (append mode).

    A window's counts are kept as a map from class to count (bounded by the
    classes), so the share needs no second aggregation of the stream.
    """
    per_class = (
        stream.withWatermark(ts_col, watermark)
        .groupBy(F.window(ts_col, window).alias("w"), F.col(class_col).alias("class_name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = per_class.groupBy("w").agg(F.collect_list(F.struct("class_name", "n")).alias("c"), F.sum("n").alias("t"))
    return totals.select("w", "t", F.explode("c").alias("c")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "c.class_name", "c.n",
        F.round(F.col("c.n") * 100.0 / F.col("t"), 2).alias("share_pct"))


QUARANTINE_SCHEMA = "visit_id long, errors array<string>"


def stream_summary(spark: SparkSession, log_dir: str) -> DataFrame:
    """(outcome, key, n) of a scored feed: predictions by class, quarantined rows, and their errors by rule."""
    scored = spark.read.schema(PREDICTION_LOG_SCHEMA).json(f"{log_dir}/predictions")
    held = spark.read.schema(QUARANTINE_SCHEMA).json(f"{log_dir}/quarantine")
    one = F.count(F.lit(1)).alias("n")
    errors = held.select(F.explode("errors").alias("e")).select(F.regexp_replace("e", " value .*$", "").alias("key"))
    return (scored.groupBy(F.lit("prediction").alias("outcome"), F.col("predicted_class").alias("key")).agg(one)
            .unionByName(held.groupBy(F.lit("quarantine").alias("outcome"), F.lit("rows").alias("key")).agg(one))
            .unionByName(errors.groupBy(F.lit("error").alias("outcome"), "key").agg(one)))
