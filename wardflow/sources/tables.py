"""Sources and catalog: declared schemas, CSV scan, test-data adapter, views.

S1  declared-schema CSV scan of the three tables
S2  register tables for SQL
S3  view vw_hospital_master (3-way inner join)
S4  view vw_visits_patients (2-way inner join)
S5  run_query
S6  catalog listing
S16 one-call load returning lazy DataFrames
J2  merged frame (visits left join patients, left join billing)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.session import write_table

PATIENTS_SCHEMA = T.StructType([
    T.StructField("patient_id", T.LongType(), False),
    T.StructField("age", T.IntegerType(), False),
    T.StructField("gender", T.StringType(), False),
    T.StructField("city", T.StringType(), False),
    T.StructField("insurance_provider", T.StringType(), True),
    T.StructField("chronic_flag", T.IntegerType(), False),
    T.StructField("registration_date", T.DateType(), False),
])

VISITS_SCHEMA = T.StructType([
    T.StructField("visit_id", T.LongType(), False),
    T.StructField("patient_id", T.LongType(), False),
    T.StructField("visit_date", T.DateType(), False),
    T.StructField("department", T.StringType(), False),
    T.StructField("visit_type", T.StringType(), False),
    T.StructField("length_of_stay_hours", T.DoubleType(), True),
    T.StructField("risk_score", T.StringType(), False),
    T.StructField("doctor_id", T.LongType(), False),
])

BILLING_SCHEMA = T.StructType([
    T.StructField("bill_id", T.LongType(), False),
    T.StructField("visit_id", T.LongType(), False),
    T.StructField("billed_amount", T.DoubleType(), False),
    T.StructField("approved_amount", T.DoubleType(), True),
    T.StructField("claim_status", T.StringType(), False),
    T.StructField("payment_days", T.DoubleType(), True),
    T.StructField("billing_date", T.DateType(), False),
])

PATIENT_COLUMNS = [f.name for f in PATIENTS_SCHEMA.fields]
VISIT_COLUMNS = [f.name for f in VISITS_SCHEMA.fields]
BILLING_COLUMNS = [f.name for f in BILLING_SCHEMA.fields]

# Column order of the merged frame and of vw_hospital_master (20 columns).
MASTER_COLUMNS = [
    "patient_id", "age", "gender", "city", "insurance_provider", "chronic_flag",
    "registration_date", "visit_id", "visit_date", "department", "visit_type",
    "length_of_stay_hours", "risk_score", "doctor_id", "bill_id", "billed_amount",
    "approved_amount", "claim_status", "payment_days", "billing_date",
]
VISITS_PATIENTS_COLUMNS = MASTER_COLUMNS[:6] + MASTER_COLUMNS[7:14]


@dataclass(frozen=True)
class Tables:
    """The three source tables as lazy DataFrames."""

    patients: DataFrame
    visits: DataFrame
    billing: DataFrame
    folder: str | None = None  # where the tables were read from, if from one folder

    @property
    def spark(self) -> SparkSession:
        return self.visits.sparkSession


# --------------------------------------------------------------------------- S1
def read_csv_tables(
    spark: SparkSession,
    patients_path: str,
    visits_path: str,
    billing_path: str,
) -> Tables:
    """Declared-schema CSV scan; empty cells load as NULL (never NaN)."""

    def scan(path: str, schema: T.StructType) -> DataFrame:
        return (
            spark.read.schema(schema)
            .option("header", True)
            .option("dateFormat", "yyyy-MM-dd")
            .option("mode", "FAILFAST")
            .csv(path)
        )

    return Tables(
        patients=scan(patients_path, PATIENTS_SCHEMA),
        visits=scan(visits_path, VISITS_SCHEMA),
        billing=scan(billing_path, BILLING_SCHEMA),
    )


# ------------------------------------------------------------ test-data adapter
def _mod(c: Column, n: int) -> Column:
    return c % F.lit(n)


def patients_from_tpch(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """customer (+ nation name as city) -> patients.

    nation is a fixed 25-row dimension, so Spark's size-checked broadcast
    picks it up; no hint is needed.
    """
    c = customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = nation.select(F.col("n_nationkey"), F.col("n_name"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey, "left")
        .select(
            F.col("c_custkey").alias("patient_id"),
            (F.lit(18) + _mod(F.col("c_custkey"), 73)).cast("int").alias("age"),
            F.when(_mod(F.col("c_custkey"), 2) == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
            F.col("n_name").alias("city"),
            F.col("c_mktsegment").alias("insurance_provider"),
            F.when(F.col("c_acctbal") < 0, F.lit(1)).otherwise(F.lit(0)).cast("int").alias("chronic_flag"),
            F.lit("1995-01-01").cast("date").alias("registration_date"),
        )
    )


def visits_from_tpch(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("visit_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderdate").cast("date").alias("visit_date"),
        F.col("o_orderpriority").alias("department"),
        F.when(_mod(key, 3) == 0, F.lit("ER"))
        .when(_mod(key, 3) == 1, F.lit("ICU"))
        .otherwise(F.lit("OPD")).alias("visit_type"),
        (F.col("o_totalprice") / F.lit(5000.0)).alias("length_of_stay_hours"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Low"))
        .when(F.col("o_orderstatus") == "O", F.lit("Medium"))
        .otherwise(F.lit("High")).alias("risk_score"),
        _mod(key, 200).alias("doctor_id"),
    )


def billing_from_tpch(lineitem: DataFrame) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    price = F.col("l_extendedprice")
    return lineitem.select(
        (F.col("l_orderkey") * F.lit(10) + F.col("l_linenumber")).alias("bill_id"),
        F.col("l_orderkey").alias("visit_id"),
        price.alias("billed_amount"),
        F.when((status == "O") & (flag != "A"), F.lit(None).cast("double"))
        .when(flag == "R", F.lit(0.0))
        .otherwise(price * (F.lit(1.0) - F.col("l_discount"))).alias("approved_amount"),
        F.when(flag == "A", F.lit("Paid"))
        .when(flag == "N", F.lit("Pending"))
        .otherwise(F.lit("Rejected")).alias("claim_status"),
        F.when(flag == "N", F.lit(None).cast("double"))
        .otherwise(F.col("l_quantity").cast("double")).alias("payment_days"),
        F.col("l_shipdate").cast("date").alias("billing_date"),
    )


def from_testdata(spark: SparkSession, sf_dir: str) -> Tables:
    """Map the TPC-H-shaped test tables onto patients / visits / billing."""

    def rd(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    return Tables(
        patients=patients_from_tpch(rd("customer"), rd("nation")),
        visits=visits_from_tpch(rd("orders")),
        billing=billing_from_tpch(rd("lineitem")),
        folder=sf_dir.rstrip("/"),
    )


# ------------------------------------------------------------------ S3, S4, J2
def hospital_master(t: Tables) -> DataFrame:
    """vw_hospital_master: patients JOIN visits JOIN billing (inner)."""
    return (
        t.visits.join(t.patients, "patient_id", "inner")
        .join(t.billing, "visit_id", "inner")
        .select(*MASTER_COLUMNS)
    )


def visits_patients(t: Tables) -> DataFrame:
    """vw_visits_patients: patients JOIN visits (inner), 13 columns."""
    return t.visits.join(t.patients, "patient_id", "inner").select(*VISITS_PATIENTS_COLUMNS)


#: Rows of one key that a single task may hold in ``split_left_join``.
HEAVY_ROWS = 1_000_000


def split_left_join(left: DataFrame, right: DataFrame, key: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """``left.join(right, key, "left")`` where a key may hold any share of the right side.

    AQE cannot split the right side of a left outer join.  One aggregate finds
    the keys with more than ``heavy_rows`` right rows (at most one key for so
    many rows, so their table is small).  Their right rows are dealt over
    salts, their left rows repeated once a salt; they all have a partner, so
    that part is an inner join.  All other rows, unmatched left rows among
    them, are joined as usual.  Rows with a NULL key have no partner.
    """
    heavy = write_table(
        right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_heavy")).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > heavy_rows)
        .select("_heavy", F.ceil(F.col("_n") / F.lit(heavy_rows)).cast("int").alias("_salts")))
    if not heavy.head(1):
        return left.join(right, key, "left")

    def rest(df: DataFrame) -> DataFrame:
        return df.join(heavy, df[key] == heavy["_heavy"], "left_anti")

    def hot(df: DataFrame, salt) -> DataFrame:
        return df.join(heavy, df[key] == heavy["_heavy"]).withColumn("_salt", salt).drop("_heavy", "_salts")

    repeated = hot(left, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    dealt = hot(right, F.floor(F.rand(11) * F.col("_salts")).cast("int"))
    return rest(left).join(rest(right), key, "left").unionByName(repeated.join(dealt, [key, "_salt"]).drop("_salt"))


def merged_frame(t: Tables, heavy_rows: int | None = None) -> DataFrame:
    """Bill-grain analysis frame: visits LEFT JOIN patients LEFT JOIN billing.

    With ``heavy_rows`` the bills of a visit that has more of them are split over tasks.
    """
    visits = t.visits.join(t.patients, "patient_id", "left")
    if heavy_rows is None:
        return visits.join(t.billing, "visit_id", "left").select(*MASTER_COLUMNS)
    return split_left_join(visits, t.billing, "visit_id", heavy_rows).select(*MASTER_COLUMNS)


# ------------------------------------------------------------------ S2, S5, S6
def register_views(t: Tables) -> None:
    """Register the tables and both views for ``spark.sql``."""
    t.patients.createOrReplaceTempView("patients")
    t.visits.createOrReplaceTempView("visits")
    t.billing.createOrReplaceTempView("billing")
    hospital_master(t).createOrReplaceTempView("vw_hospital_master")
    visits_patients(t).createOrReplaceTempView("vw_visits_patients")


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    """Run one report string; display is the caller's business."""
    return spark.sql(sql)


def list_catalog(spark: SparkSession) -> DataFrame:
    """Tables and views of the session catalog (Spark has no indexes)."""
    rows = [(t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    schema = "name string, table_type string, is_temporary boolean"
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------------ S16
def load_all(spark: SparkSession, sf_dir: str | None = None, csv_paths: tuple | None = None,
             register: bool = True) -> dict:
    """One call: tables, views and the merged frame, all lazy."""
    if csv_paths:
        t = read_csv_tables(spark, *csv_paths)
    else:
        t = from_testdata(spark, sf_dir)
    if register:
        register_views(t)
    return {
        "tables": t,
        "patients": t.patients,
        "visits": t.visits,
        "billing": t.billing,
        "master": hospital_master(t),
        "merged": merged_frame(t),
    }
