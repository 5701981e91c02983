"""Session construction and lineage-cut helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "wardflow",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Session tuned for the analytics jobs.

    AQE stays on so join strategy, partition coalescing and skew splitting
    are decided at run time from real shuffle sizes; broadcast joins are
    left to Spark's size-checked ``autoBroadcastJoinThreshold`` (plus AQE's
    runtime conversion) instead of unconditional hints.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage configured by the
    cluster; only a local-mode session (tests, laptops) gets a private
    scratch folder when the setting is absent.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; configure a shared folder for the cluster"
            )
        path = tempfile.mkdtemp(prefix="wardflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local).

    Used where one derived frame feeds many jobs (the bill-grain merged
    frame feeds every parameter job of the feature pipeline): the upstream
    joins run once, later plans start from a file scan, and a lost executor
    re-reads the checkpoint files instead of recomputing the joins.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """An unused path under the shared checkpoint folder; the next ``cuts`` block to end deletes it."""
    path = os.path.join(checkpoint_dir(spark), kind, uuid.uuid4().hex)
    _written.append(path)
    return path


def write_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    The cut used where row order does not matter: one job (a reliable
    ``checkpoint`` runs its last stage twice, once to count and once to
    write), a columnar copy that later scans prune, and file sizes the
    planner and AQE use for their join choices.  A lost executor re-reads
    the files instead of recomputing the upstream joins.
    """
    spark = df.sparkSession
    path = new_folder(spark, "tables")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


materialize = write_table


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: str) -> Iterator[None]:
    """Python stages that run inside the block get Arrow batches of at most ``rows`` rows and about ``size`` bytes.

    An executor and its Python workers hold a batch several times over (vectors,
    stream, copy), so wide rows need fewer of them than Spark's 10,000.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Paths handed out so far that no ``cuts`` block has deleted.
_written: list[str] = []


@contextmanager
def cuts(spark: SparkSession) -> Iterator[None]:
    """Owner of the intermediate tables that are written inside the block.

    They are deleted when it ends, so consume the results inside::

        with cuts(spark):
            query(spark, folder).write.parquet(target)
    """
    mark = len(_written)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in _written[mark:]:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        del _written[mark:]
