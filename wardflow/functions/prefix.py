"""Distributed ordering helpers: running totals and row numbers.

A plain ``Window.partitionBy(key).orderBy(x)`` puts every row of a key into
one task.  Both helpers here sort with Spark's range partitioning instead
(sampled bounds split a hot key's value range over many partitions), fix
that order with a checkpoint, and combine

* a small per-partition table (partitions x keys rows) prefix-summed to
  give each partition its offset, and
* the position / running sum inside each partition (bounded by partition
  size, which range partitioning keeps even).

``monotonically_increasing_id`` carries the partition index in its upper
31 bits and the row's position inside the partition in the lower 33 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wardflow.session import cut_lineage

_LOW33 = (1 << 33) - 1


def _sorted_with_position(df: DataFrame, order_cols: list) -> DataFrame:
    # the eager checkpoint counts, then writes: keep the sorted partitions (memory,
    # spilling to disk) between the two so the sort stage runs once
    ordered = df.orderBy(*order_cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fixed = cut_lineage(ordered)
    finally:
        ordered.unpersist()
    s = fixed.withColumn("_mid", F.monotonically_increasing_id())
    return s.withColumn("_pid", F.shiftright("_mid", 33).cast("int")) \
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW33))).drop("_mid")


def row_numbers(df: DataFrame, order_cols: list, out: str = "row_number") -> DataFrame:
    """0-based global row number in ``order_cols`` order (ties broken arbitrarily, exactly once)."""
    s = _sorted_with_position(df, order_cols)
    sizes = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_sz"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_sz").over(w), F.lit(0))).drop("_sz")
    return s.join(F.broadcast(offs), "_pid").withColumn(out, F.col("_off") + F.col("_pos")) \
        .drop("_pid", "_pos", "_off")


def totals_before(df: DataFrame, keys: list[str], order_col: str, sum_cols: list[str],
                  buckets: int | None = None) -> DataFrame:
    """Add ``{c}_before`` = sum of ``c`` over rows of the same key with a strictly
    smaller ``order_col``.  ``df`` must hold one row per (keys, order_col)."""
    keys = list(keys)
    s = _sorted_with_position(df, [*keys, order_col])
    part = s.groupBy("_pid", *keys).agg(*[F.sum(c).alias(f"_ps_{c}") for c in sum_cols])
    wk = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("_pid", *keys, *[F.coalesce(F.sum(f"_ps_{c}").over(wk), F.lit(0)).alias(f"_po_{c}")
                                        for c in sum_cols])
    wp = Window.partitionBy("_pid", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    out = s.join(part, ["_pid", *keys])
    for c in sum_cols:
        out = out.withColumn(f"{c}_before", F.col(f"_po_{c}") + F.coalesce(F.sum(c).over(wp), F.lit(0)))
    return out.drop("_pid", "_pos", *[f"_po_{c}" for c in sum_cols])
