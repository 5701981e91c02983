"""SMOTE oversampling (E11) as a Spark job.

Every class is raised to the majority count with synthetic rows
``x + gap * (neighbour - x)``:

1. a row makes ``floor(need / n) (+1 for the first need mod n rows in hash
   order)`` synthetic rows, so per-class totals are exact;
2. each row that makes one gets its k nearest rows of the same class, over
   standardized features, from ``operators.neighbors``: by real distance from
   every row of the class where few rows make one, else from rank windows of
   several projections, refined over neighbours of neighbours (exact where a
   class fits one window); the neighbour and the gap are drawn from
   ``xxhash64`` of (row id, draw, seed), and the drawn neighbour's values are
   joined by its id;
3. a row without a neighbour (the only one of its class) is repeated as it is.

NULL features count as the mean for distances and stay NULL in synthetic rows.
Counts equal the original's; the draws differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.functions.prefix import totals_before
from wardflow.operators.neighbors import FEW, nearest_of, nearest_rows
from wardflow.session import write_table


def _unit(h):
    """Hash -> uniform [0, 1)."""
    return (F.pmod(h, F.lit(1 << 31)).cast("double")) / F.lit(float(1 << 31))


def smote(df: DataFrame, features: list[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Return ``df`` (features + label) plus synthetic minority rows; adds ``synthetic``."""
    base = df.select(*[F.col(f).cast("double").alias(f) for f in features], label) \
        .where(F.col(label).isNotNull())
    base = write_table(base.withColumn("_rid", F.monotonically_increasing_id()))  # stable ids

    counts = base.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    n_max = counts.agg(F.max("_n").alias("_nmax"))
    need = write_table(counts.crossJoin(n_max).withColumn("_need", F.col("_nmax") - F.col("_n"))
                       .where(F.col("_need") > 0).select(label, "_n", "_need"))  # a row a class

    stats = write_table(base.agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features],
        *[F.coalesce(F.nullif(F.stddev_samp(f), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{f}") for f in features]))
    # rows of the written base, with a class and a row of parameters beside them: not written again
    minority = base.join(F.broadcast(need), label).withColumn("_x", F.array(*[F.col(f) for f in features])) \
        .withColumn("_h", F.xxhash64("_rid", F.lit(seed)))
    scaled = F.array(*[F.coalesce((F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}"), F.lit(0.0)) for f in features])
    vectors = minority.crossJoin(F.broadcast(stats)).select(F.col(label).alias("grp"), F.col("_rid").alias("id"), scaled.alias("x"))

    per_row = write_table(_drawing_rows(minority, need, label).select(label, "_rid", "_x", "_m"))
    few = per_row.count() <= FEW
    if few:
        partners = nearest_of(vectors.join(F.broadcast(per_row.select(F.col("_rid").alias("id"))), "id", "left_semi"), vectors, k)
    else:
        partners = nearest_rows(vectors, k, seed=seed)
    per_row = per_row.join(partners.select(F.col("id").alias("_rid"), F.col("near.id").alias("_nbrs")), "_rid", "left")
    drawn = (
        per_row.select(label, "_rid", "_x", "_nbrs", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_j"))
        .withColumn("_pick", F.when(F.size("_nbrs") > 0, F.element_at("_nbrs", (
            F.pmod(F.xxhash64("_rid", "_j", F.lit(seed)), F.size("_nbrs")) + 1).cast("int"))))
        .withColumn("_gap", _unit(F.xxhash64("_rid", "_j", F.lit(seed + 1))))
    )
    values = minority.select(F.col("_rid").alias("_pick"), F.col("_x").alias("_y"))
    if few:  # only the drawn neighbours' values are exchanged
        drawn = write_table(drawn)
        values = values.join(F.broadcast(drawn.select("_pick").distinct()), "_pick", "left_semi")
    # rows without a neighbour keep a key of their own, so that they do not meet in one task
    synth = (
        drawn.withColumn("_pick", F.coalesce("_pick", -F.col("_rid") - 1)).join(values, "_pick", "left")
        .withColumn("_new", F.zip_with("_x", F.coalesce("_y", "_x"), lambda a, b: a + F.col("_gap") * (b - a)))
    )
    synth_rows = synth.select(*[F.col("_new")[i].alias(f) for i, f in enumerate(features)], label,
                              F.lit(True).alias("synthetic"))
    return base.select(*features, label, F.lit(False).alias("synthetic")).unionByName(synth_rows)


def _drawing_rows(minority: DataFrame, need: DataFrame, label: str) -> DataFrame:
    """Rows that make a synthetic row, with their number ``_m``: ``_need`` dealt over the ``_n`` rows of a class.

    The first ``need mod n`` rows in the order of ``_h`` make one more.  Hashes are even, so only those up to a
    bound that holds these rows are put in order; should one class hold too few of them, all its rows are.
    """
    more = F.col("_need") % F.col("_n")
    span = F.least((more + 10 * F.sqrt(more) + 100) / F.col("_n"), F.lit(1.0))
    bound = F.when(span >= 1, F.lit(2**63 - 1)).otherwise((span * F.lit(2.0**64) - F.lit(2.0**63)).cast("long"))
    low = minority.withColumn("_more", more).where(more > 0).select(label, "_rid", "_h", "_more", (F.col("_h") <= bound).alias("_in"))
    held = low.where("_in").groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    asked = need.select(label, more.alias("_more")).where("_more > 0")
    short = asked.join(held, label, "left").where(F.coalesce("_c", F.lit(0)) < F.col("_more")).head(1)
    first = write_table(low if short else low.where("_in"))
    order = totals_before(first.groupBy(label, "_h").agg(F.count(F.lit(1)).alias("_c")), [label], "_h", ["_c"])
    extra = write_table(first.join(order.select(label, "_h", "_c_before"), [label, "_h"])
                        .where(F.col("_c_before") < F.col("_more")).select("_rid", F.lit(1).alias("_one")))
    extra = F.broadcast(extra) if extra.count() <= FEW else extra
    return minority.join(extra, "_rid", "left").withColumn(
        "_m", (F.floor(F.col("_need") / F.col("_n")) + F.coalesce("_one", F.lit(0))).cast("int")).where(F.col("_m") > 0)
