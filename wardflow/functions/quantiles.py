"""Exact quantiles (linear interpolation) as a distributed rank selection.

Spark's exact ``percentile`` aggregate keeps every distinct value of a
group in one task's memory at the final merge, which does not hold when
one group has a third of 100 TB.  This helper stays exact without that,
and no exchange carries the values themselves until few are left:

1. one partial aggregate gives each key's count, minimum and maximum;
2. the wanted 0-based ranks are ``floor(h)`` and ``ceil(h)`` with
   ``h = (n - 1) * p``; each starts with the key's [min, max] range;
3. while a rank's range still holds more than ``max_window_rows`` rows and
   more than one value, the rows are counted into ``buckets`` slices of the
   range (partial aggregation: a ranges x buckets table is all that is
   shuffled), slice counts are prefix-summed, and the range shrinks to the
   exact [min, max] of the slice holding the rank.  Slices are equal in
   width and, in every second round, equal in ratio where a range's ends are
   more than a factor of two apart, so a range over many decades narrows as
   surely as a dense one, and one of a few neighbouring doubles loses no round.
   Ranks that share a range share one slice count;
4. the rows of the small ranges are collapsed and ordered (one window per
   range, at most ``max_window_rows`` rows) to read the exact values; a
   range of one value needs no rows;
5. ``v[lo] + (v[hi] - v[lo]) * frac`` (numpy / pandas / DuckDB
   ``quantile_cont``).

The input is scanned once for the statistics, once a round (one round for
up to ``buckets * max_window_rows`` evenly spread rows) and once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.session import write_table

#: Far above what 64-bit floats can need (12 bits a round); more is an error.
MAX_ROUNDS = 32
_LARGEST = 1.7976931348623157e308


def _finite(x: Column) -> Column:
    """Half of ``x`` with infinities pulled in, so differences stay finite."""
    return F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST)) / 2


def _ratio_scale(x: Column) -> Column:
    """A monotone scale on which equal steps are equal ratios."""
    size = F.abs(_finite(x))
    return F.when(size <= 1e-300, 0.0).otherwise(F.signum(x) * (F.log(size) + 700.0))


def _slice(v: Column, lo: Column, hi: Column, buckets: int, scale) -> Column:
    width = scale(hi) - scale(lo)
    at = F.floor((scale(v) - scale(lo)) / width * buckets)
    return F.when(width > 0, F.greatest(F.least(at, F.lit(buckets - 1)), F.lit(0))).otherwise(F.lit(0)).cast("int")


def _slice_of_round(rnd: int, buckets: int) -> Column:
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    even = _slice(v, lo, hi, buckets, _finite)
    if rnd % 2 == 0:
        return even
    # the ratio scale cannot tell neighbouring doubles apart
    narrow = ((lo > 0) & (hi <= 2 * lo)) | ((hi < 0) & (lo >= 2 * hi))
    return F.when(narrow, even).otherwise(_slice(v, lo, hi, buckets, _ratio_scale))


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    buckets: int = 4096,
    prefix: str = "q",
    max_window_rows: int = 65_536,
) -> DataFrame:
    """One row per key with columns ``{prefix}0 .. {prefix}{len(probs)-1}`` and ``n``.

    NULL / NaN values are ignored (pandas ``quantile`` on ``dropna``).  Keys
    without values are absent.  ``df`` is scanned a few times: pass a written
    table or a cheap projection.  Joins with the keys x ranks state table are
    left to the planner, which knows its written size.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    stats = write_table(rows.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("n")))
    wanted = stats.select(
        *keys, "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_pi", "_p"),
    ).withColumn("_h", (F.col("n") - 1) * F.col("_p"))
    ranks = wanted.select(
        *keys, F.explode(F.array(F.floor("_h").cast("long"), F.ceil("_h").cast("long"))).alias("_r"),
    ).distinct()
    state = write_table(ranks.join(stats, keys).select(
        *keys, "_r", "_lo", "_hi", F.lit(0).cast("long").alias("_off"), F.col("n").alias("_rows")))

    seg_cols = [*keys, "_lo", "_hi", "_off"]
    is_open = (F.col("_rows") > max_window_rows) & (F.col("_lo") < F.col("_hi"))
    for rnd in range(MAX_ROUNDS + 1):
        if not state.where(is_open).head(1):
            break
        if rnd == MAX_ROUNDS:
            raise RuntimeError(f"quantile ranges did not narrow in {MAX_ROUNDS} rounds")
        # ranks sharing a range share one slice count (all ranks of a key in round 1)
        seg = state.where(is_open).select(*seg_cols).distinct()
        bc = (
            rows.join(seg, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            .withColumn("_b", _slice_of_round(rnd, buckets))
            .groupBy(*seg_cols, "_b").agg(
                F.count(F.lit(1)).alias("_bn"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax"))
        )
        wb = Window.partitionBy(*seg_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        bc = bc.withColumn("_before", F.col("_off") + F.coalesce(F.sum("_bn").over(wb), F.lit(0)))
        narrowed = (
            state.where(is_open).select(*seg_cols, "_r").join(bc, seg_cols)
            .where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_bn")))
            .select(*keys, "_r", F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"),
                    F.col("_before").alias("_off"), F.col("_bn").alias("_rows"))
        )
        state = write_table(state.where(~is_open).unionByName(narrowed))

    # one ordered window per remaining range of several values (at most max_window_rows rows)
    several = F.col("_lo") < F.col("_hi")
    wv = Window.partitionBy(*seg_cols).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    in_range = (
        rows.join(state.where(several).select(*seg_cols).distinct(), keys)
        .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*seg_cols, "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_start", F.col("_off") + F.coalesce(F.sum("_c").over(wv), F.lit(0)))
    )
    located = write_table(
        state.where(several).select(*seg_cols, "_r").join(in_range, seg_cols)
        .where((F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_start") + F.col("_c")))
        .select(*keys, "_r", "_v")
        .unionByName(state.where(~several).select(*keys, "_r", F.col("_lo").alias("_v")))
    )
    lo = located.select(*keys, F.col("_r").alias("_rlo"), F.col("_v").alias("_vlo"))
    hi = located.select(*keys, F.col("_r").alias("_rhi"), F.col("_v").alias("_vhi"))
    vals = (
        wanted.select(*keys, "n", "_pi", "_h", F.floor("_h").cast("long").alias("_rlo"),
                      F.ceil("_h").cast("long").alias("_rhi"))
        .join(lo, [*keys, "_rlo"], "left")
        .join(hi, [*keys, "_rhi"], "left")
    )
    frac = F.col("_h") - F.floor("_h")
    q = vals.withColumn("_q", F.when(frac == 0, F.col("_vlo")).otherwise(
        F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac))
    agg = [F.max(F.when(F.col("_pi") == i, F.col("_q"))).alias(f"{prefix}{i}") for i in range(len(probs))]
    return q.groupBy(*keys, "n").agg(*agg)
