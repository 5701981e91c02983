"""Scalar column helpers (F1-F18).  All built-in JVM expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardflow import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """ROUND(part * 100.0 / whole, digits) as DOUBLE; NULL when whole is 0."""
    return F.round(F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double")), digits)


def ratio(num: Column, den: Column) -> Column:
    """num / NULLIF(den, 0) in double (F2); ANSI-safe."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def flag_sum(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as BIGINT."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def is_blank(c: Column) -> Column:
    """NULL or empty after trimming."""
    return c.isNull() | (F.trim(c) == F.lit(""))


def weekday_monday0(d: Column) -> Column:
    """day of week with Monday = 0 (pandas dayofweek)."""
    return F.weekday(d)


def year_month(d: Column) -> Column:
    """'yyyy-MM' period string."""
    return F.date_format(d, "yyyy-MM")


def clip(c: Column, lower: Column | float | None = None, upper: Column | float | None = None) -> Column:
    """pandas-style clip that keeps NULL as NULL."""
    out = c
    if lower is not None:
        lo = lower if isinstance(lower, Column) else F.lit(float(lower))
        out = F.when(out.isNull(), out).when(out < lo, lo).otherwise(out)
    if upper is not None:
        hi = upper if isinstance(upper, Column) else F.lit(float(upper))
        out = F.when(out.isNull(), out).when(out > hi, hi).otherwise(out)
    return out


def map_lookup(mapping: dict, c: Column, value_type: str | None = None) -> Column:
    """Literal map lookup; a miss gives NULL."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    m = F.create_map(*pairs)
    out = F.try_element_at(m, c)
    return out.cast(value_type) if value_type else out


def decode(mapping: dict, code: Column) -> Column:
    """code -> label using the inverse of an encoding map."""
    return map_lookup({v: k for k, v in mapping.items()}, code)


def psi_status(psi: Column) -> Column:
    """PSI label by the 0.10 / 0.25 thresholds."""
    return (
        F.when(psi < F.lit(K.PSI_NO_CHANGE), F.lit("Stable"))
        .when(psi < F.lit(K.PSI_SIGNIFICANT), F.lit("Moderate Drift"))
        .otherwise(F.lit("Significant Drift"))
    )


def rejection_action(rejection_risk_pct: Column) -> Column:
    """rejection-risk percent -> recommended action text."""
    (hi, hi_txt), (mid, mid_txt), (_, lo_txt) = K.REJECTION_RISK_BANDS
    return (
        F.when(rejection_risk_pct >= F.lit(hi), F.lit(hi_txt))
        .when(rejection_risk_pct >= F.lit(mid), F.lit(mid_txt))
        .otherwise(F.lit(lo_txt))
    )


def model_version(prefix: str = "v", clock: Column | None = None) -> Column:
    """'v%Y%m%d' of the given clock (default current_date)."""
    d = clock if clock is not None else F.current_date()
    return F.concat(F.lit(prefix), F.date_format(d, "yyyyMMdd"))


def iso_timestamp(clock: Column | None = None) -> Column:
    """ISO-8601 text of a timestamp."""
    ts = clock if clock is not None else F.current_timestamp()
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def argmax_label(probs: Column, labels: list[str]) -> tuple[Column, Column]:
    """(label, confidence rounded to 4) of an array of probabilities.

    ``array_position`` returns the first maximum, matching numpy argmax on
    ties.
    """
    idx = F.array_position(probs, F.array_max(probs))
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), idx.cast("int"))
    return lab, F.round(F.array_max(probs), 4)
