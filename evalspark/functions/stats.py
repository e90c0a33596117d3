"""Normal quantile, Wilson intervals and percentile helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The published coefficients of Acklam's rational approximation.
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425


def _horner(coefficients: tuple[float, ...], x: float, last: float | None = None) -> float:
    total = 0.0
    for c in coefficients if last is None else (*coefficients, last):
        total = total * x + c
    return total


def normal_ppf(p: float) -> float:
    """The standard normal quantile, unrefined (about 1e-9 relative); ValueError outside (0, 1)."""
    if not 0.0 < p < 1.0:
        raise ValueError(f"quantile of {p} is not defined")
    tail = min(p, 1.0 - p)
    if tail < TAIL:
        q = math.sqrt(-2.0 * math.log(tail))
        value = _horner(TAIL_TOP, q) / _horner(TAIL_BOTTOM, q, 1.0)
        return value if p < 0.5 else -value
    q = p - 0.5
    r = q * q
    return q * _horner(CENTRE_TOP, r) / _horner(CENTRE_BOTTOM, r, 1.0)


def z_value(confidence: float) -> float:
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must lie between 0 and 1")
    return normal_ppf(0.5 + confidence / 2.0)


def wilson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Both ends of the Wilson score interval; (0, 1) for n = 0, an error unless 0 <= k <= n."""
    z = z_value(confidence)
    z2 = z * z
    trials = F.when(n > 0, n.cast("double"))
    rate = k / trials
    scale = 1.0 + z2 / trials
    middle = (rate + z2 / (2.0 * trials)) / scale
    reach = (z / scale) * F.sqrt(rate * (1.0 - rate) / trials + z2 / (4.0 * trials * trials))
    bad = (k < 0) | (k > n)

    def end(value: Column, empty: float) -> Column:
        inside = F.when(n == 0, F.lit(empty)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
        return F.when(bad, F.raise_error(F.lit("successes must lie between 0 and trials")).cast("double")).otherwise(inside)

    return end(middle - reach, 0.0), end(middle + reach, 1.0)


def wilson_interval(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """The same interval for two numbers on the driver."""
    if n < 0 or not 0 <= k <= n:
        raise ValueError("successes must lie between 0 and trials")
    if not n:
        return 0.0, 1.0
    z = z_value(confidence)
    rate, scale = k / n, 1.0 + z * z / n
    middle = (rate + z * z / (2.0 * n)) / scale
    reach = (z / scale) * math.sqrt(rate * (1.0 - rate) / n + z * z / (4.0 * n * n))
    return max(0.0, middle - reach), min(1.0, middle + reach)


def percentile(value: Column, q: float) -> Column:
    """Exact percentile with linear interpolation over non-null values; 0.0 when there are none."""
    return F.coalesce(F.percentile(value, F.lit(q)), F.lit(0.0))


def register_sql(spark: SparkSession, confidence: float = 0.95) -> None:
    """Temporary SQL functions ``wilson_low(k, n)`` and ``wilson_high(k, n)``; Catalyst inlines them."""
    z = z_value(confidence)
    z2 = z * z
    for name, sign, empty in (("wilson_low", "-", 0.0), ("wilson_high", "+", 1.0)):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(k BIGINT, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n = 0 THEN {empty}D ELSE greatest(0D, least(1D, "
            f"(k / CAST(n AS DOUBLE) + {z2}D / (2D * n)) / (1D + {z2}D / n) {sign} ({z}D / (1D + {z2}D / n)) * "
            f"sqrt(k / CAST(n AS DOUBLE) * (1D - k / CAST(n AS DOUBLE)) / n + {z2}D / (4D * n * n)))) END"
        )
