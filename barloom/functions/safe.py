"""Floating-point helpers that keep IEEE results under Spark's ANSI mode.

Spark raises on ``x / 0`` (ANSI) or yields NULL (legacy); panel arithmetic wants
inf and NaN. Every helper below gives the same value in both modes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def dbl(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def safe_div(a, b) -> Column:
    """IEEE division: x/0 is +-inf, 0/0 is NaN, null in gives null out."""
    a, b = dbl(a), dbl(b)
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def safe_log(x) -> Column:
    """Natural log with log(0) = -inf and log(negative) = NaN."""
    x = dbl(x)
    return F.coalesce(F.log(x), F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)))


def float_floor(x) -> Column:
    """Floor that stays a double and passes NaN and infinity through."""
    x = dbl(x)
    return F.when(F.abs(x) < 9e15, F.floor(x).cast("double")).otherwise(x)


def floor_div(a, b) -> Column:
    return float_floor(safe_div(a, b))


def floor_mod(a, b) -> Column:
    """Modulo with the sign of the divisor; a % 0 is NaN."""
    a, b = dbl(a), dbl(b)
    return F.when(b == 0, a * F.lit(NAN)).otherwise(a - b * float_floor(safe_div(a, b)))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def inf_to_null(x: Column) -> Column:
    return F.when(F.abs(x) != INF, x)


def finite(x: Column) -> Column:
    """The value when finite, else null."""
    return F.when(F.abs(x) < INF, x)


def skipnull_mean(*cols: Column) -> Column:
    """Row-wise mean over the non-null columns (null if all are null)."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    count = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.when(count > 0, F.try_divide(total, count))
