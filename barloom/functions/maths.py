"""Scalar and conditional operators on panel expressions, and tick rounding."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import safe
from barloom.functions.expr import Expr, apply


def _least(a, b): return F.least(safe.dbl(a), safe.dbl(b))
def _greatest(a, b): return F.greatest(safe.dbl(a), safe.dbl(b))


def less(x, y) -> Expr: return apply(_least, x, y)
def greater(x, y) -> Expr: return apply(_greatest, x, y)


def _log_values(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None or v <= 0 else math.log(v) for v in x.to_pylist()], pa.float64())


def safe_log(x) -> Column:
    """``safe.safe_log`` from the C library, as SQL engines take it.

    Spark's own is off by the last bit for some values, and ranks of differences of logs
    (equal growth, say) then tie elsewhere. Windows after it are dealt again, so operators
    whose last bit no rank sees keep Spark's.
    """
    x = safe.dbl(x)
    return F.coalesce(F.arrow_udf(_log_values, T.DoubleType())(x), safe.safe_log(x))


def log(x) -> Expr: return apply(safe_log, x)
def absolute(x) -> Expr: return apply(F.abs, x)


def _sign(x): return F.when(x > 0, F.lit(1.0)).when(x < 0, F.lit(-1.0)).otherwise(F.lit(0.0))


def sign(x) -> Expr:
    """-1, 0 or 1; null counts as 0."""
    return apply(_sign, x)


def _choose(t, x, a, b): return F.when(t < x, safe.dbl(a)).otherwise(safe.dbl(b))


def quesval(threshold, x, a, b) -> Expr:
    """a where threshold < x, else b (a null comparison gives b)."""
    return apply(_choose, threshold, x, a, b)


def quesval2(threshold, x, a, b) -> Expr:
    """Like quesval with a per-row threshold."""
    return apply(_choose, threshold, x, a, b)


def _signed_power(x, e):
    x, e = safe.dbl(x), safe.dbl(e)
    return (
        F.when(x > 0, F.pow(x, e)).when(x < 0, -F.pow(F.abs(x), e)).otherwise(F.lit(0.0))
    )


def pow1(x, exponent) -> Expr:
    """Sign-keeping power; zero and null give 0."""
    return apply(_signed_power, x, exponent)


def _power_by_row(x, y):
    x, y = safe.dbl(x), safe.dbl(y)
    whole = safe.float_floor(y) == y
    return (
        F.when(x > 0, F.pow(x, y))
        .when((x < 0) & whole, -F.pow(F.abs(x), y))
        .otherwise(F.lit(0.0))
    )


def pow2(x, y) -> Expr:
    """Power with a per-row exponent; a negative base needs a whole exponent."""
    return apply(_power_by_row, x, y)


# ------------------------------------------------------------ tick rounding
def _ticks(value: Column, tick) -> Column:
    """Exact decimal quotient, so 0.3 / 0.1 is 3 and not 2.999..."""
    return F.try_divide(value.cast("decimal(28,10)"), F.lit(str(tick)).cast("decimal(18,8)"))


def _back(count: Column, tick) -> Column:
    return (count.cast("decimal(28,0)") * F.lit(str(tick)).cast("decimal(18,8)")).cast("double")


def round_to(value: Column, tick) -> Column:
    """Nearest multiple of tick, halves to even."""
    return _back(F.bround(_ticks(value, tick), 0), tick)


def floor_to(value: Column, tick) -> Column:
    return _back(F.floor(_ticks(value, tick)), tick)


def ceil_to(value: Column, tick) -> Column:
    return _back(F.ceil(_ticks(value, tick)), tick)
