"""Per-symbol window operators (bars in time order inside one symbol)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import safe
from barloom.functions.expr import Expr, apply, bar_index, roll, shift


def _when_full(value, count, n): return F.when(count == n, value)


def _full(value: Expr, x, n: int) -> Expr:
    """``value`` only where the last n bars all hold a non-null x."""
    return apply(_when_full, value, roll("count", x, lo=1 - n), n)


def ts_delay(x, n: int) -> Expr:
    """Value n bars ago; negative n looks ahead (labels)."""
    return shift(x, n)


def ts_delta(x, n: int) -> Expr:
    return x - shift(x, n)


def ts_min(x, n: int) -> Expr: return roll("min", x, lo=1 - n)
def ts_max(x, n: int) -> Expr: return roll("max", x, lo=1 - n)
def ts_mean(x, n: int) -> Expr: return roll("avg", x, lo=1 - n)
def ts_std(x, n: int) -> Expr: return roll("stddev_pop", x, lo=1 - n)
def ts_sum(x, n: int) -> Expr: return _full(roll("sum", x, lo=1 - n), x, n)
def ts_product(x, n: int) -> Expr: return _full(roll("product", x, lo=1 - n), x, n)


def ts_frame(x, n: int) -> Expr:
    """The last n values, oldest first (null unless all n are present)."""
    return _full(roll("list", x, lo=1 - n), x, n)


def _position(values, best): return F.array_position(values, best).cast("double")


def ts_argmax(x, n: int) -> Expr:
    """1-based position of the maximum from the oldest bar; oldest tie wins."""
    return apply(_position, ts_frame(x, n), ts_max(x, n))


def ts_argmin(x, n: int) -> Expr:
    return apply(_position, ts_frame(x, n), ts_min(x, n))


def _rank_in_frame(values, v, n):
    less = F.size(F.filter(values, lambda e: e < v))
    equal = F.size(F.filter(values, lambda e: e == v))
    return F.when(values.isNotNull(), (less + (equal + 1) / F.lit(2.0)) / n)


def ts_rank(x, n: int) -> Expr:
    """(values below + (ties + 1) / 2) / n over a full window."""
    return apply(_rank_in_frame, ts_frame(x, n), x, float(n))


def _interpolate(values, pos):
    ordered = F.array_sort(values)
    base = F.floor(pos)
    low, high = F.element_at(ordered, (base + 1).cast("int")), F.element_at(ordered, (F.ceil(pos) + 1).cast("int"))
    return low + (high - low) * (pos - base)


def ts_quantile(x, n: int, q: float) -> Expr:
    return apply(_interpolate, ts_frame(x, n), float((n - 1) * q))


def _weighted_age(values, n):
    total = F.aggregate(
        F.zip_with(values, F.sequence(n.cast("int"), F.lit(1)), lambda v, w: v * w),
        F.lit(0.0), lambda acc, v: acc + v,
    )
    return total / (n * (n + 1) / 2)


def ts_decay_linear(x, n: int, newest_heaviest: bool = False) -> Expr:
    """Weighted mean with weights n..1 from the oldest bar, as published by the
    original research platform; ``newest_heaviest`` gives the textbook order."""
    frame = ts_frame(x, n)
    if newest_heaviest:
        frame = apply(F.reverse, frame)
    return apply(_weighted_age, frame, float(n))


def _trend(x, n: int) -> tuple[Expr, Expr]:
    """Slope and intercept of the least-squares line through the last n bars.

    The bar index gives the regressor; covariances come from Spark's stable
    central-moment aggregates, so a long index does not cancel digits.
    """
    pos = bar_index() * 1.0
    slope = _full(roll("covar_pop", x, pos, lo=1 - n) / ((n * n - 1) / 12.0), x, n)
    level = _full(roll("avg", x, lo=1 - n), x, n) - slope * ((n - 1) / 2.0)
    return slope, level


def ts_slope(x, n: int) -> Expr:
    return _trend(x, n)[0]


def _no_inf_nan(x): return safe.finite(x)


def ts_rsquare(x, n: int) -> Expr:
    """Squared correlation with the bar index; null where it is undefined."""
    pos = bar_index() * 1.0
    cov = _full(roll("covar_pop", x, pos, lo=1 - n), x, n)
    return apply(_no_inf_nan, cov * cov / (roll("var_pop", x, lo=1 - n) * ((n * n - 1) / 12.0)))


def ts_resi(x, n: int) -> Expr:
    """Residual of the newest bar against the fitted line."""
    slope, level = _trend(x, n)
    return x - (slope * (n - 1.0) + level)


def _pair(a, b): return F.when(a.isNotNull() & b.isNotNull(), safe.dbl(a))
def _no_inf(x): return safe.inf_to_null(x)


CORR_DIGITS = 12


def _correlation(cov, va, vb, n):
    """A single pair has no correlation (NaN), like a constant frame.

    Rounding far below any meaning makes exact cases (two points: +-1) equal, so
    ranks over them do not depend on the order of summation. Halves of the binary
    value go away from zero, as in SQL engines (Spark's ``round`` takes the decimal form).
    """
    r = safe.safe_div(cov, F.sqrt(va * vb))
    scale = F.lit(10.0 ** CORR_DIGITS)
    t = F.abs(r) * scale
    near = F.signum(r) * (F.floor(t + 0.5).cast("double") / scale)
    r = F.when(t < 2.0 ** 53, near).otherwise(r)  # others hold no digit to round, or are no number
    return F.when(n > 1, r).when(n == 1, F.lit(safe.NAN) + cov)


def ts_corr(x, y, n: int) -> Expr:
    """Rolling Pearson correlation over the pairs present; infinity becomes null."""
    a, b = apply(_pair, x, y), apply(_pair, y, x)
    r = apply(
        _correlation,
        roll("covar_pop", a, b, lo=1 - n), roll("var_pop", a, lo=1 - n), roll("var_pop", b, lo=1 - n),
        roll("count", a, lo=1 - n),
    )
    return apply(_no_inf, r)


def ts_cov(x, y, n: int) -> Expr:
    return ts_corr(x, y, n) * ts_std(x, n) * ts_std(y, n)


def _least(a, b): return F.least(safe.dbl(a), safe.dbl(b))
def _greatest(a, b): return F.greatest(safe.dbl(a), safe.dbl(b))


def ts_less(x, y) -> Expr: return apply(_least, x, y)
def ts_greater(x, y) -> Expr: return apply(_greatest, x, y)
def ts_log(x) -> Expr: return apply(safe.safe_log, x)
def ts_abs(x) -> Expr: return apply(F.abs, x)


# full-window rolling statistics used by the event studies (min_periods = n)
def full_mean(x, n: int) -> Expr: return _full(roll("avg", x, lo=1 - n), x, n)
def full_min(x, n: int) -> Expr: return _full(roll("min", x, lo=1 - n), x, n)
def full_max(x, n: int) -> Expr: return _full(roll("max", x, lo=1 - n), x, n)


def full_pct_rank(x, n: int) -> Expr:
    """Average rank of the newest value inside its full window, divided by n."""
    return ts_rank(x, n)


__all__ = [n for n in dir() if n.startswith(("ts_", "full_"))]
