"""Cross-sectional operators (all symbols of one date)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import safe
from barloom.functions.expr import Expr, apply, date_rank, per_date


def cs_rank(x) -> Expr:
    """Average rank 1..n, not a percentile."""
    return date_rank(x)


def cs_mean(x) -> Expr: return per_date("avg", x)
def cs_std(x) -> Expr: return per_date("stddev_samp", x)
def _zero(x): return F.coalesce(x, F.lit(0.0))
def cs_sum(x) -> Expr: return apply(_zero, per_date("sum", x * 1.0))
def cs_count(x) -> Expr: return per_date("count", x)
def cs_min(x) -> Expr: return per_date("min", x)
def cs_max(x) -> Expr: return per_date("max", x)
def cs_median(x) -> Expr: return per_date("median", x)


def _scaled(x, total):
    return F.when(total != 0, safe.safe_div(x, total)).otherwise(F.lit(0.0))


def cs_scale(x) -> Expr:
    """x over the sum of |x|; zero where that sum is zero."""
    return apply(_scaled, x, cs_sum(abs(x * 1.0)))


def cs_pct(x) -> Expr:
    """Average rank over the number of non-null values."""
    return date_rank(x) / per_date("count", x)


__all__ = [n for n in dir() if n.startswith("cs_")]
