"""Feature processors: DataFrame -> DataFrame steps for ``df.transform``.

Feature columns are those between the keys and the label (the last column).
``replace_inf`` and ``ts_norm`` also treat the label, like the platform they
stay compatible with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import safe
from barloom.functions.cs import cs_mean, cs_median, cs_rank, cs_std, cs_sum
from barloom.functions.expr import Expr, apply, col, lit, per_symbol
from barloom.plans.panel import Panel
from barloom.plans.quantiles import exact_quantiles
from barloom.session import durable

KEYS = ("datetime", "vt_symbol")


def _clean(c: Column) -> Column: return safe.nan_to_null(c.cast("double"))
def _finite(c: Column) -> Column: return safe.finite(c.cast("double"))
def _clip3(c: Column) -> Column: return F.when(F.isnan(c), c).when(c > 3, F.lit(3.0)).when(c < -3, F.lit(-3.0)).otherwise(c)
def _prefer(c: Column, other: Column) -> Column: return F.coalesce(c, other)
def _fill_inf(c: Column, mean: Column) -> Column: return F.when(F.abs(c) == safe.INF, mean).otherwise(c)


def features(df: DataFrame, label_too: bool = False) -> list[str]:
    named = [c for c in df.columns if c not in KEYS]
    return named if label_too else named[:-1]


def _rebuild(df: DataFrame, exprs: dict[str, Expr]) -> DataFrame:
    return Panel(df).with_columns({c: exprs.get(c, col(c)) for c in df.columns if c not in KEYS}, keep=[]).select(*df.columns)


def drop_na(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """NaN becomes null; rows with a null in ``names`` (default: features) go."""
    names = names or features(df)
    return df.withColumns({c: _clean(F.col(c)) for c in names}).na.drop(subset=names)


def fill_na(df: DataFrame, value: float, fill_label: bool = True) -> DataFrame:
    names = features(df, label_too=fill_label)
    return df.withColumns({c: F.coalesce(_clean(F.col(c)), F.lit(float(value))) for c in names})


def cs_norm(df: DataFrame, names: list[str] | None = None, method: str = "robust") -> DataFrame:
    """Per date: (x - median) / (1.4826 * MAD) clipped to +-3, or a z-score."""
    exprs = {}
    for c in names or features(df):
        x = apply(_clean, col(c))
        if method == "robust":
            gap = x - cs_median(x)
            exprs[c] = apply(_clip3, gap / cs_median(abs(gap)) / 1.4826)
        elif method == "zscore":
            exprs[c] = (x - cs_mean(x)) / cs_std(x)
        else:
            raise ValueError(f"unknown method {method!r}")
    return _rebuild(df, exprs)


def replace_inf(df: DataFrame) -> DataFrame:
    """Infinity becomes the symbol's mean of finite values (label included)."""
    exprs = {c: apply(_fill_inf, apply(_clean, col(c)), per_symbol("avg", apply(_finite, col(c))))
             for c in features(df, label_too=True)}
    return _rebuild(df, exprs)


def ts_norm(df: DataFrame, start=None, end=None) -> DataFrame:
    """Global mean and population deviation fitted on a date range (label included).

    The fit is one aggregate row, cross-joined back.
    """
    from barloom.sources.store import within
    names = features(df, label_too=True)
    fit = within(df, "datetime", start, end).agg(*[
        a for i, c in enumerate(names)
        for a in (F.avg(_clean(F.col(c))).alias(f"__m{i}"), F.stddev_pop(_clean(F.col(c))).alias(f"__s{i}"))])
    out = {c: F.when(F.col(f"__s{i}") == 0, _clean(F.col(c)))
           .otherwise(safe.safe_div(_clean(F.col(c)) - F.col(f"__m{i}"), F.col(f"__s{i}"))) for i, c in enumerate(names)}
    return df.crossJoin(F.broadcast(fit)).withColumns(out).select(*df.columns)  # one row


def drop_feature(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def cs_fill_na(df: DataFrame) -> DataFrame:
    """Missing values become the date's mean."""
    clean = {c: apply(_clean, col(c)) for c in features(df)}
    return _rebuild(df, {c: apply(_prefer, x, cs_mean(x)) for c, x in clean.items()})


def robust_zscore_norm(df: DataFrame, start=None, end=None, clip: bool = True) -> DataFrame:
    """Exact global median and MAD fitted on a date range; a column without spread stays finite."""
    from barloom.sources.store import within
    names = features(df)
    sample = durable(within(df, "datetime", start, end).select(*[_clean(F.col(c)).alias(c) for c in names]))
    medians = {c: m for c, (m,) in exact_quantiles(sample, names, [0.5]).items()}
    known = [c for c in names if medians[c] is not None]
    mads = {c: m for c, (m,) in exact_quantiles(sample, {c: F.abs(F.col(c) - medians[c]) for c in known}, [0.5]).items()} if known else {}
    number = lambda x: F.lit(x).cast("double")
    out = {}
    for c in names:
        z = (_clean(F.col(c)) - number(medians[c])) / ((number(mads.get(c)) + 1e-12) * 1.4826)
        out[c] = _clip3(z) if clip else z
    return df.withColumns(out).select(*df.columns)


def cs_rank_norm(df: DataFrame, names: list[str]) -> DataFrame:
    """(average rank / rows of the date - 0.5) * 3.46; the count includes nulls."""
    rows = cs_sum(lit(1.0))
    return _rebuild(df, {c: (cs_rank(apply(_clean, col(c))) / rows - 0.5) * 3.46 for c in names})
