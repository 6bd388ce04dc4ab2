"""Arithmetic, time-series, cross-sectional and scalar operators over the bar panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import cs, maths, ts
from barloom.functions.expr import close, col, high, low, open_, volume, vwap
from barloom.plans.panel import Panel

from catalog.base import BARS, W, WD, WS, avg_rank, bars, panel_query, r, register, tidy

mid = vwap  # a second series for two-argument operators

# ---------------------------------------------------------------- arithmetic
panel_query("ar_add_sub_mul", {
    "add": close + volume, "radd": 1.5 + close, "sub": close - open_, "rsub": 100 - close,
    "mul": close * volume, "rmul": 2 * close, "neg": -close, "absolute": abs(open_ - close),
}, {
    "add": "close + volume", "radd": "1.5 + close", "sub": "close - open", "rsub": "100 - close",
    "mul": "close * volume", "rmul": "2 * close", "neg": "-close", "absolute": "abs(open - close)",
}, digits=8)

_zero_gap = high - low
panel_query("ar_division_ieee", {
    "div": close / open_, "rdiv": 1.0 / close, "by_zero": close / (_zero_gap * 0.0),
    "zero_by_zero": (_zero_gap * 0.0) / (_zero_gap * 0.0), "floordiv": volume // 7.0,
    "mod": volume % 7.0, "mod_neg": (0.0 - volume) % 7.0, "power": (close / 100.0) ** 2.0,
}, {
    "div": "close / open", "rdiv": "1.0 / close", "by_zero": "CAST('inf' AS DOUBLE)",
    "zero_by_zero": "CAST('nan' AS DOUBLE)", "floordiv": "floor(volume / 7)",
    "mod": "volume - 7 * floor(volume / 7)", "mod_neg": "-volume - 7 * floor(-volume / 7)",
    "power": "(close / 100) * (close / 100)",
})

panel_query("ar_comparisons", {
    "gt": close > open_, "ge": close >= vwap, "lt": close < open_, "le": close <= vwap,
    "eq": close == high, "ne": close != low,
}, None)
from catalog.base import ORACLE  # noqa: E402
ORACLE["ar_comparisons"] = f"""WITH {BARS} SELECT vt_symbol, datetime,
  CAST(close > open AS INTEGER) AS gt, CAST(close >= vwap AS INTEGER) AS ge,
  CAST(close < open AS INTEGER) AS lt, CAST(close <= vwap AS INTEGER) AS le,
  CAST(close = high AS INTEGER) AS eq, CAST(close <> low AS INTEGER) AS ne FROM bars"""


# ---------------------------------------------------------------- time series
def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {W(n)} = {n} THEN {agg} OVER {W(n)} END"


panel_query("ts_delay", {"lag3": ts.ts_delay(close, 3), "lead2": ts.ts_delay(close, -2)},
            {"lag3": f"lag(close, 3) OVER {WS}", "lead2": f"lead(close, 2) OVER {WS}"})
panel_query("ts_min", {"v": ts.ts_min(low, 10)}, {"v": f"min(low) OVER {W(10)}"})
panel_query("ts_max", {"v": ts.ts_max(high, 10)}, {"v": f"max(high) OVER {W(10)}"})
panel_query("ts_sum", {"v": ts.ts_sum(volume, 10)}, {"v": full("sum(volume)", "volume", 10)})
panel_query("ts_mean", {"v": ts.ts_mean(close, 10)}, {"v": f"avg(close) OVER {W(10)}"})
panel_query("ts_std", {"v": ts.ts_std(close, 10)}, {"v": f"stddev_pop(close) OVER {W(10)}"})
panel_query("ts_delta", {"v": ts.ts_delta(close, 5)}, {"v": f"close - lag(close, 5) OVER {WS}"})

_LISTS = f"lists AS (SELECT *, list(close) OVER {W(10)} AS xs, list(low) OVER {W(10)} AS ls FROM bars)"
panel_query("ts_argmax", {"v": ts.ts_argmax(close, 10)},
            {"v": "CASE WHEN len(xs) = 10 THEN list_position(xs, list_max(xs)) END"}, _LISTS, "lists")
panel_query("ts_argmin", {"v": ts.ts_argmin(low, 10)},
            {"v": "CASE WHEN len(ls) = 10 THEN list_position(ls, list_min(ls)) END"}, _LISTS, "lists")
panel_query("ts_rank", {"v": ts.ts_rank(close, 10)}, {
    "v": "CASE WHEN len(xs) = 10 THEN (len(list_filter(xs, lambda e: e < close)) "
         "+ (len(list_filter(xs, lambda e: e = close)) + 1) / 2.0) / 10 END"}, _LISTS, "lists")
panel_query("ts_quantile", {"v": ts.ts_quantile(close, 10, 0.8)},
            {"v": full("quantile_cont(close, 0.8)", "close", 10)})
panel_query("ts_product", {"v": ts.ts_product(close / open_, 5)},
            {"v": "CASE WHEN len(xs) = 5 THEN list_product(xs) END"},
            f"lists AS (SELECT *, list(close / open) OVER {W(5)} AS xs FROM bars)", "lists")
panel_query("ts_decay_linear", {
    "v": ts.ts_decay_linear(close, 5), "newest": ts.ts_decay_linear(close, 5, newest_heaviest=True),
}, {
    "v": "CASE WHEN len(xs) = 5 THEN (5 * xs[1] + 4 * xs[2] + 3 * xs[3] + 2 * xs[4] + xs[5]) / 15.0 END",
    "newest": "CASE WHEN len(xs) = 5 THEN (xs[1] + 2 * xs[2] + 3 * xs[3] + 4 * xs[4] + 5 * xs[5]) / 15.0 END",
}, f"lists AS (SELECT *, list(close) OVER {W(5)} AS xs FROM bars)", "lists")

_POS = f"pos AS (SELECT *, row_number() OVER {WS} - 1.0 AS i FROM bars)"
_slope = full("regr_slope(close, i)", "close", 10)
panel_query("ts_slope", {"v": ts.ts_slope(close, 10)}, {"v": _slope}, _POS, "pos")
panel_query("ts_rsquare", {"v": ts.ts_rsquare(close, 10)}, {
    "v": f"CASE WHEN count(close) OVER {W(10)} = 10 AND var_pop(close) OVER {W(10)} > 0"
         f" THEN regr_r2(close, i) OVER {W(10)} END"}, _POS, "pos")
panel_query("ts_resi", {"v": ts.ts_resi(close, 10)}, {
    "v": f"close - (({_slope}) * i + ({full('regr_intercept(close, i)', 'close', 10)}))"}, _POS, "pos", digits=5)


def corr_sql(x: str, y: str, n: int) -> str:
    """Pairwise rolling correlation; NaN for one pair or no variance."""
    sd = f"sqrt(var_pop({x}) OVER {W(n)} * var_pop({y}) OVER {W(n)})"
    return (f"CASE WHEN regr_count({x}, {y}) OVER {W(n)} = 0 THEN NULL "
            f"WHEN regr_count({x}, {y}) OVER {W(n)} = 1 OR {sd} = 0 THEN CAST('nan' AS DOUBLE) "
            f"ELSE (covar_pop({x}, {y}) OVER {W(n)}) / {sd} END")


panel_query("ts_corr", {"v": ts.ts_corr(close, volume, 10)}, {"v": corr_sql("close", "volume", 10)})
panel_query("ts_cov", {"v": ts.ts_cov(close, volume, 10)}, {
    "v": f"({corr_sql('close', 'volume', 10)}) * (stddev_pop(close) OVER {W(10)}) * (stddev_pop(volume) OVER {W(10)})"},
    digits=2)
panel_query("ts_less_greater_log_abs", {
    "less": ts.ts_less(open_, close), "greater": ts.ts_greater(open_, close),
    "logv": ts.ts_log(volume), "log_zero": ts.ts_log(volume * 0.0), "log_neg": ts.ts_log(-volume),
    "absv": ts.ts_abs(close - vwap),
}, {
    "less": "least(open, close)", "greater": "greatest(open, close)", "logv": "ln(volume)",
    "log_zero": "CAST('-inf' AS DOUBLE)", "log_neg": "CAST('nan' AS DOUBLE)", "absv": "abs(close - vwap)",
})

# ---------------------------------------------------------- cross-sectional
panel_query("cs_rank", {"v": cs.cs_rank(volume), "w": cs.cs_rank(ts.ts_delta(close, 3))},
            {"v": avg_rank("volume"), "w": avg_rank("d")},
            f"d AS (SELECT *, close - lag(close, 3) OVER {WS} AS d FROM bars)", "d")
panel_query("cs_mean", {"v": cs.cs_mean(close)}, {"v": f"avg(close) OVER {WD}"})
panel_query("cs_std", {"v": cs.cs_std(close)}, {"v": f"stddev_samp(close) OVER {WD}"})
panel_query("cs_sum", {"v": cs.cs_sum(close), "late": cs.cs_sum(ts.ts_delay(close, 80))},
            {"v": f"sum(close) OVER {WD}", "late": f"coalesce(sum(d) OVER {WD}, 0)"},
            f"d AS (SELECT *, lag(close, 80) OVER {WS} AS d FROM bars)", "d")
panel_query("cs_scale", {"v": cs.cs_scale(close - open_), "zero": cs.cs_scale((close - open_) * 0.0)},
            {"v": f"CASE WHEN sum(abs(close - open)) OVER {WD} <> 0 THEN (close - open) / "
                  f"sum(abs(close - open)) OVER {WD} ELSE 0 END", "zero": "0.0"})

# ------------------------------------------------------------------- scalar
panel_query("mf_conditionals", {
    "sgn": maths.sign(ts.ts_delta(close, 1)), "less": maths.less(open_, 1200.0),
    "greater": maths.greater(close, 1200.0),
    "q1": maths.quesval(1200.0, close, open_, -1.0), "q2": maths.quesval2(vwap, close, 1.0, 0.0),
    "qnull": maths.quesval(0.0, ts.ts_delay(close, 2), 1.0, 0.0), "logv": maths.log(close), "absv": maths.absolute(-close),
}, {
    "sgn": "CASE WHEN d > 0 THEN 1 WHEN d < 0 THEN -1 ELSE 0 END", "less": "least(open, 1200)",
    "greater": "greatest(close, 1200)", "q1": "CASE WHEN 1200 < close THEN open ELSE -1 END",
    "q2": "CASE WHEN vwap < close THEN 1 ELSE 0 END", "qnull": "CASE WHEN p IS NOT NULL THEN 1 ELSE 0 END",
    "logv": "ln(close)", "absv": "close",
}, f"d AS (SELECT *, close - lag(close) OVER {WS} AS d, lag(close, 2) OVER {WS} AS p FROM bars)", "d")
panel_query("mf_powers", {
    "p1": maths.pow1((close - vwap) / 100.0, 2.0), "p1n": maths.pow1(ts.ts_delay(close, 1) / 1000.0, 0.5),
    "p2": maths.pow2((close - vwap) / 100.0, volume % 3.0), "p2f": maths.pow2(close / 1000.0, close / open_),
    "p2nf": maths.pow2(-close / 1000.0, 0.5),
}, {
    "p1": "sign(close - vwap) * pow((close - vwap) / 100, 2)", "p1n": "coalesce(sqrt(p / 1000), 0)",
    "p2": "CASE WHEN close > vwap THEN pow((close - vwap) / 100, volume % 3) WHEN close < vwap "
          "THEN -pow(abs(close - vwap) / 100, volume % 3) ELSE 0 END",
    "p2f": "pow(close / 1000, close / open)", "p2nf": "0.0",
}, f"d AS (SELECT *, lag(close) OVER {WS} AS p FROM bars)", "d")

register("mf_tick_rounding", lambda spark, sf: tidy(bars(spark, sf).select(
    "vt_symbol", "datetime", maths.round_to(F.col("close"), 0.25).alias("rounded"),
    maths.floor_to(F.col("close"), 0.25).alias("floored"), maths.ceil_to(F.col("close"), 0.25).alias("ceiled"))),
    f"""WITH {BARS}, d AS (SELECT *, CAST(close AS DECIMAL(28,10)) * 4 AS q FROM bars)
    SELECT vt_symbol, datetime, {r('CAST(round_even(CAST(q AS DOUBLE), 0) AS DOUBLE) * 0.25', 'rounded')},
    {r('floor(q) * 0.25', 'floored')}, {r('ceil(q) * 0.25', 'ceiled')} FROM d""")
