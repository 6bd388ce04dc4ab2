"""Rank composites, trend/RSI states, first-pass panel scans and event extras."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.factors.common import EPS, bias, change, ratio
from barloom.factors.patterns import resistance, support
from barloom.factors.spec import Factor, family, snake_case
from barloom.functions import safe, ta
from barloom.functions.cs import cs_pct, cs_rank
from barloom.functions.expr import Expr, apply, close, col, high, low, open_, roll, shift, turnover, volume
from barloom.functions.maths import greater, less, log
from barloom.functions.ts import full_max, full_mean, full_min, ts_corr, ts_max, ts_mean, ts_min, ts_rank, ts_sum


def _average(*parts: Expr) -> Expr:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / float(len(parts))


def combos() -> list[Factor]:
    """Weighted rank blends of reversal, turnover, correlation and crowding factors."""
    top, bottom = resistance(20), support(20)
    lift_reversal = (ratio(top, shift(top, 20)) + ratio(bottom, shift(bottom, 20))) * -1 / 2.0
    core = _average(
        cs_rank(change(close, 20) * -1), cs_rank(ratio(turnover, ts_mean(turnover, 120)) * -1),
        cs_rank(ts_corr(close, volume, 20) * -1), cs_rank(lift_reversal),
    )
    anti_trix = change(ta.ta_ema(ta.ta_ema(ta.ta_ema(close, 14), 14), 14), 1) * -1
    pressure = ts_sum(change(close, 1) * volume, 60) * -1 / (ts_sum(volume, 60) + EPS)
    strength = change(close, 20) - change(col("benchmark_close"), 20)
    heat = ts_sum(col("raw_close") >= col("up_limit") * 0.999, 20) * -1
    broad = _average(
        cs_rank(log(ts_mean(turnover, 5) + 1) * -1), cs_rank(anti_trix), cs_rank(pressure),
        cs_rank(strength * -1), cs_rank(heat),
    )
    with_corr60 = core * 0.85 + cs_rank(ts_corr(close, volume, 60) * -1) * 0.15
    return family("combo", {
        "combo_core4_pvcorr60_15pct": with_corr60,
        "combo_pvcorr15_broad_antitrix14_10pct": with_corr60 * 0.9 + cs_rank(anti_trix) * 0.1,
        "combo_pvcorr15_broad_top5_10pct": with_corr60 * 0.9 + broad * 0.1,
        "combo_core4_control": core, "combo_broad_top5": broad,
    })


def trend_rsi(version: int = 1) -> list[Factor]:
    """Trend, RSI and candle states on 20/60/120 means; version 2 adds bands."""
    fast, mid, slow = (ta.ta_ema(close, n) for n in (20, 60, 120))
    rsi, atr = ta.ta_rsi(close, 14), ta.ta_atr(high, low, close, 14)
    span, body = greater(high - low, EPS), abs(close - open_)
    lower_wick, place = less(open_, close) - low, (close - low) / greater(high - low, EPS)
    oversold = ts_min(rsi, 20) <= 30.0
    bear = (fast < mid) * (mid < slow)
    cross = lambda line: (close > line) * (shift(close, 1) <= shift(line, 1))
    means = ("emaFast", "emaMid", "emaSlow") if version == 1 else ("ema20", "ema60", "ema120")
    states = {
        **dict(zip(means, (fast, mid, slow))), "rsiVal": rsi, "atrVal": atr, "volMA": ts_mean(volume, 20),
        "emaBull": (fast > mid) * (mid > slow), "emaBear": bear,
        "downContext": ((close < mid) + (fast < mid) + (mid < slow)) > 0,
        "deepDown": bear * (close < fast), "upContext": (close > mid) * (fast > mid),
        "recentOversold": oversold,
        "rsiReturnNow": oversold * ((rsi > 40.0) * (shift(rsi, 1) <= 40.0)),
        "rsiRecovered": oversold * (rsi > 40.0) * (rsi > shift(rsi, 1)),
        "plRsi": shift(rsi, 5), "priorLowLevel": ts_min(shift(low, 1), 30), "barRange": span, "realBody": body,
        "lowerWick": lower_wick, "upperWick": high - greater(open_, close), "closePosition": place,
        "longLowerWick": (lower_wick >= atr * 0.7) * (place >= 0.65),
        "strongBullBody": (close > open_) * (body >= atr * 0.9) * (place >= 0.65),
        "breakHighLevel": ts_max(shift(high, 1), 10), "crossEma20": cross(fast), "crossEma60": cross(mid),
    }
    prefix = "tv_trend_rsi_"
    if version == 2:
        prefix = "tv_trend_rsi_v2_"
        bottom, top = ts_min(low, 120), ts_max(high, 120)
        reach = greater(top - bottom, EPS)
        states |= {
            "phRsi": shift(rsi, 5), "rsiRangeLow": bottom, "rsiRangeHigh": top, "rsiPriceSpan": reach,
            "rsiBandBottom": bottom + reach * 2.0 / 100.0, "rsiBandHeight": reach * 18.0 / 100.0,
        }
    return family("trend_rsi", {prefix + snake_case(k): v for k, v in states.items()})


# ---------------------------------------------------- panel scans (plain ratios)
def _sample_std(s, n, w): return F.when(n == w, s)
def _only_full(r, n, w): return F.when(n == w, r)


def full_std(x: Expr, w: int) -> Expr:
    return apply(_sample_std, roll("stddev_samp", x, lo=1 - w), roll("count", x, lo=1 - w), w)


def full_corr(x: Expr, y: Expr, w: int) -> Expr:
    return apply(_only_full, ts_corr(x, y, w), roll("count", x + y, lo=1 - w), w)


def _momentum(w: int) -> Expr: return close / shift(close, w) - 1.0
def _surge(w: int) -> Expr: return turnover / full_mean(turnover, w) - 1.0


def first_pass(windows=(20, 60, 120)) -> list[Factor]:
    daily = close / shift(close, 1) - 1.0
    out = {}
    for w in windows:
        out |= {
            f"mom_{w}": _momentum(w), f"rev_{w}": -_momentum(w), f"low_vol_{w}": -full_std(daily, w),
            f"ret_vol_{w}": full_std(daily, w), f"turnover_surge_{w}": _surge(w),
            f"neg_price_volume_corr_{w}": -full_corr(close, volume, w),
        }
    out |= {
        "value_pb": -col("pb"), "value_pe_ttm": -col("pe_ttm"), "quality_roe": col("fi_roe"),
        "growth_netprofit_yoy": col("fi_netprofit_yoy"), "growth_or_yoy": col("fi_or_yoy"),
        "low_debt_to_assets": -col("fi_debt_to_assets"),
    }
    return family("first_pass", out)


def candidates() -> dict[str, Expr]:
    return {
        "rev_20": -_momentum(20), "rev_60": -_momentum(60), "anti_turnover_surge_120": -_surge(120),
        "neg_price_volume_corr_20": -full_corr(close, volume, 20), "growth_netprofit_yoy": col("fi_netprofit_yoy"),
    }


# fixed values: the components of each composite
COMPOSITES = {
    "combo_core_4": ("rev_20", "anti_turnover_surge_120", "neg_price_volume_corr_20", "growth_netprofit_yoy"),
    "combo_price_flow_3": ("rev_20", "anti_turnover_surge_120", "neg_price_volume_corr_20"),
    "combo_reversal_flow_4": ("rev_20", "rev_60", "anti_turnover_surge_120", "neg_price_volume_corr_20"),
    "combo_low_redundancy_3": ("rev_20", "neg_price_volume_corr_20", "growth_netprofit_yoy"),
}


def _mean_skipping_null(*xs: Column) -> Column: return safe.skipnull_mean(*[safe.dbl(x) for x in xs])


def rank_mean(parts: list[Expr]) -> Expr:
    """Null-skipping mean of the parts' percentile ranks of the date."""
    return apply(_mean_skipping_null, *(cs_pct(p) for p in parts))


def candidate_composites() -> dict[str, Expr]:
    base = candidates()
    return {name: rank_mean([base[p] for p in parts]) for name, parts in COMPOSITES.items()}


def price_flow_3(surge: int = 120, corr: int = 20, momentum: int = 20) -> dict[str, Expr]:
    """Three base factors, their rank over the date's row count, and the mean."""
    base = {
        f"rev_{momentum}": -_momentum(momentum), f"anti_turnover_surge_{surge}": -_surge(surge),
        f"neg_price_volume_corr_{corr}": -full_corr(close, volume, corr),
    }
    from barloom.functions.cs import cs_sum
    from barloom.functions.expr import lit
    ranks = {f"{k}_rank": cs_rank(v) / cs_sum(lit(1.0)) for k, v in base.items()}
    return base | ranks | {"combo_price_flow_3": apply(_mean_skipping_null, *ranks.values())}


def panel_expressions(windows=(5, 10, 20, 60, 120)) -> dict[str, Expr]:
    from barloom.factors.common import classic_price
    from barloom.factors.spec import expressions
    return expressions(classic_price(windows)) | {
        "rank_roe": cs_rank(col("fi_roe")), "rank_netprofit_yoy": cs_rank(col("fi_netprofit_yoy")),
        "rank_or_yoy": cs_rank(col("fi_or_yoy")), "rank_low_debt": cs_rank(col("fi_debt_to_assets")) * -1,
        "rank_gross_margin": cs_rank(col("fi_grossprofit_margin")), "rank_low_pb": cs_rank(col("pb")) * -1,
    }


def _span(n: int) -> float: return 2.0 / (n + 1)


def signal_close_extras() -> list[Factor]:
    """Direction-adjusted factors known at the signal close (min_periods = window)."""
    def lift(w: int) -> Expr:
        top, bottom = full_max(shift(high, 1), w), full_min(shift(low, 1), w)
        return ((top / shift(top, w) - 1.0) + (bottom / shift(bottom, w) - 1.0)) * -1 / 2.0

    floor_60 = full_min(shift(low, 1), 60)
    dif = ta.ewm(close, _span(12), 12) - ta.ewm(close, _span(26), 26)
    dea = ta.ewm(dif, _span(9), 9)
    triple = ta.ewm(ta.ewm(ta.ewm(close, _span(14), 14), _span(14), 14), _span(14), 14)
    atr5 = ta.ewm(ta.true_range(high, low, close), 1.0 / 5, 5)
    return family("signal_close", {
        **{f"factor_common_reversal_{w}": (close / shift(close, w) - 1.0) * -1 for w in (10, 20, 60)},
        **{f"factor_box_stack_lift_reversal_{w}": lift(w) for w in (20, 30)},
        **{f"factor_common_anti_limit_up_heat_{w}": ts_sum(col("is_limit_up"), w) * -1 for w in (5, 20)},
        "factor_double_bottom_low_similarity_60": abs(low / (floor_60 + EPS) - 1.0) * -1,
        "factor_common_value_pb_percentile_60": ts_rank(col("pb"), 60) * -1,
        "factor_anti_ma_bias_60": (close / (full_mean(close, 60) + EPS) - 1.0) * -1,
        "factor_anti_log_turnover_mean_5": log(full_mean(turnover, 5) + 1.0) * -1,
        "factor_anti_log_turnover_mean_10": log(full_mean(turnover, 10) + 1.0) * -1,
        "factor_anti_turnover_rate": col("turnover_rate") * -1,
        "factor_anti_macd_dif_12_26_9": dif * -1 / (close + EPS),
        "factor_anti_macd_dea_12_26_9": dea * -1 / (close + EPS),
        "factor_anti_trix_14": (triple / shift(triple, 1) - 1.0) * -1,
        "factor_anti_atr_pct_5": atr5 * -1 / (close + EPS),
    })
