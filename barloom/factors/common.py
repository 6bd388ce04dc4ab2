"""General factor families: technical, candlestick, flow, liquidity, position,
oscillator, relative strength, limit state, fundamental, mean groups, channels,
compression and trade filters."""

from __future__ import annotations

from functools import reduce

from barloom.factors.spec import Factor, family
from barloom.functions import ta
from barloom.functions.cs import cs_rank
from barloom.functions.expr import Expr, close, col, high, low, open_, shift, turnover, volume
from barloom.functions.maths import greater, less, log, sign
from barloom.functions.ts import (
    ts_argmax, ts_argmin, ts_corr, ts_max, ts_mean, ts_min, ts_rank, ts_slope, ts_std, ts_sum,
)

EPS = 1e-12


def ratio(a, b) -> Expr:
    """a / b - 1 with the family's epsilon in the denominator."""
    return a / (b + EPS) - 1.0


def change(x: Expr, n: int) -> Expr:
    return ratio(x, shift(x, n))


def bias(x: Expr, n: int) -> Expr:
    return ratio(x, ts_mean(x, n))


def zscore(x: Expr, n: int) -> Expr:
    return (x - ts_mean(x, n)) / (ts_std(x, n) + EPS)


def prior_mean_ratio(x: Expr, n: int) -> Expr:
    return x / (ts_mean(shift(x, 1), n) + EPS)


def in_range(n: int) -> Expr:
    return (close - ts_min(low, n)) / (ts_max(high, n) - ts_min(low, n) + EPS)


def last_quarter_only(*terms: Expr) -> Expr:
    """Sum of the terms where only the last is divided by their number.

    The compatible platform evaluates its composites this way; ``mean_of_ranks``
    is the evenly weighted form.
    """
    return reduce(lambda x, y: x + y, terms[:-1]) + terms[-1] / float(len(terms))


def mean_of_ranks(*terms: Expr) -> Expr:
    return reduce(lambda x, y: x + y, terms) / float(len(terms))


def classic_price(windows=(5, 10, 20, 60, 120)) -> list[Factor]:
    out = {}
    for w in windows:
        momentum = cs_rank(close / shift(close, w) - 1.0)
        out |= {
            f"classic_momentum_{w}": momentum, f"classic_reversal_{w}": momentum * -1,
            f"classic_range_position_{w}": cs_rank(in_range(w)),
            f"classic_low_volatility_{w}": cs_rank(ts_std(close / shift(close, 1) - 1.0, w)) * -1,
            f"classic_volume_ratio_{w}": cs_rank(volume / (ts_mean(volume, w) + EPS)),
            f"classic_turnover_ratio_{w}": cs_rank(turnover / (ts_mean(turnover, w) + EPS)),
            f"classic_anti_price_volume_corr_{w}": cs_rank(ts_corr(close, volume, w)) * -1,
        }
    return family("classic_price", out)


def technical(windows=(5, 10, 20, 60), macd=(12, 26, 9)) -> list[Factor]:
    out = {}
    for w in windows:
        ma = ts_mean(close, w)
        out |= {
            f"common_momentum_{w}": change(close, w), f"common_reversal_{w}": change(close, w) * -1,
            f"common_ma_bias_{w}": ratio(close, ma), f"common_ma_slope_{w}": ts_slope(ma, w) / (ma + EPS),
            f"common_range_position_{w}": in_range(w),
            f"common_return_volatility_{w}": ts_std(change(close, 1), w),
            f"common_volume_ratio_{w}": prior_mean_ratio(volume, w),
            f"common_turnover_ratio_{w}": prior_mean_ratio(turnover, w),
            f"common_price_volume_corr_{w}": ts_corr(close, volume, w),
            f"common_rsi_{w}": ta.ta_rsi(close, w) / 100.0,
            f"common_atr_pct_{w}": ta.ta_atr(high, low, close, w) / (close + EPS),
        }
    dif, dea, hist = ta.macd(close, *macd)
    tag = "_".join(map(str, macd))
    out |= {
        f"common_macd_dif_{tag}": dif / (close + EPS), f"common_macd_dea_{tag}": dea / (close + EPS),
        f"common_macd_hist_{tag}": hist / (close + EPS),
        f"common_macd_hist_slope_3_{tag}": (hist - shift(hist, 3)) / (close + EPS),
        f"common_macd_bullish_state_{tag}": (dif > dea) * (hist > 0),
        f"common_macd_bearish_state_{tag}": (dif <= dea) * (hist <= 0),
    }
    return family("technical", out)


def candlestick() -> list[Factor]:
    span, body, before = high - low, close - open_, shift(close, 1)
    upper, lower = high - greater(open_, close), less(open_, close) - low
    return family("candlestick", {
        "common_open_gap": ratio(open_, before), "common_intraday_return": ratio(close, open_),
        "common_high_low_range_pct": span / (open_ + EPS), "common_real_body_pct": abs(body) / (open_ + EPS),
        "common_body_to_range": abs(body) / (span + EPS),
        "common_close_position": (close - low) / (span + EPS),
        "common_open_position": (open_ - low) / (span + EPS),
        "common_upper_shadow_pct": upper / (open_ + EPS), "common_lower_shadow_pct": lower / (open_ + EPS),
        "common_upper_shadow_ratio": upper / (span + EPS), "common_lower_shadow_ratio": lower / (span + EPS),
        "common_candle_shift": (close * 2 - high - low) / (open_ + EPS),
        "common_bullish_body_state": body > 0, "common_bearish_body_state": body < 0,
        "common_gap_fill_state": (open_ > before) * (low <= before) + (open_ < before) * (high >= before),
    })


def accumulation(windows=(5, 10, 20, 60)) -> list[Factor]:
    before, typical = shift(close, 1), (high + low + close) / 3.0
    location = ((close - low) - (high - close)) / (high - low + EPS)
    out = {}
    for w in windows:
        per_volume = lambda x: ts_sum(x, w) / (ts_sum(volume, w) + EPS)
        weighted_return = per_volume(change(close, 1) * volume)
        out |= {
            f"common_obv_pressure_{w}": per_volume(sign(close - before) * volume),
            f"common_pvt_pressure_{w}": weighted_return,
            f"common_cmf_{w}": per_volume(location * volume),
            f"common_money_flow_pressure_{w}":
                ts_sum(sign(typical - shift(typical, 1)) * turnover, w) / (ts_sum(turnover, w) + EPS),
            f"common_volume_weighted_return_{w}": weighted_return,
            f"common_up_volume_ratio_{w}": per_volume((close > before) * volume),
            f"common_down_volume_ratio_{w}": per_volume((close < before) * volume),
            f"common_accumulation_slope_{w}":
                ts_slope(ts_sum(location * volume, w), w) / (ts_sum(volume, w) + EPS),
        }
    return family("price_volume_accumulation", out)


def liquidity(windows=(5, 10, 20, 60)) -> list[Factor]:
    rate = col("turnover_rate")
    out = {}
    for w in windows:
        amihud = ts_mean(abs(change(close, 1)) / (turnover + EPS), w)
        size = log(ts_mean(turnover, w) + 1)
        amount = prior_mean_ratio(turnover, w)
        out |= {
            f"common_log_turnover_mean_{w}": size, f"common_amount_ratio_{w}": amount,
            f"common_turnover_zscore_{w}": zscore(turnover, w), f"common_volume_zscore_{w}": zscore(volume, w),
            f"common_amihud_illiquidity_{w}": amihud, f"common_anti_amihud_illiquidity_{w}": amihud * -1,
            f"common_liquidity_score_{w}": (cs_rank(size) + cs_rank(amihud * -1)) / 2.0,
            f"common_turnover_rate_zscore_{w}": zscore(rate, w),
            f"common_turnover_rate_percentile_{w}": ts_rank(rate, w),
            f"common_crowding_score_{w}": last_quarter_only(
                cs_rank(amount), cs_rank(zscore(turnover, w)), cs_rank(zscore(volume, w)), cs_rank(zscore(rate, w))),
        }
    return family("liquidity_crowding", out)


def position(windows=(20, 60, 120)) -> list[Factor]:
    out = {}
    for w in windows:
        top, bottom = ts_max(high, w), ts_min(low, w)
        prior_top, prior_bottom = ts_max(shift(high, 1), w), ts_min(shift(low, 1), w)
        out |= {
            f"common_close_to_high_{w}": (top - close) / (close + EPS),
            f"common_close_to_low_{w}": (close - bottom) / (close + EPS),
            f"common_drawdown_from_high_{w}": ratio(close, top), f"common_rebound_from_low_{w}": ratio(close, bottom),
            f"common_days_since_high_{w}": (w - ts_argmax(high, w)) / float(w),
            f"common_days_since_low_{w}": (w - ts_argmin(low, w)) / float(w),
            f"common_prior_high_breakout_{w}": ratio(close, prior_top),
            f"common_prior_low_breakdown_{w}": ratio(close, prior_bottom),
            f"common_new_high_state_{w}": close >= prior_top, f"common_new_low_state_{w}": close <= prior_bottom,
            f"common_pullback_from_high_rank_{w}": ts_rank(ratio(close, top), w),
            f"common_low_reclaim_strength_{w}": (close - low) / (top - bottom + EPS),
        }
    return family("position_breakout", out)


def oscillator(windows=(14, 20)) -> list[Factor]:
    before, typical = shift(close, 1), (high + low + close) / 3.0
    out = {}
    for w in windows:
        mean = ts_mean(typical, w)
        triple = ta.ta_ema(ta.ta_ema(ta.ta_ema(close, w), w), w)
        up_days, down_days = ts_mean(close > before, w), ts_mean(close < before, w)
        up = ts_sum(greater(high - shift(high, 1), 0), w)
        down = ts_sum(greater(shift(low, 1) - low, 0), w)
        out |= {
            f"common_stoch_k_{w}": in_range(w), f"common_stoch_d_{w}": ts_mean(in_range(w), 3),
            f"common_williams_r_{w}":
                (ts_max(high, w) - close) * -1 / (ts_max(high, w) - ts_min(low, w) + EPS),
            f"common_cci_{w}": (typical - mean) / (ts_mean(abs(typical - mean), w) * 0.015 + EPS),
            f"common_roc_{w}": change(close, w), f"common_trix_{w}": change(triple, 1),
            f"common_up_day_ratio_{w}": up_days, f"common_down_day_ratio_{w}": down_days,
            f"common_day_balance_{w}": up_days - down_days,
            f"common_dmi_balance_{w}": (up - down) / (up + down + EPS),
            f"common_adx_proxy_{w}": abs(up - down) / (up + down + EPS),
        }
    return family("oscillator", out)


def beta(x: Expr, y: Expr, w: int) -> Expr:
    return ts_corr(x, y, w) * ts_std(x, w) / (ts_std(y, w) + EPS)


def relative_strength(windows=(20, 60), benchmark="benchmark_close", industry="industry_close") -> list[Factor]:
    out = {}
    own = change(close, 1)
    for label, other in (("benchmark", col(benchmark)), ("industry", col(industry))):
        move = change(other, 1)
        for w in windows:
            b = beta(own, move, w)
            out |= {
                f"common_relative_{label}_strength_{w}": change(close, w) - change(other, w),
                f"common_{label}_beta_{w}": b,
                f"common_{label}_residual_momentum_{w}": ts_mean(own - b * move, w),
            }
    return family("relative_strength", out)


def limit_state(windows=(5, 20), tolerance=0.001, near=0.03) -> list[Factor]:
    opened, top, bottom, last = col("raw_open"), col("raw_high"), col("raw_low"), col("raw_close")
    up, down = col("up_limit"), col("down_limit")
    up_line, down_line = up * (1.0 - tolerance), down * (1.0 + tolerance)
    is_up, is_down = last >= up_line, last <= down_line
    reopened = (top >= up_line) * (last < up_line)
    out = {
        "common_limit_up_distance": ratio(up, last), "common_limit_down_distance": ratio(last, down),
        "common_near_limit_up_state": last >= up * (1.0 - near),
        "common_near_limit_down_state": last <= down * (1.0 + near),
        "common_is_limit_up": is_up, "common_is_limit_down": is_down,
        "common_one_line_limit_up": (opened >= up_line) * (bottom >= up_line) * (last >= up_line),
        "common_limit_up_opened_state": reopened,
        "common_limit_up_resealed_state": (bottom < up_line) * (last >= up_line),
    }
    for w in windows:
        out |= {
            f"common_limit_up_count_{w}": ts_sum(is_up, w), f"common_limit_down_count_{w}": ts_sum(is_down, w),
            f"common_anti_limit_up_heat_{w}": ts_sum(is_up, w) * -1,
            f"common_limit_up_opened_count_{w}": ts_sum(reopened, w),
        }
    return family("limit_state", out)


def fundamental(windows=(20, 60)) -> list[Factor]:
    pb, pe, roe = col("pb"), col("pe_ttm"), col("fi_roe")
    margin, growth, float_cap = col("fi_grossprofit_margin"), col("fi_netprofit_yoy"), col("circ_mv")
    out = {
        "common_value_pb": pb * -1, "common_value_pe_ttm": pe * -1, "common_value_ps_ttm": col("ps_ttm") * -1,
        "common_dividend_yield_ttm": col("dv_ttm"), "common_quality_roe": roe, "common_quality_gross_margin": margin,
        "common_low_debt_to_assets": col("fi_debt_to_assets") * -1, "common_growth_netprofit_yoy": growth,
        "common_growth_or_yoy": col("fi_or_yoy"), "common_log_total_mv": log(col("total_mv") + 1),
        "common_log_circ_mv": log(float_cap + 1), "common_small_cap_circ_mv": log(float_cap + 1) * -1,
    }
    for w in windows:
        cheap = ts_rank(pb, w) * -1
        out |= {
            f"common_pb_percentile_{w}": ts_rank(pb, w), f"common_value_pb_percentile_{w}": cheap,
            f"common_pe_ttm_percentile_{w}": ts_rank(pe, w), f"common_roe_momentum_{w}": roe - shift(roe, w),
            f"common_growth_stability_{w}": ts_std(growth, w) * -1,
            f"common_quality_value_blend_{w}": last_quarter_only(
                cs_rank(roe), cs_rank(margin), cs_rank(pb * -1), cs_rank(cheap)),
        }
    return family("fundamental", out)


def mean_groups(short=(3, 5, 8, 10, 12, 15), long=(30, 35, 40, 45, 50, 60), slope=3, min_gap=0.002) -> list[Factor]:
    """Two groups of exponential means: their gap, spread, slope and order."""
    label = f"s{min(short)}_{max(short)}_l{min(long)}_{max(long)}"
    fast, slow = [ta.ta_ema(close, n) for n in short], [ta.ta_ema(close, n) for n in long]
    average = lambda xs: reduce(lambda a, b: a + b, xs) / float(len(xs))
    fast_mean, slow_mean = average(fast), average(slow)
    fast_top, fast_bottom = reduce(greater, fast), reduce(less, fast)
    slow_top, slow_bottom = reduce(greater, slow), reduce(less, slow)
    gap = ratio(fast_mean, slow_mean)
    fast_slope, slow_slope = change(fast_mean, slope), change(slow_mean, slope)
    slow_spread = (slow_top - slow_bottom) / (slow_mean + EPS)
    near_fast, near_slow = abs(ratio(low, fast_mean)) * -1, abs(ratio(low, slow_mean)) * -1
    anti_gap = greater(gap, 0) * -1
    ordered = fast_bottom > slow_top
    return family("mean_groups", {
        f"common_gmma_group_gap_{label}": gap,
        f"common_gmma_short_spread_{label}": (fast_top - fast_bottom) / (fast_mean + EPS),
        f"common_gmma_long_spread_{label}": slow_spread,
        f"common_gmma_short_slope_{label}_{slope}": fast_slope, f"common_gmma_long_slope_{label}_{slope}": slow_slope,
        f"common_gmma_conservative_bull_{label}": ordered, f"common_gmma_cross_bull_{label}": fast_mean > slow_mean,
        f"common_gmma_gap_expanding_{label}": abs(gap) > shift(abs(gap), 1),
        f"common_gmma_compression_{label}": abs(gap) * -1, f"common_gmma_anti_group_gap_{label}": anti_gap,
        f"common_gmma_anti_long_slope_{label}_{slope}": greater(slow_slope, 0) * -1,
        f"common_gmma_pullback_to_short_group_{label}": near_fast,
        f"common_gmma_pullback_to_long_group_{label}": near_slow,
        f"common_gmma_bull_trend_{label}_{slope}":
            ordered * (fast_slope > 0) * (slow_slope > 0) * (abs(gap) >= min_gap),
        f"common_gmma_trend_quality_{label}_{slope}": last_quarter_only(
            cs_rank(gap), cs_rank(fast_slope), cs_rank(slow_slope), cs_rank(slow_spread * -1)),
        f"common_gmma_pullback_trend_quality_{label}_{slope}": last_quarter_only(
            cs_rank(anti_gap), cs_rank(near_fast), cs_rank(near_slow), cs_rank(fast_slope)),
    })


def channels(filter_n=12, fast=(144, 169), slow=(576, 676), slope=8, filter_slope_n=3, prior=20) -> list[Factor]:
    """Two channels between exponential means plus a short filter mean."""
    f_label = f"{fast[0]}_{fast[1]}"
    label = f"f{f_label}_s{slow[0]}_{slow[1]}"

    def channel(periods):
        a, b = (ta.ta_ema(close, n) for n in periods)
        top, bottom, mid = greater(a, b), less(a, b), (a + b) / 2.0
        return top, bottom, mid, (top - bottom) / (mid + EPS)

    top, bottom, mid, width = channel(fast)
    _, _, slow_mid, slow_width = channel(slow)
    line = ta.ta_ema(close, filter_n)
    breakout, line_bias, line_slope = ratio(close, top), ratio(line, top), change(line, filter_slope_n)
    fast_slope, gap = change(mid, slope), ratio(mid, slow_mid)
    anti_breakout = greater(breakout, 0) * -1
    to_top, to_mid = abs(ratio(low, top)) * -1, abs(ratio(low, mid)) * -1
    reclaim = (low <= line) * (close > line) * ratio(close, line)
    prior_break = ratio(close, ts_max(shift(high, 1), prior))
    v = "common_vegas"
    return family("channels", {
        f"{v}_fast_position_{label}": ratio(close, mid), f"{v}_fast_width_{label}": width,
        f"{v}_slow_position_{label}": ratio(close, slow_mid), f"{v}_slow_width_{label}": slow_width,
        f"{v}_trend_gap_{label}": gap, f"{v}_fast_slope_{label}_{slope}": fast_slope,
        f"{v}_slow_slope_{label}_{slope}": change(slow_mid, slope),
        f"{v}_ema_filter_bias_{filter_n}_{f_label}": line_bias,
        f"{v}_ema_filter_slope_{filter_n}_{filter_slope_n}": line_slope,
        f"{v}_breakout_strength_{label}": breakout, f"{v}_anti_breakout_extension_{label}": anti_breakout,
        f"{v}_anti_fast_position_{label}": greater(ratio(close, mid), 0) * -1,
        f"{v}_anti_ema_filter_extension_{filter_n}_{f_label}": greater(line_bias, 0) * -1,
        f"{v}_pullback_distance_{label}": to_top, f"{v}_pullback_to_mid_quality_{label}": to_mid,
        f"{v}_fast_top_reclaim_strength_{label}": (low <= top) * (close > top) * breakout,
        f"{v}_ema_filter_reclaim_strength_{filter_n}": reclaim, f"{v}_prior_high_breakout_{prior}": prior_break,
        f"{v}_long_ready_{filter_n}_{label}":
            (close > top) * (line > top) * (line_slope > 0) * (top > shift(top, slope)) * (bottom > shift(bottom, slope)),
        f"{v}_trend_quality_{filter_n}_{label}": last_quarter_only(
            cs_rank(breakout), cs_rank(line_bias), cs_rank(fast_slope), cs_rank(gap), cs_rank(prior_break)),
        f"{v}_pullback_trend_quality_{filter_n}_{label}": last_quarter_only(
            cs_rank(anti_breakout), cs_rank(to_top), cs_rank(to_mid), cs_rank(reclaim), cs_rank(fast_slope)),
    })


def compression(windows=(20, 60), deviations=2.0, atr_multiple=1.5) -> list[Factor]:
    ordered = sorted(set(windows))
    if not ordered:
        raise ValueError("windows must not be empty")
    donchian = lambda w: (ts_max(high, w) - ts_min(low, w)) / (ts_mean(close, w) + EPS)
    out = {}
    for w in ordered:
        base, atr = ts_mean(close, w) + EPS, ta.ta_atr(high, low, close, w)
        bollinger, keltner = ts_std(close, w) * (2 * deviations) / base, atr * (2 * atr_multiple) / base
        squeeze = bollinger / (keltner + EPS)
        out |= {
            f"common_bollinger_width_{w}": bollinger, f"common_bollinger_compression_{w}": bollinger * -1,
            f"common_keltner_width_{w}": keltner, f"common_keltner_compression_{w}": keltner * -1,
            f"common_squeeze_ratio_{w}": squeeze, f"common_squeeze_compression_{w}": squeeze * -1,
            f"common_donchian_width_{w}": donchian(w), f"common_donchian_compression_{w}": donchian(w) * -1,
            f"common_atr_percentile_{w}": ts_rank(atr / (close + EPS), w),
        }
    for short, long in zip(ordered, ordered[1:]):
        out |= {
            f"common_range_compression_{short}_{long}": donchian(short) / (donchian(long) + EPS) * -1,
            f"common_volume_contraction_{short}_{long}":
                ts_mean(volume, short) / (ts_mean(volume, long) + EPS) * -1,
        }
    return family("volatility_compression", out)


def trade_filters(ma=10, min_bias=0.05, min_rate=3.0, max_rate=6.5) -> list[Factor]:
    rate = col("turnover_rate")
    return family("trade_filter", {
        f"common_ma_bias_pass_{ma}": bias(close, ma) >= min_bias,
        "common_turnover_rate": rate,
        "common_turnover_rate_band": (rate >= min_rate) * (rate <= max_rate),
    })
