"""The 158-feature price/volume set: 9 candle shapes, 4 price ratios, 29 rolling
features over 5, 10, 20, 30 and 60 bars."""

from __future__ import annotations

from barloom.factors.spec import Factor, family
from barloom.functions.expr import Expr, close, col, high, low, open_, shift, volume
from barloom.functions.ts import (
    ts_abs, ts_argmax, ts_argmin, ts_corr, ts_greater, ts_less, ts_log, ts_max, ts_mean, ts_min,
    ts_quantile, ts_rank, ts_resi, ts_rsquare, ts_slope, ts_std, ts_sum,
)

WINDOWS = (5, 10, 20, 30, 60)
EPS = 1e-12


def label() -> Expr:
    """Return from the next close to the third close after the signal."""
    return shift(close, -3) / shift(close, -1) - 1.0


def candle_features() -> dict[str, Expr]:
    span = high - low + EPS
    top, bottom = ts_greater(open_, close), ts_less(open_, close)
    mid_shift = close * 2.0 - high - low
    return {
        "kmid": (close - open_) / open_, "klen": (high - low) / open_, "kmid_2": (close - open_) / span,
        "kup": (high - top) / open_, "kup_2": (high - top) / span,
        "klow": (bottom - low) / open_, "klow_2": (bottom - low) / span,
        "ksft": mid_shift / open_, "ksft_2": mid_shift / span,
    } | {f"{name}_0": col(name) / close for name in ("open", "high", "low", "vwap")}


def _rise_share(x: Expr, w: int) -> tuple[Expr, Expr, Expr]:
    """Up moves, down moves and their difference over all absolute moves."""
    before = shift(x, 1)
    moves = ts_sum(ts_abs(x - before), w) + EPS
    up, down = ts_sum(ts_greater(x - before, 0), w), ts_sum(ts_greater(before - x, 0), w)
    return up / moves, down / moves, (up - down) / moves


def rolling_features(w: int) -> dict[str, Expr]:
    before = shift(close, 1)
    lowest, highest = ts_min(low, w), ts_max(high, w)
    up_days, down_days = ts_mean(close > before, w), ts_mean(close < before, w)
    flow = ts_abs(close / before - 1.0) * volume
    sump, sumn, sumd = _rise_share(close, w)
    vsump, vsumn, vsumd = _rise_share(volume, w)
    return {
        "roc": shift(close, w) / close, "ma": ts_mean(close, w) / close, "std": ts_std(close, w) / close,
        "beta": ts_slope(close, w) / close, "rsqr": ts_rsquare(close, w), "resi": ts_resi(close, w) / close,
        "max": highest / close, "min": lowest / close,
        "qtlu": ts_quantile(close, w, 0.8) / close, "qtld": ts_quantile(close, w, 0.2) / close,
        "rank": ts_rank(close, w), "rsv": (close - lowest) / (highest - lowest + EPS),
        "imax": ts_argmax(high, w) / w, "imin": ts_argmin(low, w) / w,
        "imxd": (ts_argmax(high, w) - ts_argmin(low, w)) / w,
        "corr": ts_corr(close, ts_log(volume + 1), w),
        "cord": ts_corr(close / before, ts_log(volume / shift(volume, 1) + 1), w),
        "cntp": up_days, "cntn": down_days, "cntd": up_days - down_days,
        "sump": sump, "sumn": sumn, "sumd": sumd,
        "vma": ts_mean(volume, w) / (volume + EPS), "vstd": ts_std(volume, w) / (volume + EPS),
        "wvma": ts_std(flow, w) / (ts_mean(flow, w) + EPS),
        "vsump": vsump, "vsumn": vsumn, "vsumd": vsumd,
    }


def factors(windows: tuple[int, ...] = WINDOWS) -> list[Factor]:
    by_window = [rolling_features(w) for w in windows]
    rolled = {f"{kind}_{w}": features[kind] for kind in by_window[0] for w, features in zip(windows, by_window)}
    return family("alpha158", candle_features() | rolled)
