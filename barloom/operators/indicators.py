"""Technical indicators as columns of a bar panel.

Finite look-back indicators are window expressions; recursive ones use the
recurrences of ``barloom.functions.ta``; the parabolic stop is a state walk.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import safe, ta
from barloom.functions.expr import Expr, apply, bar_index, close, high, low, open_, roll, running, shift, volume
from barloom.functions.ts import (
    full_max, full_mean, full_min, ts_decay_linear, ts_frame, ts_std,
)
from barloom.plans.panel import Panel
from barloom.plans.statescan import state_scan


def sma(x, n: int) -> Expr: return full_mean(x, n)
def wma(x, n: int) -> Expr: return ts_decay_linear(x, n, newest_heaviest=True)
def mom(x, n: int) -> Expr: return x - shift(x, n)
def roc(x, n: int) -> Expr: return (x / shift(x, n) - 1.0) * 100.0
def rocp(x, n: int) -> Expr: return (x - shift(x, n)) / shift(x, n)
def rocr(x, n: int) -> Expr: return x / shift(x, n)
def rocr_100(x, n: int) -> Expr: return x / shift(x, n) * 100.0
def apo(x, fast: int = 12, slow: int = 26) -> Expr: return sma(x, min(fast, slow)) - sma(x, max(fast, slow))


def ppo(x, fast: int = 12, slow: int = 26) -> Expr:
    fast, slow = min(fast, slow), max(fast, slow)
    return (sma(x, fast) - sma(x, slow)) / sma(x, slow) * 100.0


def _full_std(s, c, n): return F.when(c == n, s)
def std(x, n: int, nbdev: float = 1.0) -> Expr:
    return apply(_full_std, ts_std(x, n), roll("count", x, lo=1 - n), n) * nbdev


def _signed(v, step): return F.when(step.isNull(), v).when(step > 0, v).when(step < 0, -v).otherwise(F.lit(0.0))
def obv(x, vol) -> Expr:
    """Cumulative volume signed by the price step; the first bar counts its volume."""
    return running("sum", apply(_signed, vol, x - shift(x, 1)))


def _mean_distance(values, mean, n):
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - mean)) / n


def _cci(tp, mean, dev): return F.when((tp - mean == 0) | (dev == 0), dev * 0.0).otherwise(
    safe.safe_div(tp - mean, 0.015 * dev))


def cci(h=high, l=low, c=close, n: int = 14) -> Expr:
    tp = (h + l + c) / 3.0
    mean = sma(tp, n)
    return apply(_cci, tp, mean, apply(_mean_distance, ts_frame(tp, n), mean, float(n)))


def _willr(c, hi, lo): return F.when(hi - lo == 0, (hi - lo) * 0.0).otherwise(safe.safe_div(hi - c, hi - lo) * -100.0)
def willr(h=high, l=low, c=close, n: int = 14) -> Expr:
    return apply(_willr, c, full_max(h, n), full_min(l, n))


def trange(h=high, l=low, c=close) -> Expr:
    """True range; the first bar has no previous close and stays NaN."""
    return apply(_from_second, bar_index(), ta.true_range(h, l, c))


def _from_second(i, x): return F.when(i > 0, x).otherwise(F.lit(float("nan")))


def boll(x=close, n: int = 20, dev: float = 2.0) -> tuple[Expr, Expr]:
    return sma(x, n) + std(x, n) * dev, sma(x, n) - std(x, n) * dev


def keltner(n: int = 20, dev: float = 2.0) -> tuple[Expr, Expr]:
    width = ta.ta_atr(high, low, close, n) * dev
    return sma(close, n) + width, sma(close, n) - width


def donchian(n: int = 20) -> tuple[Expr, Expr]:
    return full_max(high, n), full_min(low, n)


def _newest(values, best):
    """1-based position from the oldest bar of the most recent best value."""
    return F.size(values) + 1 - F.array_position(F.reverse(values), best)


def aroon(n: int = 14) -> tuple[Expr, Expr]:
    """(up, down): how recently the n+1-bar extreme was set, 0..100."""
    top = apply(_newest, ts_frame(high, n + 1), full_max(high, n + 1))
    bottom = apply(_newest, ts_frame(low, n + 1), full_min(low, n + 1))
    return (top - 1.0) * (100.0 / n), (bottom - 1.0) * (100.0 / n)


def aroonosc(n: int = 14) -> Expr:
    up, down = aroon(n)
    return up - down


def _flow_up(tp, before, flow): return F.when(tp > before, flow).otherwise(F.lit(0.0))
def _mfi(pos, neg): return F.when(pos + neg < 1.0, (pos + neg) * 0.0).otherwise(safe.safe_div(pos, pos + neg) * 100.0)


def mfi(n: int = 14) -> Expr:
    tp = (high + low + close) / 3.0
    before = shift(tp, 1)
    flow = tp * volume
    up = roll("sum", apply(_flow_up, tp, before, flow), lo=1 - n)
    down = roll("sum", apply(_flow_up, before, tp, flow), lo=1 - n)
    return apply(_after, bar_index(), n, apply(_mfi, up, down))


def _after(i, n, x): return F.when(i >= n, x)


def _true_low(l, before): return F.least(l, before)
def ultosc(n1: int = 7, n2: int = 14, n3: int = 28) -> Expr:
    before = shift(close, 1)
    pressure = close - apply(_true_low, low, before)
    tr = ta.true_range(high, low, close)
    part = lambda n: roll("sum", pressure, lo=1 - n) / roll("sum", tr, lo=1 - n)
    return apply(_after, bar_index(), max(n1, n2, n3), (part(n1) * 4.0 + part(n2) * 2.0 + part(n3)) * (100.0 / 7.0))


def _bop(o, h, l, c): return F.when(h - l < 1e-14, F.lit(0.0)).otherwise((c - o) / (h - l))
def bop() -> Expr: return apply(_bop, open_, high, low, close)


def stoch(fastk: int = 5, slowk: int = 3, slowd: int = 3) -> tuple[Expr, Expr]:
    lowest, highest = full_min(low, fastk), full_max(high, fastk)
    raw = apply(_fast_k, close, highest, lowest)
    k = sma(raw, slowk)
    d = sma(k, slowd)
    return apply(_both, k, d), d


def _fast_k(c, hi, lo): return F.when(hi - lo == 0, (hi - lo) * 0.0).otherwise(safe.safe_div(c - lo, hi - lo) * 100.0)
def _both(k, d): return F.when(d.isNotNull(), k)


def sar(panel: Panel, acceleration: float = 0.02, maximum: float = 0.2) -> DataFrame:
    """Parabolic stop-and-reverse in a new column ``sar`` (first bar NaN).

    The initial side comes from the first directional move. State between bars:
    (bars seen, is long, next stop, extreme, factor, previous high, previous low).
    """
    step, top = min(acceleration, maximum), maximum

    def kernel(state, pdf):
        hs, ls = pdf["high"].to_numpy(float), pdf["low"].to_numpy(float)
        out = np.full(len(pdf), np.nan)
        seen, is_long, stop, ep, af, ph, pl = state
        for i in range(len(pdf)):
            h, l = hs[i], ls[i]
            if seen == 0:
                seen, ph, pl = 1.0, h, l
                continue
            if seen == 1:
                down = pl - l
                is_long = 0.0 if (down > 0 and down > h - ph) else 1.0
                ep, stop, af = (h, pl, step) if is_long else (l, ph, step)
                ph, pl = h, l  # the second bar is its own predecessor
                seen = 2.0
            if is_long:
                if l <= stop:
                    is_long = 0.0
                    stop = max(ep, ph, h)
                    out[i] = stop
                    af, ep = step, l
                    stop = max(stop + af * (ep - stop), ph, h)
                else:
                    out[i] = stop
                    if h > ep:
                        ep, af = h, min(af + step, top)
                    stop = min(stop + af * (ep - stop), pl, l)
            else:
                if h >= stop:
                    is_long = 1.0
                    stop = min(ep, pl, l)
                    out[i] = stop
                    af, ep = step, h
                    stop = min(stop + af * (ep - stop), pl, l)
                else:
                    out[i] = stop
                    if l < ep:
                        ep, af = l, min(af + step, top)
                    stop = max(stop + af * (ep - stop), ph, h)
            ph, pl = h, l
        return np.array([seen, is_long, stop, ep, af, ph, pl]), {"sar": out}

    return state_scan(panel, kernel, (0.0,) * 7, ["sar"])


def macd_lines(x=close, fast=12, slow=26, signal=9) -> tuple[Expr, Expr, Expr]:
    return ta.macd(x, fast, slow, signal)


# recursive indicators under the names of the array interface
ema, rsi, atr, natr, cmo, trix, kama = ta.ta_ema, ta.ta_rsi, ta.ta_atr, ta.natr, ta.cmo, ta.trix, ta.kama
adx, adxr, dx, plus_di, minus_di = ta.adx, ta.adxr, ta.dx, ta.plus_di, ta.minus_di
plus_dm, minus_dm, ad, adosc = ta.plus_dm, ta.minus_dm, ta.accumulation, ta.adosc
