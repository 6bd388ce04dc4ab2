"""Recursive technical indicators, written as linear recurrences.

Each follows the public TA-Lib definition: leading missing inputs are skipped,
the first output is seeded, earlier outputs are NaN, and a NaN after the start
stays in the series. The recurrences y = a*y + b run in
``barloom.plans.panel``, which can split a long symbol over tasks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import safe
from barloom.functions.expr import (
    Expr, apply, bar_index, per_symbol, recurrence, roll, running, shift, where,
)
from barloom.functions.maths import greater

NAN = float("nan")


def _or_nan(x): return F.coalesce(safe.dbl(x), F.lit(NAN))
def _index_if_number(x, i): return F.when(~F.isnan(x), i)
def _show(pos, start, y): return F.when(pos >= start, safe.dbl(y)).otherwise(F.lit(NAN))
def _gain_a(pos, seed_at, a): return F.when(pos > seed_at, safe.dbl(a)).otherwise(F.lit(0.0))
def _gain_b(pos, seed_at, seed, b):
    return F.when(pos > seed_at, safe.dbl(b)).when(pos == seed_at, safe.dbl(seed)).otherwise(F.lit(0.0))


def number(x) -> Expr:
    """Null as NaN, the way a pandas series carries it."""
    return apply(_or_nan, x)


def since_first_number(*xs) -> Expr:
    """Bars since the first bar where every input is a number (null if never)."""
    total = xs[0] * 1.0
    for x in xs[1:]:
        total = total + x
    return bar_index() - per_symbol("min", apply(_index_if_number, number(total), bar_index()))


def seeded(pos: Expr, seed_at: int, seed, a, b, show_from: int | None = None) -> Expr:
    """Recurrence that starts with ``seed`` at ``pos == seed_at``."""
    y = recurrence(apply(_gain_a, pos, seed_at, a), apply(_gain_b, pos, seed_at, seed, b))
    return apply(_show, pos, seed_at if show_from is None else show_from, y)


def ema(x, n: int, seed_at: int | None = None, pos: Expr | None = None) -> Expr:
    """Exponential mean seeded with the simple mean of the n bars up to ``seed_at``."""
    x = number(x)
    pos = since_first_number(x) if pos is None else pos
    at = n - 1 if seed_at is None else seed_at
    k = 2.0 / (n + 1)
    return seeded(pos, at, roll("avg", x, lo=1 - n), 1.0 - k, x * k)


def wilder(x, n: int, pos: Expr, seed_at: int) -> Expr:
    """Wilder's mean: seeded with the mean of n values, then (prev*(n-1) + x)/n."""
    return seeded(pos, seed_at, roll("avg", x, lo=1 - n), (n - 1.0) / n, x / float(n))


def wilder_sum(x, n: int, pos: Expr, seed_at: int, show_from: int) -> Expr:
    """Wilder's running sum: n-1 values added up, then prev - prev/n + x."""
    return seeded(pos, seed_at, roll("sum", x, lo=2 - n), 1.0 - 1.0 / n, x, show_from)


def _ratio_100(up, both): return F.when(both == 0, both * 0.0).otherwise(100.0 * safe.safe_div(up, both))


def _gain_loss(x, n: int) -> tuple[Expr, Expr]:
    x = number(x)
    pos, step = since_first_number(x), x - shift(x, 1)
    return (
        wilder(greater(step, 0.0), n, pos, n),
        wilder(greater(-step, 0.0), n, pos, n),
    )


def ta_rsi(x, n: int = 14) -> Expr:
    up, down = _gain_loss(x, n)
    return apply(_ratio_100, up, up + down)


def cmo(x, n: int = 14) -> Expr:
    up, down = _gain_loss(x, n)
    return apply(_ratio_100, up - down, up + down)


def true_range(high, low, close) -> Expr:
    before = shift(number(close), 1)
    high, low = number(high), number(low)
    return greater(greater(high - low, abs(high - before)), abs(low - before))


def ta_atr(high, low, close, n: int = 14) -> Expr:
    pos = since_first_number(high, low, close)
    tr = true_range(high, low, close)
    if n <= 1:
        return apply(_show, pos, 1, tr)
    return wilder(tr, n, pos, n)


def natr(high, low, close, n: int = 14) -> Expr:
    return ta_atr(high, low, close, n) / close * 100.0


def ta_ema(x, n: int) -> Expr:
    return ema(x, n)


def macd(x, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[Expr, Expr, Expr]:
    """DIF, DEA and their difference.

    Both means are seeded on the slow warm-up bar, and all three outputs start
    where the signal line does.
    """
    if slow < fast:
        fast, slow = slow, fast
    x = number(x)
    pos = since_first_number(x)
    line = ema(x, fast, seed_at=slow - 1, pos=pos) - ema(x, slow, pos=pos)
    first = slow + signal - 2
    dea = ema(line, signal, seed_at=first, pos=pos)
    dif = apply(_show, pos, first, line)
    return dif, dea, dif - dea


def ta_macd_dif(x, fast=12, slow=26, signal=9) -> Expr: return macd(x, fast, slow, signal)[0]
def ta_macd_dea(x, fast=12, slow=26, signal=9) -> Expr: return macd(x, fast, slow, signal)[1]
def ta_macd_hist(x, fast=12, slow=26, signal=9) -> Expr: return macd(x, fast, slow, signal)[2]


# -------------------------------------------------- directional movement family
def _plus_move(up, down): return F.when((up > 0) & (up > down), up).otherwise(F.lit(0.0))


def _moves(high, low) -> tuple[Expr, Expr]:
    up = number(high) - shift(number(high), 1)
    down = shift(number(low), 1) - number(low)
    return apply(_plus_move, up, down), apply(_plus_move, down, up)


def plus_dm(high, low, n: int = 14) -> Expr:
    pos = since_first_number(high, low)
    return wilder_sum(_moves(high, low)[0], n, pos, n - 1, n - 1)


def minus_dm(high, low, n: int = 14) -> Expr:
    pos = since_first_number(high, low)
    return wilder_sum(_moves(high, low)[1], n, pos, n - 1, n - 1)


def _directional(high, low, close, n: int):
    pos = since_first_number(high, low, close)
    up, down = _moves(high, low)
    tr = wilder_sum(true_range(high, low, close), n, pos, n - 1, n)
    return (
        pos,
        apply(_ratio_100, wilder_sum(up, n, pos, n - 1, n), tr),
        apply(_ratio_100, wilder_sum(down, n, pos, n - 1, n), tr),
    )


def plus_di(high, low, close, n: int = 14) -> Expr: return _directional(high, low, close, n)[1]
def minus_di(high, low, close, n: int = 14) -> Expr: return _directional(high, low, close, n)[2]


def _hold(total, value): return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(0.0))
def _take(total, value): return F.when(total == 0, F.lit(0.0)).otherwise(value)


def dx(high, low, close, n: int = 14) -> Expr:
    """100 * |DI+ - DI-| / (DI+ + DI-); repeats the last value where the sum is 0."""
    pos, up, down = _directional(high, low, close, n)
    total = up + down
    raw = 100.0 * (abs(up - down) / total)
    held = recurrence(apply(_hold, total, raw), apply(_take, total, raw))
    return apply(_show, pos, n, held)


def adx(high, low, close, n: int = 14) -> Expr:
    pos = since_first_number(high, low, close)
    return wilder(dx(high, low, close, n), n, pos, 2 * n - 1)


def adxr(high, low, close, n: int = 14) -> Expr:
    line = adx(high, low, close, n)
    return (line + shift(line, n - 1)) / 2.0


# ------------------------------------------------------------- other recursions
def trix(x, n: int) -> Expr:
    triple = ema(ema(ema(x, n), n), n)
    before = shift(triple, 1)
    return (triple / before - 1.0) * 100.0


def _clip_efficiency(move, path):
    return F.when((path <= move) | (path == 0), F.lit(1.0)).otherwise(F.abs(safe.safe_div(move, path)))


def kama(x, n: int = 30) -> Expr:
    """Kaufman's adaptive mean: smoothing between 2- and 30-bar constants."""
    x = number(x)
    pos = since_first_number(x)
    move = x - shift(x, n)
    path = roll("sum", abs(x - shift(x, 1)), lo=1 - n)
    fast, slow = 2.0 / 3.0, 2.0 / 31.0
    sc = apply(_clip_efficiency, move, path) * (fast - slow) + slow
    sc = sc * sc
    return seeded(pos, n - 1, x, 1.0 - sc, sc * x, show_from=n)


def adosc(high, low, close, volume, fast: int = 3, slow: int = 10) -> Expr:
    """Difference of two exponential means of the accumulation line, both seeded
    with its first value."""
    line = accumulation(high, low, close, volume)
    pos = bar_index()
    kf, ks = 2.0 / (fast + 1), 2.0 / (slow + 1)
    gap = seeded(pos, 0, line, 1 - kf, line * kf) - seeded(pos, 0, line, 1 - ks, line * ks)
    return apply(_show, pos, max(fast, slow) - 1, gap)


def _money_flow(h, l, c, v): return F.when(h > l, ((c - l) - (h - c)) / (h - l) * v).otherwise(F.lit(0.0))


def accumulation(high, low, close, volume) -> Expr:
    return running("sum", apply(_money_flow, high, low, close, volume))


def ewm(x, alpha: float, min_periods: int = 0) -> Expr:
    """``Series.ewm(alpha, adjust=False)``: a gap of missing bars decays the old value."""
    x = number(x)
    valid = apply(_is_number, x)
    gap = recurrence(apply(_zero_if, valid), apply(_one_unless, valid))
    old = apply(F.pow, 1.0 - alpha, shift(gap, 1) + 1.0)
    pos = since_first_number(x)
    keep = where(valid, old / (old + alpha), 1.0)
    add = where(valid, x * alpha / (old + alpha), 0.0)
    y = seeded(pos, 0, x, keep, add)
    seen = running("count", apply(_number_or_null, x))
    return apply(_show_null, seen, max(min_periods, 1), y)


def _is_number(x): return (~F.isnan(x)).cast("int")
def _zero_if(v): return F.when(v == 1, F.lit(0.0)).otherwise(F.lit(1.0))
def _one_unless(v): return F.when(v == 1, F.lit(0.0)).otherwise(F.lit(1.0))
def _number_or_null(x): return F.when(~F.isnan(x), x)
def _show_null(seen, need, y): return F.when(seen >= need, y)
