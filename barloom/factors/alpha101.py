"""The published "101 formulaic alphas" that need no industry or cap data (82).

Formulas and constants are fixed values: they must equal the published set (with
the adjustments of the compatible platform: sign-keeping powers, comparisons as
0/1, decay weights from the oldest bar) for results to agree.
"""

from __future__ import annotations

from barloom.factors.spec import Factor, family
from barloom.functions.cs import cs_rank as rank
from barloom.functions.cs import cs_scale as scale
from barloom.functions.expr import Expr, close, high, low, open_, volume, vwap
from barloom.functions.maths import log, pow1, pow2, quesval, quesval2, sign
from barloom.functions.ts import (
    ts_argmax as argmax, ts_argmin as argmin, ts_corr as corr, ts_cov as cov,
    ts_decay_linear as decay, ts_delay as delay, ts_delta as delta, ts_greater as larger,
    ts_less as smaller, ts_max as tmax, ts_mean as mean, ts_min as tmin, ts_product as product,
    ts_rank as trank, ts_std as std, ts_sum as tsum,
)

returns = close / delay(close, 1) - 1.0


def adv(n: int) -> Expr:
    """Average volume of the last n bars."""
    return mean(volume, n)


def blend(x: Expr, y: Expr, w: float) -> Expr:
    return x * w + y * (1 - w)


def curvature() -> Expr:
    """Slope of the older ten bars minus slope of the newer ten bars."""
    return (delay(close, 20) - delay(close, 10)) / 10.0 - (delay(close, 10) - close) / 10.0


def formulas() -> dict[str, Expr]:
    mid = (high + low) / 2.0
    d1 = delta(close, 1)
    a: dict[int, Expr] = {}
    a[1] = rank(argmax(pow1(quesval(0, returns, close, std(returns, 20)), 2.0), 5)) - 0.5
    a[2] = corr(rank(delta(log(volume), 2)), rank((close - open_) / open_), 6) * -1
    a[3] = corr(rank(open_), rank(volume), 10) * -1
    a[4] = trank(rank(low), 9) * -1
    a[5] = rank(open_ - tsum(vwap, 10) / 10.0) * (abs(rank(close - vwap)) * -1)
    a[6] = corr(open_, volume, 10) * -1
    a[7] = quesval2(adv(20), volume, trank(abs(close - delay(close, 7)), 60) * -1 * sign(delta(close, 7)), -1)
    sums = tsum(open_, 5) * tsum(returns, 5)
    a[8] = rank(sums - delay(sums, 10)) * -1
    steady = lambda n: quesval(0, tmin(d1, n), d1, quesval(0, tmax(d1, n), d1 * -1, d1))
    a[9] = steady(5)
    a[10] = rank(steady(4))
    a[11] = (rank(tmax(vwap - close, 3)) + rank(tmin(vwap - close, 3))) * rank(delta(volume, 3))
    a[12] = sign(delta(volume, 1)) * (d1 * -1)
    a[13] = rank(cov(rank(close), rank(volume), 5)) * -1
    a[14] = rank(returns - delay(returns, 3)) * -1 * corr(open_, volume, 10)
    a[15] = tsum(rank(corr(rank(high), rank(volume), 3)), 3) * -1
    a[16] = rank(cov(rank(high), rank(volume), 5)) * -1
    a[17] = (rank(trank(close, 10)) * -1 * rank(close - delay(close, 1) * 2 + delay(close, 2))
             * rank(trank(volume / adv(20), 5)))
    a[18] = rank(std(abs(close - open_), 5) + (close - open_) + corr(close, open_, 10)) * -1
    a[19] = sign(delta(close, 7) + (close - delay(close, 7))) * -1 * (rank(tsum(returns, 250) + 1) + 1)
    a[20] = rank(open_ - delay(high, 1)) * -1 * rank(open_ - delay(close, 1)) * rank(open_ - delay(low, 1))
    a[21] = quesval2(
        mean(close, 8) + std(close, 8), mean(close, 2), -1,
        quesval2(mean(close, 2), mean(close, 8) - std(close, 8), 1, quesval(1, volume / adv(20), 1, -1)),
    )
    a[22] = delta(corr(high, volume, 5), 5) * -1 * rank(std(close, 20))
    a[23] = quesval2(mean(high, 20), high, delta(high, 2) * -1, 0)
    a[24] = quesval(0.05, delta(tsum(close, 100) / 100.0, 100) / delay(close, 100),
                    delta(close, 3) * -1, (close - tmin(close, 100)) * -1)
    a[25] = rank(returns * -1 * adv(20) * vwap * (high - close))
    a[26] = tmax(corr(trank(volume, 5), trank(high, 5), 5), 3) * -1
    a[27] = quesval(0.5, rank(mean(corr(rank(volume), rank(vwap), 6), 2)), -1, 1)
    a[28] = scale(corr(adv(20), low, 5) + mid - close)
    inner = rank(rank(rank(delta(close - 1, 5)) * -1))
    a[29] = (tmin(product(rank(rank(scale(log(tsum(tmin(inner, 2), 1))))), 1), 5)
             + trank(delay(returns * -1, 6), 5))
    step = lambda k: sign(delay(close, k) - delay(close, k + 1))
    a[30] = (rank(step(0) + step(1) + step(2)) * -1 + 1) * tsum(volume, 5) / tsum(volume, 20)
    a[31] = (rank(rank(rank(decay(rank(rank(delta(close, 10))) * -1, 10)))) + rank(delta(close, 3) * -1)
             + sign(scale(corr(adv(20), low, 12))))
    a[32] = scale(tsum(close, 7) / 7.0 - close) + scale(corr(vwap, delay(close, 5), 230)) * 20
    a[33] = rank((open_ / close * -1 + 1) * -1)
    a[34] = rank((rank(std(returns, 2) / std(returns, 5)) * -1 + 1) + (rank(d1) * -1 + 1))
    a[35] = trank(volume, 32) * (trank(close + high - low, 16) * -1 + 1) * (trank(returns, 32) * -1 + 1)
    a[36] = (rank(corr(close - open_, delay(volume, 1), 15)) * 2.21 + rank(open_ - close) * 0.7
             + rank(trank(delay(returns * -1, 6), 5)) * 0.73 + rank(abs(corr(vwap, adv(20), 6)))
             + rank((tsum(close, 200) / 200.0 - open_) * (close - open_)) * 0.6)
    a[37] = rank(corr(delay(open_ - close, 1), close, 200)) + rank(open_ - close)
    a[38] = rank(trank(close, 10)) * -1 * rank(close / open_)
    a[39] = (rank(delta(close, 7) * (rank(decay(volume / adv(20), 9)) * -1 + 1)) * -1
             * (rank(tsum(returns, 250)) + 1))
    a[40] = rank(std(high, 10)) * -1 * corr(high, volume, 10)
    a[41] = pow1(high * low, 0.5) - vwap
    a[42] = rank(vwap - close) / rank(vwap + close)
    a[43] = trank(volume / adv(20), 20) * trank(delta(close, 7) * -1, 8)
    a[44] = corr(high, rank(volume), 5) * -1
    a[45] = (rank(tsum(delay(close, 5), 20) / 20.0) * -1 * corr(close, volume, 2)
             * rank(corr(tsum(close, 5), tsum(close, 20), 2)))
    bend, down = curvature(), (close - delay(close, 1)) * -1
    a[46] = quesval(0.25, bend, -1, quesval(0, bend, down, 1))
    a[47] = (rank(pow1(close, -1)) * volume / adv(20) * (high * rank(high - close)) / (tsum(high, 5) / 5.0)
             - rank(vwap - delay(vwap, 5)))
    a[49] = quesval(-0.1, bend, down, 1)
    a[50] = tmax(rank(corr(rank(volume), rank(vwap), 5)), 5) * -1
    a[51] = quesval(-0.05, bend, down, 1)
    a[52] = ((tmin(low, 5) * -1 + delay(tmin(low, 5), 5))
             * rank((tsum(returns, 240) - tsum(returns, 20)) / 220.0) * trank(volume, 5))
    a[53] = delta(((close - low) - (high - close)) / (close - low), 9) * -1
    a[54] = (low - close) * pow1(open_, 5) * -1 / ((low - high) * pow1(close, 5))
    a[55] = corr(rank((close - tmin(low, 12)) / (tmax(high, 12) - tmin(low, 12))), rank(volume), 6) * -1
    a[57] = (close - vwap) / decay(rank(argmax(close, 30)), 2) * -1
    a[60] = (scale(rank(((close - low) - (high - close)) / (high - low) * volume)) * 2
             - scale(rank(argmax(close, 10)))) * -1
    a[61] = quesval2(rank(vwap - tmin(vwap, 16)), rank(corr(vwap, adv(180), 18)), 1, 0)
    a[62] = (rank(corr(vwap, tsum(adv(20), 22), 10))
             < rank((rank(open_) + rank(open_)) < (rank(mid) + rank(high)))) * -1
    a[64] = (rank(corr(tsum(blend(open_, low, 0.178404), 13), tsum(adv(120), 13), 17))
             < rank(delta(blend(mid, vwap, 0.178404), 4))) * -1
    a[65] = (rank(corr(blend(open_, vwap, 0.00817205), tsum(adv(60), 9), 6))
             < rank(open_ - tmin(open_, 14))) * -1
    a[66] = (rank(decay(delta(vwap, 4), 7))
             + trank(decay((blend(low, low, 0.96633) - vwap) / (open_ - mid), 11), 7)) * -1
    a[68] = (trank(corr(rank(high), rank(adv(15)), 9), 14) < rank(delta(blend(close, low, 0.518371), 1))) * -1
    a[71] = larger(
        trank(decay(corr(trank(close, 3), trank(adv(180), 12), 18), 4), 16),
        trank(decay(pow1(rank((low + open_) - (vwap + vwap)), 2), 16), 4),
    )
    a[72] = (rank(decay(corr(mid, adv(40), 9), 10))
             / rank(decay(corr(trank(vwap, 4), trank(volume, 19), 7), 3)))
    mix = open_ * 0.147155 + low * 0.852845
    a[73] = larger(rank(decay(delta(vwap, 5), 3)), trank(decay(delta(mix, 2) / mix * -1, 3), 17)) * -1
    a[74] = quesval2(rank(corr(close, tsum(adv(30), 37), 15)),
                     rank(corr(rank(high * 0.0261661 + vwap * 0.9738339), rank(volume), 11)), 1, 0) * -1
    a[75] = quesval2(rank(corr(vwap, volume, 4)), rank(corr(rank(low), rank(adv(50)), 12)), 1, 0)
    a[77] = smaller(rank(decay((mid + high) - (vwap + high), 20)), rank(decay(corr(mid, adv(40), 3), 6)))
    a[78] = pow2(rank(corr(tsum(blend(low, vwap, 0.352233), 20), tsum(adv(40), 20), 7)),
                 rank(corr(rank(vwap), rank(volume), 6)))
    a[81] = quesval2(rank(log(product(rank(pow1(rank(corr(vwap, tsum(adv(10), 50), 8)), 4)), 15))),
                     rank(corr(rank(vwap), rank(volume), 5)), 1, 0) * -1
    spread = (high - low) / (tsum(close, 5) / 5.0)
    a[83] = rank(delay(spread, 2)) * rank(rank(volume)) / (spread / (vwap - close))
    a[84] = pow2(trank(vwap - tmax(vwap, 15), 21), delta(close, 5))
    a[85] = pow2(rank(corr(high * 0.876703 + close * 0.123297, adv(30), 10)),
                 rank(corr(trank(mid, 4), trank(volume, 10), 7)))
    a[86] = quesval2(trank(corr(close, tsum(adv(20), 15), 6), 20),
                     rank((open_ + close) - (vwap + open_)), 1, 0) * -1
    a[88] = smaller(rank(decay((rank(open_) + rank(low)) - (rank(high) + rank(close)), 8)),
                    trank(decay(corr(trank(close, 8), trank(adv(60), 21), 8), 7), 3))
    a[92] = smaller(trank(decay(quesval2(mid + close, low + open_, 1, 0), 15), 19),
                    trank(decay(corr(rank(low), rank(adv(30)), 8), 7), 7))
    a[94] = pow2(rank(vwap - tmin(vwap, 12)), trank(corr(trank(vwap, 20), trank(adv(60), 4), 18), 3)) * -1
    a[95] = quesval2(rank(open_ - tmin(open_, 12)),
                     trank(pow1(rank(corr(tsum(mid, 19), tsum(adv(40), 19), 13)), 5), 12), 1, 0)
    a[96] = larger(
        trank(decay(corr(rank(vwap), rank(volume), 4), 4), 8),
        trank(decay(argmax(corr(trank(close, 7), trank(adv(60), 4), 4), 13), 14), 13),
    ) * -1
    a[98] = (rank(decay(corr(vwap, tsum(adv(5), 26), 5), 7))
             - rank(decay(trank(argmin(corr(rank(open_), rank(adv(15)), 21), 9), 7), 8)))
    a[99] = quesval2(rank(corr(tsum(mid, 20), tsum(adv(60), 20), 9)), rank(corr(low, volume, 6)), 1, 0) * -1
    a[101] = (close - open_) / (high - low + 0.001)
    return {f"alpha{k}": v for k, v in a.items()}


def factors() -> list[Factor]:
    return family("alpha101", formulas())
