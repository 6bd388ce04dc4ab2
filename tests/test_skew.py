"""Plans for oversized symbols and dates give the same rows as the plain plans."""

import numpy as np
import pytest

from barloom.functions import cs, ta, ts
from barloom.functions.expr import close, high, low, per_symbol, running, volume
from barloom.operators import indicators
from barloom.plans.panel import Panel
from barloom.plans.skew import oversized, with_row_index
from tests.conftest import same

SYMBOL_OPS = {
    "mean": ts.ts_mean(close, 9), "sum": ts.ts_sum(volume, 20), "rank": ts.ts_rank(close, 6),
    "lead": ts.ts_delay(close, -4), "nested": ts.ts_max(ts.ts_delay(ts.ts_mean(close, 5), 3), 11),
    "slope": ts.ts_slope(close, 8), "resi": ts.ts_resi(close, 8), "corr": ts.ts_corr(close, volume, 7),
    "obv": indicators.obv(close, volume), "whole": per_symbol("avg", close), "peak": running("max", high),
}
DATE_OPS = {
    "rank": cs.cs_rank(volume), "mean": cs.cs_mean(close), "scale": cs.cs_scale(close), "std": cs.cs_std(close),
    "median": cs.cs_median(close), "pct": cs.cs_pct(close),
}
RECURSIVE = {
    "ema": ta.ta_ema(close, 12), "rsi": ta.ta_rsi(close, 14), "atr": ta.ta_atr(high, low, close, 14),
    "hist": ta.ta_macd_hist(close), "adx": ta.adx(high, low, close, 7), "ewm": ta.ewm(close, 0.2, 5),
}
MIXED = {
    "a": ts.ts_corr(cs.cs_rank(close), cs.cs_rank(volume), 6),
    "b": cs.cs_rank(ts.ts_mean(cs.cs_rank(ts.ts_delta(close, 2)), 4)),
    "c": cs.cs_rank(ta.ta_ema(close, 5)) + ts.ts_rank(cs.cs_rank(volume), 5),
}


@pytest.mark.parametrize("exprs", [SYMBOL_OPS, DATE_OPS, RECURSIVE, MIXED], ids=["symbol", "date", "recursive", "mixed"])
def test_hot_groups_match_plain_plan(bars, exprs):
    same(Panel(bars).select(exprs), Panel(bars, max_group_rows=3 if exprs is DATE_OPS else 25).select(exprs))


def test_mixed_with_hot_dates_and_symbols(bars):
    same(Panel(bars).select(MIXED), Panel(bars, max_group_rows=3).select(MIXED))


def test_state_walk_splits_a_long_symbol(bars):
    small = bars.select("vt_symbol", "datetime", "high", "low")
    same(indicators.sar(Panel(small)), indicators.sar(Panel(small, max_group_rows=20)))


def test_row_index_is_the_position(bars):
    got = with_row_index(bars, "vt_symbol", "datetime", 10, "i").select("vt_symbol", "datetime", "i").collect()
    by = {}
    for r in got:
        by.setdefault(r[0], []).append((r[1], r[2]))
    for rows in by.values():
        assert [i for _, i in sorted(rows)] == list(range(len(rows)))


def test_small_inputs_are_not_measured(bars):
    assert oversized(bars, ["vt_symbol"]) == {"vt_symbol": False}
    assert oversized(bars, ["vt_symbol"], 100) == {"vt_symbol": True}


def test_average_rank_with_ties_against_numpy(bars):
    rows = Panel(bars).with_columns({"v": cs.cs_rank(volume)}, keep=["volume"]).collect()
    by = {}
    for r in rows:
        by.setdefault(r["datetime"], []).append((r["volume"], r["v"]))
    for pairs in by.values():
        xs = np.array([p[0] for p in pairs])
        for x, v in pairs:
            assert v == (xs < x).sum() + ((xs == x).sum() + 1) / 2
