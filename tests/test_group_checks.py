"""Group sizes are measured once for a chain of panels, in one pass for all keys."""

from pyspark.sql import functions as F

from barloom.operators import evaluate
from barloom.plans import skew


def test_one_pass_for_all_keys(bars):
    assert skew.oversized(bars, ["vt_symbol", "datetime"], 100) == {"vt_symbol": True, "datetime": False}
    assert skew.oversized(bars, ["vt_symbol", "datetime"], 2) == {"vt_symbol": True, "datetime": True}
    assert skew.oversized(bars.limit(0), ["vt_symbol"], 2) == {"vt_symbol": False}


def test_backtest_measures_its_input_only(bars, monkeypatch):
    seen, real = [], skew.oversized
    monkeypatch.setattr(skew, "oversized", lambda df, keys, limit=None: seen.append(keys) or real(df, keys, limit))
    df = bars.withColumn("factor", F.col("volume") / F.col("close"))
    for run in (evaluate.quantile_backtest, evaluate.quantile_returns):
        seen.clear()
        assert run(df).count() > 0
        assert seen == [["vt_symbol", "datetime"]]
