"""The parallel prefix gives the serial walk, over batches, restarts, NaN and underflow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import ta
from barloom.functions.expr import close
from barloom.plans.panel import Panel
from barloom.plans.prefix import affine_scan, restarts_in_group, scan_rows
from tests.conftest import same


def serial(a, b, first):
    y, p, r = np.empty_like(b), np.empty_like(b), np.zeros(b.shape, bool)
    state, product, seen = np.zeros(b.shape[1]), np.ones(b.shape[1]), np.zeros(b.shape[1], bool)
    for t in range(len(b)):
        if first[t]:
            state, product, seen = np.zeros(b.shape[1]), np.ones(b.shape[1]), np.zeros(b.shape[1], bool)
        with np.errstate(all="ignore"):
            state = np.where(a[t] == 0, b[t], a[t] * np.where(first[t], 0.0, state) + b[t])
            product = product * a[t]
        seen = seen | (a[t] == 0)
        y[t], p[t], r[t] = state, product, seen
    return y, p, r


@pytest.mark.parametrize("seed", range(6))
def test_prefix_equals_the_serial_walk(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 400)), 3
    a, b = rng.choice([0.0, 0.5, 0.93, 1.0], (n, k), p=[0.05, 0.35, 0.5, 0.1]), rng.normal(size=(n, k))
    first = rng.random(n) < 0.05
    first[0] = True
    y, p, r = affine_scan(a, b, first)
    wy, wp, wr = serial(a, b, first)
    np.testing.assert_allclose(y, wy, rtol=1e-11, atol=1e-13)
    assert (restarts_in_group(a, first) == wr).all()
    np.testing.assert_allclose(np.where(wr, 0, p), np.where(wr, 0, wp), rtol=1e-9, atol=1e-290)


def test_nan_outlives_underflow_but_not_a_restart():
    a, b = np.full((5000, 1), 0.3), np.ones((5000, 1))
    b[7], a[4500] = np.nan, 0.0
    y, *_ = affine_scan(a, b)
    assert not np.isnan(y[:7]).any() and np.isnan(y[7:4500]).all() and not np.isnan(y[4500:]).any()


def test_rows_over_many_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(s, t, float(rng.choice([0.0, 0.9, 0.5], p=[0.1, 0.6, 0.3])), float(rng.normal())) for s, n in (("A", 50), ("B", 1), ("C", 33)) for t in range(n)]
    df = spark.createDataFrame(rows, "s string, t int, a double, b double").orderBy(F.rand(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.s, r.t): (r.y, r.p, r.r) for r in scan_rows(df, ["s"], "t", ["s", "t"], [("a", "b")], [("y", "p", "r")]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in "ABC":
        own = [r for r in rows if r[0] == s]
        wy, wp, wr = serial(np.array([[r[2]] for r in own]), np.array([[r[3]] for r in own]), np.arange(len(own)) == 0)
        for i, r in enumerate(own):
            y, p, seen = got[s, r[1]]
            assert abs(y - wy[i, 0]) < 1e-10 and seen == wr[i, 0] and (seen or abs(p - wp[i, 0]) < 1e-10)


def test_windows_and_recurrence_share_one_exchange(spark, bars):
    plan = Panel(bars).select({"e": ta.ta_ema(close, 12)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(vt_symbol") == 1 and "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_all_rows_stay(spark, bars):
    same(Panel(bars).select({"e": ta.ta_ema(close, 12)}).select("vt_symbol", "datetime"), bars.select("vt_symbol", "datetime"))
