"""Plans that replace single buffers, year joins and driver loops, against brute force."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import evaluate, minute, models, portfolio
from barloom.operators.events import jumps
from barloom.plans import gram, intervals, quantiles
from barloom.sources import tables

D0 = dt.date(2020, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=int(n))


@pytest.mark.parametrize("inside,accuracy", [(200_000, 10_000), (5, 20), (1, 10)])
def test_exact_quantiles_equal_numpy(spark, monkeypatch, inside, accuracy):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(quantiles, "INSIDE", inside)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    n = 700
    columns = {"even": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "far": 10.0 ** rng.integers(-200, 200, n), "one": np.full(n, 2.5)}
    rows = [tuple(float(columns[c][i]) for c in columns) + (None if i % 3 else float(i), float("nan") if i % 2 else 1.0 * i) for i in range(n)]
    df = spark.createDataFrame(rows, "even double, ties double, far double, one double, gaps double, nans double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.777, 1.0]
    got = quantiles.exact_quantiles(df, list(df.columns), probs)
    for name, values in (columns | {"gaps": np.arange(0, n, 3.0), "nans": np.arange(0, n, 2.0)}).items():
        np.testing.assert_allclose(got[name], np.quantile(values, probs), rtol=1e-12)
    assert quantiles.exact_quantiles(df.where("false"), ["even"], [0.5]) == {"even": [None]}


def test_quintiles_need_enough_values(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(70)] + [(None,)], "x double")
    got = {r.x: r.x_q for r in minute.quintiles(df, "x").collect()}
    edges = np.quantile([i % 7 for i in range(70)], [0.2, 0.4, 0.6, 0.8])
    assert got == {float(v): int((edges < v).sum()) + 1 for v in range(7)} | {None: None}
    assert {r.x_q for r in minute.quintiles(df.where("x < 3"), "x").collect()} == {None}


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 158)) @ rng.normal(size=(158, 158)) * 0.05
    x[:, 5] = 0.25
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], [f"c{i}" for i in range(158)])
    out = gram.correlations(df, df.columns)
    got = {(r.factor, r.other): r.corr for r in out.collect()}
    assert len(got) == 158 ** 2
    with np.errstate(all="ignore"):
        want = np.corrcoef(x, rowvar=False)
    for i in range(158):
        for j in range(158):
            value = got[f"c{i}", f"c{j}"]
            assert np.isnan(value) if 5 in (i, j) else abs(value - want[i, j]) < 1e-9


def test_rank_correlation_takes_rows_with_every_factor(spark):
    rows = [(dt.datetime(2024, 1, 1 + d), f"S{s}", float((s * 7 + d) % 5), float(s), None if s == 3 else float(-s)) for d in range(4) for s in range(6)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, vt_symbol string, a double, b double, c double")
    got = {(r.factor, r.other): r.corr for r in evaluate.rank_correlation(df, ["a", "b", "c"]).collect()}
    assert abs(got["b", "c"] + 1) < 0.03 and got["a", "b"] == got["b", "a"] and got["a", "a"] == 1.0


def test_lasso_path_is_one_pass_and_optimal(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    y = x @ [1.0, -0.5, 0.0, 0.2] + rng.normal(size=400) * 0.1
    rows = [(dt.datetime(2024, 1, 1), f"S{i}", *map(float, x[i]), float(y[i])) for i in range(400)] + [(dt.datetime(2024, 1, 1), "bad", float("inf"), 1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, vt_symbol string, a double, b double, c double, d double, label double")
    path = models.lasso_path(df, list("abcd"), [0.3, 0.01, 0.0])
    for alpha, model in path.items():
        w = np.array(model.coefficients)
        slope = x.T @ (x @ w - y) / 400  # optimality of the L1 problem
        assert np.all(np.where(w != 0, np.abs(slope + alpha * np.sign(w)) < 1e-9, np.abs(slope) <= alpha + 1e-9))
    np.testing.assert_allclose(path[0.0].coefficients, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-9)
    got = {r.alpha: r.mse for r in models.grid_search(df, df, list("abcd"), [0.3, 0.01]).collect()}
    for alpha in got:
        assert abs(got[alpha] - np.mean((x @ path[alpha].coefficients - y) ** 2)) < 1e-10
    assert {r.feature for r in path[0.3].detail(spark).collect()} == {"a", "b"}
    assert path[0.01].predict(df).where("vt_symbol = 'bad'").first().signal == pytest.approx(sum(path[0.01].coefficients[1:3]))


def test_cooldown_chain_equals_the_walk():
    rng = np.random.default_rng(6)
    for _ in range(200):
        bars = np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(float)
        last, gap, want = float(rng.integers(-5, 20)), int(rng.integers(0, 9)), []
        seen = last
        for i, b in enumerate(bars):
            if b - seen > gap:
                want.append(i)
                seen = b
        assert jumps(bars, last, gap).tolist() == want


@pytest.fixture(scope="module")
def ranges(spark):
    rng = np.random.default_rng(8)
    days = sorted(rng.choice(900, 500, replace=False).tolist())
    made = [("A" if rng.random() < 0.7 else "B", int(a), int(a + rng.integers(0, 90))) for a in rng.integers(0, 880, 60)]
    taken = [("A" if rng.random() < 0.7 else "C", int(a), int(a + rng.integers(0, 60))) for a in rng.integers(0, 880, 40)]
    frame = lambda rows: spark.createDataFrame([(k, day(a), day(b), f"{k}{a}-{b}") for k, a, b in rows], "k string, start date, stop date, name string")
    calendar = spark.createDataFrame([(day(d),) for d in days], "d date")
    return days, made, taken, frame(made), frame(taken), calendar


def inside(rows, days):
    return {(k, d) for k, a, b in rows for d in days if a <= d <= b}


def test_expand_takes_calendar_days_of_each_interval(spark, ranges):
    days, made, _, df, _, calendar = ranges
    got = intervals.expand(df, calendar, "k", "d", "start", "stop")
    assert {(r.k, (r.d - D0).days) for r in got.collect()} == inside(made, days)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "year(" not in plan


def test_subtracted_runs_are_maximal(ranges):
    days, made, taken, df, other, calendar = ranges
    got = [(r.k, (r.start - D0).days, (r.stop - D0).days) for r in intervals.subtract_intervals(df, other, calendar, "k", "d", "start", "stop").collect()]
    left = inside(made, days) - inside(taken, days)
    assert inside(got, days) == left
    place = {d: i for i, d in enumerate(days)}
    for k, a, b in got:
        i, j = place[a], place[b]
        assert all((k, d) in left for d in days[i:j + 1])
        assert (i == 0 or (k, days[i - 1]) not in left) and (j + 1 == len(days) or (k, days[j + 1]) not in left)


def test_lookup_finds_the_earliest_covering_range(spark, ranges):
    _, made, _, df, _, _ = ranges
    points = spark.createDataFrame([(n, k, day(n)) for n in range(0, 950, 3) for k in "ABZ"], "n int, k string, at date")
    got = intervals.covering(points, df, "k", "at", "start", "stop")
    assert got.count() == points.count()
    for r in got.collect():
        fit = sorted((a, -b) for k, a, b in set(made) if k == r.k and a <= r.n <= b)
        assert r.name == (f"{r.k}{fit[0][0]}-{-fit[0][1]}" if fit else None)


def test_hot_partition_is_written_by_tasks_in_proportion(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [("hot" if i % 10 else f"p{i % 50}", rng.bytes(60).hex()) for i in range(60_000)]
    df = spark.createDataFrame(rows, "part string, x string").repartition(8).cache()
    df.count()
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        tables.replace_partition(spark, str(tmp_path / "t"), df, "part")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = {d: sum(f.endswith(".parquet") for f in os.listdir(tmp_path / "t" / d)) for d in os.listdir(tmp_path / "t") if d.startswith("part=")}
    small = [n for d, n in files.items() if d != "part=hot"]  # some share the hot one's hash
    assert files["part=hot"] >= 4 and sum(n <= 2 for n in small) > len(small) / 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 60_000


def book(spark):
    rng = np.random.default_rng(10)
    rows = [(day(d), f"S{s}", float(rng.normal() * 0.02), bool(rng.random() < 0.8), bool(rng.random() < 0.9), float(rng.integers(0, 9))) for d in range(40) for s in range(12)]
    return spark.createDataFrame(rows, "trade_date date, vt_symbol string, daily_return double, signal_eligible boolean, benchmark_eligible boolean, score double")


def test_grid_equals_single_backtests_and_reads_its_frame_once(spark):
    configs = [portfolio.PortfolioConfig(3, 5, 1, 10.0, "score"), portfolio.PortfolioConfig(6, 5, 1, 2.0, "score"), portfolio.PortfolioConfig(3, 7, 1, 10.0, "score")]
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        reads.add(1)
        yield from batches

    frame = book(spark).coalesce(1)
    counted = frame.mapInArrow(count, frame.schema)
    grid = portfolio.backtest_grid(counted, configs).cache()
    assert grid.count() and reads.value == 1
    for i, config in enumerate(configs):
        own = {r.trade_date: r.net_return for r in portfolio.backtest(frame, config).collect()}
        got = {r.trade_date: r.net_return for r in grid.where(F.col("config") == i).collect()}
        assert own.keys() == got.keys() and all(abs(own[d] - got[d]) < 1e-12 for d in own)


def test_turnover_reads_positions_once(spark):
    from catalog import portfolio as queries
    plan = portfolio.turnover_costs(queries.target(spark, "/root/testdata/sf0.001"), 0.001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("Relation [") <= 4 and "parquet" not in plan


@pytest.mark.parametrize("name", ["fa_channels", "fa_position_breakout"])
def test_long_windows_give_values_that_vary(spark, name):
    from catalog import load
    rows = load().QUERIES[name](spark, "/root/testdata/sf0.01")
    names = [c for c in rows.columns if c not in ("vt_symbol", "datetime")]
    spread = rows.agg(*[F.count_distinct(c).alias(c) for c in names]).first()
    assert all(spread[c] > 1 for c in names), [c for c in names if spread[c] <= 1]
