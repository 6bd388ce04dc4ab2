"""Operators on small fixtures with exact or brute-force values."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.factors import alpha101, common, composites, patterns
from barloom.factors.spec import extract, names, snake_case
from barloom.functions import cs, maths, safe, symbols, ts
from barloom.functions.expr import close, col, high, low, volume
from barloom.operators import eligibility, evaluate, portfolio
from barloom.plans.intervals import interval_join
from barloom.plans.panel import Panel
from barloom.sources import tables
from barloom.sources.store import PanelStore
from barloom.streaming import bars as stream_bars
from barloom.streaming import state
from tests.conftest import make_bars, same


@pytest.fixture(scope="module")
def micro(spark):
    rows = [(dt.datetime(2024, 1, 1 + i), "TEST", x, y) for i, (x, y) in enumerate(zip((1, 3, 2, 4), (2, 2, 3, 1)))]
    return Panel(spark.createDataFrame(rows, "datetime timestamp_ntz, vt_symbol string, x int, y int"))


def values(panel, **exprs):
    rows = sorted(panel.select(exprs).collect(), key=lambda r: r["datetime"])
    return {k: [r[k] for r in rows] for k in exprs}


def test_arithmetic_and_comparisons(micro):
    x, y = col("x"), col("y")
    got = values(micro, add=x + y, rsub=10 - x, div=x / y, mod=(x * -1) % y, gt=x > y, eq=x == y)
    assert got["add"] == [3, 5, 5, 5] and got["rsub"] == [9, 7, 8, 6] and got["gt"] == [0, 1, 0, 1] and got["eq"] == [0, 0, 0, 0]
    assert got["div"] == [0.5, 1.5, 2 / 3, 4.0] and got["mod"] == [1, 1, 1, 0]


def test_division_and_log_follow_ieee_under_ansi(micro):
    x = col("x")
    got = values(micro, inf=x / 0, ninf=(x * -1) / 0, nan=(x - x) / 0, l0=maths.log(x - x), neg=maths.log(x * -1))
    assert got["inf"][0] == math.inf and got["ninf"][0] == -math.inf and math.isnan(got["nan"][0])
    assert got["l0"][0] == -math.inf and math.isnan(got["neg"][0])


def test_window_edges(micro):
    x = col("x")
    got = values(micro, total=ts.ts_sum(x, 3), mean=ts.ts_mean(x, 3), rank=ts.ts_rank(x, 3), arg=ts.ts_argmax(x, 3),
                 decay=ts.ts_decay_linear(x, 2), corr=ts.ts_corr(x, col("y"), 2), sgn=maths.sign(ts.ts_delta(x, 1)), p=maths.pow1(x * -1, 2.0))
    assert got["total"] == [None, None, 6, 9] and got["mean"] == [1, 2, 2, 3]
    assert got["rank"] == [None, None, 2 / 3, 1.0] and got["arg"] == [None, None, 2, 3]
    assert got["decay"][1] == pytest.approx((2 * 1 + 3) / 3) and math.isnan(got["corr"][0]) and got["corr"][2] == -1.0
    assert got["sgn"] == [0, 1, -1, 1] and got["p"] == [-1, -9, -4, -16]


def test_symbol_rules(spark):
    pairs = {"600000.SH": "600000.SSE", "1": "000001.SZSE", "688001": "688001.SSE", "830799": "830799.BSE", " 000001.sz ": "000001.SZSE", "IF99": "IF99"}
    df = spark.createDataFrame([(k,) for k in pairs], "s string")
    assert {r[0]: r[1] for r in df.select("s", symbols.to_vt_symbol(F.col("s"))).collect()} == pairs
    with pytest.raises(Exception, match="empty"):
        spark.createDataFrame([("",)], "s string").select(symbols.to_vt_symbol(F.col("s"))).collect()
    assert snake_case("emaFast") == "ema_fast" and snake_case("rsiVal") == "rsi_val"


def test_external_signal_keeps_highest_and_parses_dates(spark):
    df = spark.createDataFrame([("20240102", "000001.SZ", "1.5"), ("2024-01-02", "000001.SZ", "2.5"), ("bad", "000001.SZ", "9")], "date string, ts_code string, score string")
    rows = tables.normalize_external_signal(df).collect()
    assert [(r["datetime"], r["vt_symbol"], r["signal"]) for r in rows] == [(dt.datetime(2024, 1, 2), "000001.SZSE", 2.5)]
    with pytest.raises(ValueError):
        tables.normalize_external_signal(df.drop("score"))


def test_store_upsert_universe_and_delete(spark, tmp_path, bars):
    store = PanelStore(spark, str(tmp_path))
    store.save_bars(bars, "d")
    store.save_bars(bars.where("vt_symbol = 'B'").withColumn("close", F.lit(1.0)), "d")
    assert store.load_bars("d").count() == bars.count()
    assert store.load_bars("d", symbols=["B"]).select("close").distinct().collect()[0][0] == 1.0
    store.delete_bars("d", ["B"])
    assert store.load_bars("d", symbols=["B"]).count() == 0 and store.load_bars("d", symbols=["A"]).count() == 180
    day = lambda d: dt.date(2024, 1, d)
    points = spark.createDataFrame([(day(2), "A"), (day(3), "A"), (day(5), "A"), (day(3), "B"), (day(4), "B")], "trade_date date, vt_symbol string")
    store.save_members("idx", points)
    got = {(r["vt_symbol"], r["valid_from"], r["valid_to"]) for r in store.member_intervals("idx").collect()}
    assert got == {("A", day(2), day(3)), ("A", day(5), day(5)), ("B", day(3), day(4))}
    store.add_contract("A", 0.1, 0.2, 10, 0.01)
    store.add_contract("A", 0.3, 0.2, 10, 0.01)
    assert store.contracts().collect()[0]["long_rate"] == 0.3 and store.load_signal("none") is None


def test_eligibility_cases(spark):
    d = [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)]
    old, cases = dt.datetime(2020, 1, 1), {"GOOD": {}, "LIMIT": {"next": 11.0}, "NEW": {"listed": dt.datetime(2023, 12, 20)}, "STOCK": {"name": "*ST x"}, "THIN": {"amount": 1.0}}
    rows = [(day, s, c.get("listed", old), None, c.get("name", "n"), c.get("next", 10.0) if i else 10.0, c.get("amount", 1e6), 1e6, 11.0, 9.0)
            for s, c in cases.items() for i, day in enumerate(d)]
    src = spark.createDataFrame(rows, "datetime timestamp_ntz, vt_symbol string, list_date timestamp_ntz, delist_date timestamp_ntz, name string, raw_close double, amount double, circ_mv double, up_limit double, down_limit double")
    got = eligibility.eligibility(src, "2024-01-01", "2024-01-31", 1, 60, min_amount=100.0).where("datetime = '2024-01-02'")
    assert {r["vt_symbol"]: r["eligible"] for r in got.collect()} == {"GOOD": True, "LIMIT": False, "NEW": False, "STOCK": False, "THIN": False}


def test_lookahead_guard_and_future_independence(spark, bars):
    with pytest.raises(ValueError):
        eligibility.assert_no_lookahead(["close", "next_open"])
    cut = "datetime < '2023-03-01'"
    exprs = {"a": ts.ts_mean(close, 5), "b": cs.cs_rank(ts.ts_delta(close, 3)), "c": ts.ts_corr(close, volume, 6)}
    changed = bars.withColumn("close", F.when(F.expr(f"not ({cut})"), F.col("close") * 3).otherwise(F.col("close")))
    same(Panel(bars).select(exprs).where(cut), Panel(changed).select(exprs).where(cut))


def test_factor_names_are_unique_and_missing_columns_are_named(bars):
    for factors in (common.technical(), common.liquidity(), patterns.box(), patterns.double_bottom(), composites.trend_rsi(2), alpha101.factors()):
        assert len(set(names(factors))) == len(factors)
    assert len(alpha101.factors()) == 82
    with pytest.raises(ValueError, match="turnover_rate"):
        extract(Panel(bars), common.trade_filters())


def test_formula_alphas_evaluate_on_extreme_values(spark):
    df = make_bars(spark, {s: 40 for s in "ABCDE"}).withColumns({
        "close": F.when(F.dayofyear("datetime") == 20, F.lit(float("nan"))).when(F.dayofyear("datetime") == 25, F.lit(1e-10)).otherwise(F.col("close")),
        "volume": F.when(F.dayofyear("datetime") == 30, F.lit(0.0)).otherwise(F.col("volume"))})
    pick = {k: v for k, v in alpha101.formulas().items() if k in ("alpha1", "alpha29", "alpha45", "alpha62", "alpha64", "alpha78", "alpha84", "alpha99")}
    assert Panel(df).select(pick).count() == 200


def test_crowding_score_divides_only_the_last_rank(spark, bars):
    df = bars.withColumn("turnover_rate", F.col("volume") / 100)
    f = {x.name: x.expr for x in common.liquidity((20,))}
    parts = {"a": cs.cs_rank(f["common_amount_ratio_20"]), "b": cs.cs_rank(f["common_turnover_zscore_20"]),
             "c": cs.cs_rank(f["common_volume_zscore_20"]), "d": cs.cs_rank(f["common_turnover_rate_zscore_20"])}
    for r in Panel(df).select(parts | {"s": f["common_crowding_score_20"]}).where("s is not null").collect():
        assert r["s"] == pytest.approx(r["a"] + r["b"] + r["c"] + r["d"] / 4)


def test_interval_join_duplicates_overlaps_and_keeps_open_ends(spark):
    left = spark.createDataFrame([("A", dt.date(2020, 6, 1)), ("A", dt.date(2022, 6, 1)), ("B", dt.date(2021, 1, 1))], "k string, t date")
    right = spark.createDataFrame([("A", dt.date(2019, 1, 1), dt.date(2020, 12, 31), 1), ("A", dt.date(2020, 1, 1), None, 2)], "k string, a date, b date, v int")
    got = sorted((r["k"], str(r["t"]), r["v"]) for r in interval_join(left, right, "k", "t", "a", "b", "left").collect())
    assert got == [("A", "2020-06-01", 1), ("A", "2020-06-01", 2), ("A", "2022-06-01", 2), ("B", "2021-01-01", None)]


def test_position_ledger_against_a_serial_walk(spark):
    rng = np.random.default_rng(1)
    rows = [("S", i, ("long", "short")[rng.integers(2)], ("open", "close", "closetoday", "closeyesterday")[rng.integers(4)], float(rng.integers(1, 9)), False) for i in range(200)]
    df = spark.createDataFrame(rows, "vt_symbol string, datetime long, direction string, offset string, volume double, old_first boolean")
    got = {r["datetime"]: r for r in state.position_ledger(df).collect()}
    pos = {"long": [0.0, 0.0], "short": [0.0, 0.0]}
    for _, i, d, o, v, _ in rows:
        side = pos[d] if o == "open" else pos["short" if d == "long" else "long"]
        if o == "open":
            side[0] += v
        elif o == "closetoday":
            side[0] -= v
        elif o == "closeyesterday":
            side[1] -= v
        else:
            side[0] -= v
            if side[0] < 0:
                side[1] += side[0]
                side[0] = 0.0
        for name in pos:
            assert (got[i][f"{name}_td"], got[i][f"{name}_yd"]) == pytest.approx(tuple(pos[name]))


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    base = dt.datetime(2024, 1, 2, 9, 0)
    rows = [("S", base + dt.timedelta(seconds=7 * i), 10.0 + (i * 7 % 5), float(i), float(i * 10), 15.0, 9.0) for i in range(200)]
    df = spark.createDataFrame(rows, "vt_symbol string, datetime timestamp, last_price double, volume double, turnover double, high_price double, low_price double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream_bars.record(stream_bars.stream_minute_bars(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = stream_bars.minute_bars(df)
    assert got.count() > 10
    same(got, batch.join(got.select("vt_symbol", "datetime"), ["vt_symbol", "datetime"], "left_semi").select(*got.columns))


def test_stream_bars_with_moving_extremes_batches_and_a_late_tick(spark, tmp_path):
    base = dt.datetime(2024, 1, 2, 9, 0)
    rows = [("S", base + dt.timedelta(seconds=7 * i), 10.0 + (i * 7 % 5), float(i), float(i * 10), 15.0 + i // 3, 9.0 - i / 100, float(i % 9)) for i in range(200)]
    schema = ("vt_symbol string, datetime timestamp, last_price double, volume double, turnover double, high_price double, low_price double, open_interest double")
    late = ("S", base + dt.timedelta(seconds=3), 99.0, 500.0, 5000.0, 99.0, 1.0, 7.0)
    for part in (rows[:90], [late], rows[90:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_bars.record(stream_bars.stream_minute_bars(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = stream_bars.minute_bars(spark.createDataFrame(rows, schema))
    assert got.count() > 10 and got.where("high > 15").count() > 0
    same(got, batch.join(got.select("vt_symbol", "datetime"), ["vt_symbol", "datetime"], "left_semi").select(*got.columns))


def test_robust_zscore_of_a_column_without_spread(spark):
    from barloom.operators import processors
    df = spark.createDataFrame([(dt.datetime(2024, 1, d), "A", 0.0 if d < 8 else 1e-12, 0.0) for d in range(1, 9)], "datetime timestamp_ntz, vt_symbol string, x double, label double")
    got = [r["x"] for r in processors.robust_zscore_norm(df).orderBy("datetime").collect()]
    assert got[:7] == [0.0] * 7 and abs(got[7] - 1 / 1.4826) < 1e-9


def test_bar_panel_prunes_years(spark, tmp_path):
    from barloom.sources.store import PanelStore
    store = PanelStore(spark, str(tmp_path))
    rows = [(dt.datetime(y, 6, 1), "A", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for y in range(2018, 2024)]
    store.save_bars(spark.createDataFrame(rows, "datetime timestamp_ntz, vt_symbol string, open double, high double, low double, close double, volume double, turnover double"), "daily")
    panel = store.load_bar_panel("daily", "2020-01-01", "2021-12-31", 0)
    plan = panel._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan[plan.index("PartitionFilters"):][:300] and panel.count() == 2


def test_momentum_has_positive_rank_ic_on_trends(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=d), f"S{s}", 100.0 * (1 + 0.001 * (s - 4)) ** d) for s in range(8) for d in range(40)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, vt_symbol string, close double")
    panel = Panel(df).with_columns({"mom": close / ts.ts_delay(close, 5) - 1.0, "h1": evaluate.forward_return(1)})
    got = evaluate.score_grid(panel, ["mom"], ["h1"], {"all": ("2024-01-01", "2024-12-31"), "none": ("2030-01-01", "2031-01-01")}, 5).collect()
    by = {r["segment"]: r for r in got}
    assert by["all"]["ic"] == pytest.approx(1.0) and by["all"]["days"] > 20 and by["none"]["days"] == 0 and math.isnan(by["none"]["ic"])


def test_turnover_charges_entry_and_changes_only(spark):
    rows = [(0, dt.date(2024, 1, 1), "A", 0.5), (0, dt.date(2024, 1, 1), "B", 0.5), (2, dt.date(2024, 2, 1), "B", 1.0)]
    df = spark.createDataFrame(rows, "rebalance_id long, effective_start date, vt_symbol string, weight double")
    got = {r["rebalance_id"]: r["turnover"] for r in portfolio.turnover_costs(df, 0.001).collect()}
    assert got == {0: 1.0, 2: 1.0}


def test_tick_rounding_is_exact(spark):
    df = spark.createDataFrame([(0.3,), (0.25,), (0.35,)], "v double")
    rows = df.select(maths.floor_to(F.col("v"), 0.1).alias("f"), maths.ceil_to(F.col("v"), 0.1).alias("c"), maths.round_to(F.col("v"), 0.1).alias("r")).collect()
    assert [(r["f"], r["c"], r["r"]) for r in rows] == [(0.3, 0.3, 0.3), (0.2, 0.3, 0.2), (0.3, 0.4, 0.4)]
    assert safe.INF == math.inf
