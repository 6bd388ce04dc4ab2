"""Portfolio research, point-in-time preparation and storage, against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import close, shift
from barloom.operators import portfolio as pf
from barloom.plans import intervals as iv
from barloom.plans.panel import Panel
from barloom.session import durable

from catalog.base import BARS, W, WS, bars, r, register, table, tidy

CONFIG = pf.PortfolioConfig(top_n=10, rebalance_days=3, entry_lag=1, fee_bps=10.0, score="score", annual_days=12.0)
SEG = {"early": ("1995-01-01", "1998-12-31"), "late": ("1999-01-01", "2002-12-31")}


def frame(spark, sf):
    """Daily-return frame of the backtest with valuation and membership columns."""
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("vt_symbol"), "s_suppkey", "s_nationkey")
    df = bars(spark, sf).withColumn("trade_date", F.col("datetime").cast("date")).join(nation, "vt_symbol")
    df = Panel(df).with_columns({"daily_return": close / shift(close, 1) - 1.0, "score": -(close / shift(close, 3) - 1.0),
                                 "forward_holding_return": shift(close, -4) / shift(close, -1) - 1.0})
    return df.withColumns({
        "signal_eligible": (F.col("volume") >= 60) & (F.col("s_suppkey") % 9 != 0), "benchmark_eligible": F.col("volume") >= 30,
        "circ_mv": F.col("turnover") * 5, "turnover_rate": F.col("volume") / 50, "pb": F.col("close") / 1000,
        "industry": F.when(F.col("s_nationkey") > 2, F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))),
        "is_a": F.col("s_suppkey") % 2 == 0, "is_b": F.col("s_suppkey") % 5 == 0})


FRAME = BARS + f""", frame AS MATERIALIZED (SELECT b.*, CAST(datetime AS DATE) AS trade_date, s_suppkey, s_nationkey, close / lag(close) OVER {WS} - 1 AS daily_return,
  -(close / lag(close, 3) OVER {WS} - 1) AS score, lead(close, 4) OVER {WS} / lead(close, 1) OVER {WS} - 1 AS fhr,
  volume >= 60 AND s_suppkey % 9 <> 0 AS sel, volume >= 30 AS ben, turnover * 5 AS circ_mv, volume / 50 AS turnover_rate, close / 1000 AS pb,
  CASE WHEN s_nationkey > 2 THEN 'N' || s_nationkey END AS industry, s_suppkey % 2 = 0 AS is_a, s_suppkey % 5 = 0 AS is_b
  FROM bars b JOIN supplier ON CAST(s_suppkey AS VARCHAR) = vt_symbol)"""
def plan_sql(k=3, top=10):
    return FRAME + f""", days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM frame)),
  plan0 AS (SELECT CAST(i // {k} AS BIGINT) AS rebalance_id, trade_date AS signal_date, i + 2 AS s, least(CASE WHEN i + {k} < n THEN i + {k} ELSE n END + 1, n - 1) AS e FROM days WHERE i % {k} = 0),
  plan AS (SELECT p.*, a.trade_date AS effective_start, b.trade_date AS effective_end FROM plan0 p JOIN days a ON a.i = s JOIN days b ON b.i = e WHERE e >= s),
  active AS (SELECT trade_date, rebalance_id FROM plan JOIN days ON i BETWEEN s AND e),
  pos0 AS (SELECT rebalance_id, effective_start, effective_end, vt_symbol, row_number() OVER (PARTITION BY rebalance_id ORDER BY score DESC, vt_symbol) AS rank
    FROM frame JOIN plan ON trade_date = signal_date WHERE sel AND score IS NOT NULL AND NOT isnan(score)),
  pos AS (SELECT *, count(*) OVER (PARTITION BY rebalance_id) AS cnt, 1.0 / count(*) OVER (PARTITION BY rebalance_id) AS weight FROM pos0 WHERE rank <= {top}),
  bpos AS (SELECT rebalance_id, effective_start, effective_end, vt_symbol, count(*) OVER (PARTITION BY rebalance_id) AS cnt, 1.0 / count(*) OVER (PARTITION BY rebalance_id) AS weight
    FROM frame JOIN plan ON trade_date = signal_date WHERE ben)"""


PLAN = plan_sql()


def costs_sql(pos, name, fee=0.001):
    return f"""{name}_ids AS (SELECT rebalance_id, row_number() OVER (ORDER BY rebalance_id) AS o, min(effective_start) AS trade_date, count(*) AS holding_count FROM {pos} GROUP BY rebalance_id),
      {name}_p AS (SELECT o, vt_symbol, weight FROM {pos} JOIN {name}_ids USING (rebalance_id)),
      {name}_c AS (SELECT coalesce(a.o, b.o + 1) AS o, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) AS d FROM {name}_p a FULL JOIN {name}_p b ON a.vt_symbol = b.vt_symbol AND a.o = b.o + 1),
      {name} AS (SELECT trade_date, rebalance_id, sum(d) AS turnover, sum(d) * {fee} AS cost, any_value(holding_count) AS holding_count FROM {name}_c JOIN {name}_ids USING (o) GROUP BY 1, 2)"""


def plan(spark, sf, df=None):
    df = frame(spark, sf) if df is None else df
    days = durable(iv.calendar(df, "trade_date"))
    return df, days, durable(pf.rebalance_calendar(days, CONFIG))


register("pf_rebalance_calendar", lambda spark, sf: plan(spark, sf)[2].select("rebalance_id", "signal_date", "effective_start", "effective_end"),
         f"WITH {PLAN} SELECT rebalance_id, signal_date, effective_start, effective_end FROM plan")
register("pf_active_days", lambda spark, sf: pf.active_days(*plan(spark, sf)[1:]), f"WITH {PLAN} SELECT trade_date, rebalance_id FROM active")


def target(spark, sf):
    df, _, p = plan(spark, sf)
    return pf.target_positions(df, p, CONFIG)


def benchmark(spark, sf):
    df, _, p = plan(spark, sf)
    return pf.benchmark_positions(df, p)


register("pf_target_positions", lambda spark, sf: tidy(target(spark, sf)),
         f"WITH {PLAN} SELECT rebalance_id, effective_start, effective_end, vt_symbol, CAST(rank AS INTEGER) AS rank, {r('weight', 'weight')}, cnt AS selected_count FROM pos")
register("pf_benchmark_positions", lambda spark, sf: tidy(benchmark(spark, sf)),
         f"WITH {PLAN} SELECT rebalance_id, effective_start, effective_end, vt_symbol, {r('weight', 'weight')}, cnt AS benchmark_count FROM bpos")
register("pf_turnover_costs", lambda spark, sf: tidy(pf.turnover_costs(target(spark, sf), 0.001)),
         f"WITH {PLAN}, {costs_sql('pos', 'tc')} SELECT trade_date, rebalance_id, {r('turnover', 'turnover')}, {r('cost', 'cost')}, holding_count FROM tc")
def book_sql(k=3, top=10, fee=0.001):
    return plan_sql(k, top) + f""", {costs_sql('pos', 'tc', fee)}, {costs_sql('bpos', 'bc', fee)},
  g AS (SELECT trade_date, sum(daily_return * weight) AS gross FROM frame JOIN active USING (trade_date) JOIN pos USING (rebalance_id, vt_symbol) WHERE daily_return IS NOT NULL GROUP BY 1),
  bg AS (SELECT trade_date, sum(daily_return * weight) AS bgross FROM frame JOIN active USING (trade_date) JOIN bpos USING (rebalance_id, vt_symbol) WHERE daily_return IS NOT NULL GROUP BY 1),
  ew AS (SELECT trade_date, avg(daily_return) AS even FROM frame WHERE ben AND daily_return IS NOT NULL GROUP BY 1),
  book AS (SELECT g.trade_date, gross, bgross, even, coalesce(tc.turnover, 0) AS turnover, coalesce(tc.cost, 0) AS cost, coalesce(bc.cost, 0) AS bcost,
    last_value(tc.holding_count IGNORE NULLS) OVER (ORDER BY g.trade_date) AS holding_count FROM g LEFT JOIN bg USING (trade_date) LEFT JOIN ew USING (trade_date)
    LEFT JOIN tc USING (trade_date) LEFT JOIN bc USING (trade_date)),
  bt AS (SELECT *, gross - cost AS net, bgross - bcost AS bnet FROM book)"""


BOOK = book_sql()
register("pf_backtest", lambda spark, sf: tidy(pf.backtest(frame(spark, sf), CONFIG).select(
    "trade_date", "gross_return", "net_return", "benchmark_return", "net_excess_return", "daily_equal_weight_benchmark_return", "turnover", "holding_count")),
    f"WITH {BOOK} SELECT trade_date, {r('gross', 'gross_return')}, {r('net', 'net_return')}, {r('bnet', 'benchmark_return')}, {r('net - bnet', 'net_excess_return')}, "
    f"{r('even', 'daily_equal_weight_benchmark_return')}, {r('turnover', 'turnover')}, holding_count FROM bt")
_SUM = lambda seg: f"""WITH {BOOK}, s AS (SELECT *, {seg} AS segment FROM bt), eq AS (SELECT *, product(1 + net) OVER (PARTITION BY segment ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS e FROM s),
  dd AS (SELECT *, e / max(e) OVER (PARTITION BY segment ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM eq)
  SELECT segment, count(*) AS days, {r('avg(holding_count)', 'avg_holding_count')}, {r('avg(CASE WHEN turnover > 0 THEN turnover END)', 'avg_rebalance_turnover')},
  {r('sum(turnover) * 12 / count(*)', 'annual_turnover')}, {r('product(1 + net) - 1', 'net_total_return')}, {r('pow(product(1 + net), 12.0 / count(*)) - 1', 'net_annual_return')},
  {r('avg(net) / stddev_samp(net) * sqrt(12)', 'net_sharpe')}, {r('min(d)', 'net_max_drawdown')} FROM dd GROUP BY 1"""
_cols = ("segment", "days", "avg_holding_count", "avg_rebalance_turnover", "annual_turnover", "net_total_return", "net_annual_return", "net_sharpe", "net_max_drawdown")
register("pf_summary_segments", lambda spark, sf: tidy(pf.summarize(pf.backtest(frame(spark, sf), CONFIG), SEG, 12.0).select(*_cols)),
         _SUM("CASE WHEN trade_date <= DATE '1998-12-31' THEN 'early' ELSE 'late' END"))
register("pf_summary_years", lambda spark, sf: tidy(pf.summarize(pf.backtest(frame(spark, sf), CONFIG), None, 12.0).select(*_cols)), _SUM("CAST(year(trade_date) AS VARCHAR)"))
GRID = [CONFIG, pf.PortfolioConfig(20, 6, 1, 5.0, "score", 12.0), pf.PortfolioConfig(5, 3, 1, 0.0, "score", 12.0)]
register("pf_backtest_grid", lambda spark, sf: tidy(pf.backtest_grid(frame(spark, sf), GRID).select(
    "top_n", "rebalance_days", "trade_date", "gross_return", "net_return", "benchmark_return", "turnover", "holding_count")), " UNION ALL ".join(
    f"SELECT CAST({c.top_n} AS INTEGER) AS top_n, CAST({c.rebalance_days} AS INTEGER) AS rebalance_days, trade_date, {r('gross', 'gross_return')}, {r('net', 'net_return')}, "
    f"{r('bnet', 'benchmark_return')}, {r('turnover', 'turnover')}, holding_count FROM (WITH {book_sql(c.rebalance_days, c.top_n, c.fee_bps / 10_000)} SELECT * FROM bt)" for c in GRID))
_sb = lambda spark, sf: pf.selected_and_benchmark(frame(spark, sf), CONFIG)
EXPO = FRAME + """, dts AS (SELECT trade_date FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT DISTINCT trade_date FROM frame)) WHERE i % 3 = 0),
  cand AS (SELECT * FROM frame JOIN dts USING (trade_date) WHERE fhr IS NOT NULL),
  selr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, vt_symbol) AS rk FROM cand WHERE sel AND score IS NOT NULL) WHERE rk <= 10), benr AS (SELECT * FROM cand WHERE ben),
  sd AS (SELECT trade_date, avg(fhr) AS f, count(*) AS n, median(circ_mv) AS m1, median(turnover) AS m2, median(turnover_rate) AS m3, median(pb) AS m4 FROM selr GROUP BY 1),
  bd AS (SELECT trade_date, avg(fhr) AS f, count(*) AS n, median(circ_mv) AS m1, median(turnover) AS m2, median(turnover_rate) AS m3, median(pb) AS m4 FROM benr GROUP BY 1),
  adv AS (SELECT s.trade_date, s.f - b.f AS x, s.n AS sn, b.n AS bn, s.m1 / b.m1 AS r1, s.m2 / b.m2 AS r2, s.m3 / b.m3 AS r3, s.m4 / b.m4 AS r4 FROM sd s JOIN bd b USING (trade_date))"""
register("pf_forward_advantage", lambda spark, sf: tidy(pf.forward_advantage(*_sb(spark, sf)).select(
    "trade_date", "forward_excess_return", "selected_count", "benchmark_count", "median_circ_mv_ratio", "median_turnover_ratio", "median_turnover_rate_ratio", "median_pb_ratio")),
    f"WITH {EXPO} SELECT trade_date, {r('x', 'forward_excess_return')}, sn AS selected_count, bn AS benchmark_count, {r('r1', 'median_circ_mv_ratio')}, {r('r2', 'median_turnover_ratio')}, "
    f"{r('r3', 'median_turnover_rate_ratio')}, {r('r4', 'median_pb_ratio')} FROM adv")
register("pf_exposure_summary", lambda spark, sf: tidy(pf.exposure_summary(pf.forward_advantage(*_sb(spark, sf)), SEG).select(
    "segment", "rebalance_count", "forward_excess_return_mean", "forward_excess_win_rate", "forward_excess_t_stat", "median_pb_ratio")),
    f"WITH {EXPO} SELECT CASE WHEN trade_date <= DATE '1998-12-31' THEN 'early' ELSE 'late' END AS segment, count(*) AS rebalance_count, {r('avg(x)', 'forward_excess_return_mean')}, "
    f"{r('avg(CAST(x > 0 AS DOUBLE))', 'forward_excess_win_rate')}, {r('avg(x) / stddev_samp(x) * sqrt(count(*))', 'forward_excess_t_stat')}, {r('median(r4)', 'median_pb_ratio')} FROM adv GROUP BY 1")
_cw = lambda t, n: f"SELECT trade_date, coalesce(industry, 'UNKNOWN') AS industry, count(*) / sum(count(*)) OVER (PARTITION BY trade_date) AS {n} FROM {t} GROUP BY 1, 2"
register("pf_category_overweight", lambda spark, sf: tidy(pf.category_overweight(*_sb(spark, sf), "industry")),
         f"WITH {EXPO}, a AS ({_cw('selr', 'sw')}), b AS ({_cw('benr', 'bw')}), j AS (SELECT industry, coalesce(sw, 0) AS sw, coalesce(bw, 0) AS bw FROM a FULL JOIN b USING (trade_date, industry)) "
         f"SELECT industry, {r('avg(sw)', 'selected_weight')}, {r('avg(bw)', 'benchmark_weight')}, {r('avg(sw - bw)', 'overweight')} FROM j GROUP BY 1")
register("pf_index_exposure", lambda spark, sf: tidy(pf.index_exposure(*_sb(spark, sf), ["is_a", "is_b"])),
         f"WITH {EXPO}, " + ", ".join(f"{t}{f} AS (SELECT trade_date, avg(CAST({f} AS DOUBLE)) AS v FROM {t}r GROUP BY 1)" for t in ("sel", "ben") for f in ("is_a", "is_b"))
         + " " + " UNION ALL ".join(f"SELECT '{f}' AS index, {r('avg(s.v)', 'selected_weight')}, {r('avg(b.v)', 'benchmark_weight')}, {r('avg(s.v - b.v)', 'overweight')} "
                                    f"FROM sel{f} s JOIN ben{f} b USING (trade_date)" for f in ("is_a", "is_b")))


# ------------------------------------------------------------------------ PnL
def pnl(spark, sf):
    line = table(spark, sf, "lineitem")
    trades = line.select(F.col("l_suppkey").cast("string").alias("vt_symbol"), F.trunc("l_shipdate", "month").alias("date"),
                         F.when(F.col("l_returnflag") == "R", "short").otherwise("long").alias("direction"),
                         F.col("l_quantity").alias("volume"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    contracts = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("vt_symbol"), F.lit(0.001).alias("long_rate"),
                                                    F.lit(0.002).alias("short_rate"), (F.col("s_suppkey") % 3 + 1.0).alias("size"))
    daily = bars(spark, sf).select("vt_symbol", F.col("datetime").cast("date").alias("date"), "close")
    return pf.daily_pnl(daily, trades, contracts)


PNL = BARS + f""", tr AS (SELECT CAST(l_suppkey AS VARCHAR) AS vt_symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS s,
  l_quantity AS v, l_extendedprice / l_quantity AS p, l_suppkey % 3 + 1.0 AS size FROM lineitem),
  ag AS (SELECT vt_symbol, date, sum(s * v) AS pc, sum(s * v * p) AS sv, sum(v * p * size) AS turnover, sum(v * p * size * CASE WHEN s = 1 THEN 0.001 ELSE 0.002 END) AS commission,
    count(*) AS trade_count, any_value(size) AS size FROM tr GROUP BY 1, 2),
  wk AS (SELECT a.*, close, sum(pc) OVER w AS end_pos, coalesce(lag(close) OVER (PARTITION BY a.vt_symbol ORDER BY date), 0) AS pre_close FROM ag a JOIN bars b
    ON a.vt_symbol = b.vt_symbol AND a.date = CAST(b.datetime AS DATE) WINDOW w AS (PARTITION BY a.vt_symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
  pl AS (SELECT *, (end_pos - pc) * (close - pre_close) * size AS holding_pnl, (pc * close - sv) * size AS trading_pnl FROM wk),
  pd AS (SELECT date, sum(trade_count) AS trade_count, sum(turnover) AS turnover, sum(commission) AS commission, sum(trading_pnl) AS trading_pnl, sum(holding_pnl) AS holding_pnl,
    sum(trading_pnl + holding_pnl) AS total_pnl, sum(trading_pnl + holding_pnl - commission) AS net_pnl FROM pl GROUP BY 1)"""
CAP = 1e11
register("pf_daily_pnl", lambda spark, sf: tidy(pnl(spark, sf).select("vt_symbol", "date", "start_pos", "end_pos", "turnover", "commission", "holding_pnl", "trading_pnl", "trade_count"), 6),
         f"WITH {PNL} SELECT vt_symbol, date, {r('end_pos - pc', 'start_pos', 6)}, {r('end_pos', 'end_pos', 6)}, {r('turnover', 'turnover', 6)}, {r('commission', 'commission', 6)}, "
         f"{r('holding_pnl', 'holding_pnl', 6)}, {r('trading_pnl', 'trading_pnl', 6)}, trade_count FROM pl")
register("pf_portfolio_pnl", lambda spark, sf: tidy(pf.portfolio_pnl(pnl(spark, sf)), 2), f"WITH {PNL} SELECT date, CAST(trade_count AS BIGINT) AS trade_count, " + ", ".join(
    r(c, c, 2) for c in ("turnover", "commission", "trading_pnl", "holding_pnl", "total_pnl", "net_pnl")) + " FROM pd")
CURVE = PNL + f""", bal AS (SELECT *, sum(net_pnl) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) + {CAP} AS balance FROM pd),
  cur AS (SELECT *, coalesce(balance / lag(balance) OVER (ORDER BY date) - 1, 0) AS ret, max(balance) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS hi FROM bal)"""
curve = lambda spark, sf: pf.balance_curve(pf.portfolio_pnl(pnl(spark, sf)), CAP)
register("pf_balance_curve", lambda spark, sf: tidy(curve(spark, sf).select("date", "balance", "return", "highlevel", "ddpercent")),
         f"WITH {CURVE} SELECT date, {r('balance', 'balance')}, {r('ret', 'return')}, {r('hi', 'highlevel')}, {r('(balance / hi - 1) * 100', 'ddpercent')} FROM cur")
register("pf_statistics", lambda spark, sf: tidy(pf.statistics(curve(spark, sf), CAP, 12.0).select(
    "start_date", "end_date", "total_days", "end_balance", "max_ddpercent", "max_drawdown_duration", "total_return", "annual_return", "return_std", "sharpe_ratio", "total_trade_count")),
    f"""WITH {CURVE}, tail AS (SELECT date AS e FROM cur ORDER BY balance - hi, date LIMIT 1), top AS (SELECT date AS b FROM cur, tail WHERE date <= e ORDER BY balance DESC, date LIMIT 1)
    SELECT min(date) AS start_date, max(date) AS end_date, count(*) AS total_days, {r('arg_max(balance, date)', 'end_balance')}, {r('min((balance / hi - 1) * 100)', 'max_ddpercent')},
    CAST(any_value(e) - any_value(b) AS INTEGER) AS max_drawdown_duration, {r(f'(arg_max(balance, date) / {CAP} - 1) * 100', 'total_return')},
    {r(f'(arg_max(balance, date) / {CAP} - 1) * 100 / count(*) * 12', 'annual_return')}, {r('stddev_samp(ret) * 100', 'return_std')},
    {r('avg(ret) / stddev_samp(ret) * sqrt(12)', 'sharpe_ratio')}, CAST(sum(trade_count) AS BIGINT) AS total_trade_count FROM cur, tail, top""")
_bench = lambda spark, sf: bars(spark, sf).groupBy(F.col("datetime").cast("date").alias("date")).agg(F.avg("close").alias("close"))
register("pf_benchmark_curves", lambda spark, sf: tidy(pf.benchmark_curves(curve(spark, sf), _bench(spark, sf), CAP).select(
    "date", "cumulative_return", "cumulative_cost", "benchmark_return", "excess_return", "drawdown_return", "excess_drawdown")),
    f"""WITH {CURVE}, bm AS (SELECT CAST(datetime AS DATE) AS date, avg(close) AS b FROM bars GROUP BY 1), j AS (SELECT c.date, balance / {CAP} - 1 AS cr,
    sum(commission) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) / {CAP} AS cc, b / first_value(b) OVER (ORDER BY date) - 1 AS br FROM cur c JOIN bm USING (date))
    SELECT date, {r('cr', 'cumulative_return')}, {r('cc', 'cumulative_cost')}, {r('br', 'benchmark_return')}, {r('cr - br', 'excess_return')},
    {r('cr - max(cr) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)', 'drawdown_return')}, {r('cr - br - max(cr - br) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)', 'excess_drawdown')} FROM j""")
register("pf_fill_missing_bars", lambda spark, sf: tidy(pf.fill_missing_bars(bars(spark, sf)).select("vt_symbol", "datetime", "open", "close", "volume")),
         f"""WITH {BARS}, g AS (SELECT vt_symbol, d.datetime FROM (SELECT vt_symbol, min(datetime) AS f FROM bars GROUP BY 1) JOIN (SELECT DISTINCT datetime FROM bars) d ON d.datetime >= f),
         j AS (SELECT g.vt_symbol, g.datetime, open, close, volume, last_value(close IGNORE NULLS) OVER (PARTITION BY g.vt_symbol ORDER BY g.datetime) AS l FROM g LEFT JOIN bars b
         ON g.vt_symbol = b.vt_symbol AND g.datetime = b.datetime) SELECT vt_symbol, datetime, {r('coalesce(open, l)', 'open')}, {r('coalesce(close, l)', 'close')}, {r('coalesce(volume, 0)', 'volume')} FROM j""")
register("pf_parameter_grid", lambda spark, sf: frame(spark, sf).select("vt_symbol").distinct().crossJoin(
    F.broadcast(pf.parameter_grid(spark, {"fast": (5.0, 10.0, 5.0), "slow": (20.0, 60.0, 20.0)}))),  # six settings
    f"WITH {FRAME} SELECT DISTINCT vt_symbol, CAST(f AS DOUBLE) AS fast, CAST(s AS DOUBLE) AS slow FROM frame, (VALUES (5), (10)) a(f), (VALUES (20), (40), (60)) b(s)")


# ------------------------------------------- selection rules on a signal frame
def signal(spark, sf):
    return frame(spark, sf).where("score IS NOT NULL").select("datetime", "vt_symbol", F.col("score").alias("signal"), (F.col("volume") / 100).alias("entry_signal"),
                                                              (F.col("s_suppkey") % 4 + 1.0).alias("position_scale"), "close", "s_suppkey")


SIG = FRAME + ", sig AS (SELECT datetime, vt_symbol, score AS signal, volume / 100 AS entry_signal, s_suppkey % 4 + 1.0 AS position_scale, close, s_suppkey FROM frame WHERE score IS NOT NULL)"
_hold = lambda spark, sf: bars(spark, sf).where("close > 1.6 * open").select("datetime", "vt_symbol")  # what went up is held
register("pf_top_k_drop_n", lambda spark, sf: pf.top_k_drop_n(signal(spark, sf), _hold(spark, sf), 12, 2),
         f"""WITH {SIG}, hold AS (SELECT datetime, vt_symbol FROM bars WHERE close > 1.6 * open), hs AS (SELECT datetime, count(*) AS held FROM hold GROUP BY 1),
         se AS (SELECT h.datetime, h.vt_symbol, row_number() OVER (PARTITION BY h.datetime ORDER BY signal ASC NULLS FIRST, h.vt_symbol DESC) AS r FROM hold h LEFT JOIN sig USING (datetime, vt_symbol)),
         bu AS (SELECT datetime, vt_symbol, row_number() OVER (PARTITION BY datetime ORDER BY signal DESC, vt_symbol) AS r FROM sig ANTI JOIN hold USING (datetime, vt_symbol))
         SELECT datetime, vt_symbol, 'sell' AS side FROM se WHERE r <= 2 UNION ALL SELECT datetime, vt_symbol, 'buy' AS side FROM bu LEFT JOIN hs USING (datetime)
         WHERE r <= 12 - coalesce(held, 0) + least(2, coalesce(held, 0))""")
register("pf_soft_entry_score", lambda spark, sf: tidy(pf.soft_entry_score(signal(spark, sf), 0.3).select("datetime", "vt_symbol", "entry_score")),
         f"WITH {SIG} SELECT datetime, vt_symbol, {r('signal + 0.3 * coalesce((entry_signal - min(entry_signal) OVER d) / nullif(max(entry_signal) OVER d - min(entry_signal) OVER d, 0), 0)', 'entry_score')} "
         "FROM sig WINDOW d AS (PARTITION BY datetime)")
register("pf_scaled_targets", lambda spark, sf: pf.scaled_targets(pf.signal_defaults(signal(spark, sf)), 1e7, 0.95, 10.0).select("datetime", "vt_symbol", "target_volume"),
         f"WITH {SIG} SELECT datetime, vt_symbol, floor(CAST(1e7 * 0.95 * 1.0 * position_scale / sum(position_scale) OVER (PARTITION BY datetime) / close AS DECIMAL(28,10)) / 10) * 10.0::DOUBLE AS target_volume FROM sig")
register("pf_signal_defaults", lambda spark, sf: tidy(pf.signal_defaults(signal(spark, sf)).drop("close", "s_suppkey")),
         f"WITH {SIG} SELECT datetime, vt_symbol, {r('signal', 'signal')}, {r('entry_signal', 'entry_signal')}, 0.0::DOUBLE AS exit_signal, {r('position_scale', 'position_scale')}, 1.0::DOUBLE AS portfolio_scale, 0.0::DOUBLE AS stop_price, 0 AS max_hold_days FROM sig")


def exits(spark, sf):
    s = signal(spark, sf).withColumns({"exit_signal": (F.col("s_suppkey") % 34 == 0).cast("double"), "stop_price": F.lit(1000.0), "max_hold_days": F.lit(6)})
    held = bars(spark, sf).select("datetime", "vt_symbol", F.month("datetime").alias("hold_days"))
    return pf.exit_reasons(held, s, bars(spark, sf), 30)


register("pf_exit_reasons", exits, f"""WITH {SIG}, rk AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY signal DESC, vt_symbol) AS r FROM sig),
  p AS (SELECT b.datetime, b.vt_symbol, b.close, month(b.datetime) AS hd, r, s_suppkey FROM bars b LEFT JOIN rk USING (datetime, vt_symbol)),
  x AS (SELECT datetime, vt_symbol, CASE WHEN r IS NOT NULL AND s_suppkey % 34 = 0 THEN 'exit_signal' WHEN r IS NOT NULL AND close <= 1000 THEN 'stop_price' WHEN r IS NOT NULL AND hd >= 6 THEN 'max_hold'
    WHEN r IS NULL OR r > 30 THEN 'rank' END AS exit_reason FROM p) SELECT * FROM x WHERE exit_reason IS NOT NULL""")


def slots(spark, sf):
    df = frame(spark, sf)
    days = iv.calendar(df, "trade_date")
    trades = df.where("daily_return > 0.5").join(days, "trade_date").select("vt_symbol", "trade_date", "day_index", F.col("forward_holding_return").alias("ret")).where("ret IS NOT NULL")
    return trades, days


TRADES = FRAME + """, days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS day_index FROM (SELECT DISTINCT trade_date FROM frame)),
  trades AS (SELECT vt_symbol, trade_date, day_index, fhr AS ret FROM frame JOIN days USING (trade_date) WHERE daily_return > 0.5 AND fhr IS NOT NULL)"""
_SLOT = TRADES + """, sp AS (SELECT d.day_index, sum(pow(1 + ret, 1 / 3.0) - 1) / 20.0 AS ret, count(*) / 20.0 AS exposure FROM trades t JOIN days d ON d.day_index BETWEEN t.day_index AND t.day_index + 2 GROUP BY 1),
  cv AS (SELECT trade_date, coalesce(ret, 0) AS ret, coalesce(exposure, 0) AS exposure FROM days LEFT JOIN sp USING (day_index)),
  e AS (SELECT *, product(1 + ret) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS eq FROM cv), dd AS (SELECT *, eq / max(eq) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM e)"""
register("pf_slot_portfolio", lambda spark, sf: tidy(pf.slot_portfolio(*slots(spark, sf), 3, 20.0, 12.0)[1]),
         f"WITH {_SLOT} SELECT {r('pow(product(1 + ret), 12.0 / count(*)) - 1', 'cagr')}, {r('avg(ret) / stddev_samp(ret) * sqrt(12)', 'sharpe')}, {r('min(d)', 'max_drawdown')}, {r('avg(exposure)', 'avg_exposure')}, count(*) AS days FROM dd")
register("pf_kill_test", lambda spark, sf: tidy(pf.without_top_contributors(slots(spark, sf)[0], 5).agg(F.count("*").alias("n"), F.sum("ret").alias("total"))),
         f"WITH {TRADES} SELECT count(*) AS n, {r('sum(ret)', 'total')} FROM trades WHERE vt_symbol NOT IN (SELECT vt_symbol FROM trades GROUP BY 1 ORDER BY sum(ret) DESC, vt_symbol LIMIT 5)")
register("pf_worst_year", lambda spark, sf: tidy(pf.worst_year(pf.slot_portfolio(*slots(spark, sf), 3, 20.0, 12.0)[0], 12.0)),
         f"WITH {_SLOT} SELECT CAST(year(trade_date) AS INTEGER) AS year, {r('CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(12) ELSE CAST(\'nan\' AS DOUBLE) END', 'sharpe')}, {r('product(1 + ret) - 1', 'total')} FROM dd GROUP BY 1")
register("pf_calendar_metrics", lambda spark, sf: tidy(pf.calendar_metrics(slots(spark, sf)[0].groupBy("trade_date").agg(F.avg("ret").alias("x0")), slots(spark, sf)[1], "x0", 12.0)),
         f"WITH {TRADES}, d AS (SELECT trade_date, avg(ret) AS x FROM trades GROUP BY 1), f AS (SELECT coalesce(x, 0) AS x FROM days LEFT JOIN d USING (trade_date)) "
         f"SELECT {r('product(1 + x) - 1', 'total_return')}, {r('pow(product(1 + x), 12.0 / count(*)) - 1', 'annual_return')}, {r('avg(x) / stddev_samp(x) * sqrt(12)', 'sharpe')}, count(*) AS days FROM f")
register("pf_holding_value", lambda spark, sf: tidy(pf.holding_value(bars(spark, sf).select("datetime", "vt_symbol", F.lit(10.0).alias("pos")), bars(spark, sf), table(spark, sf, "supplier").select(
    F.col("s_suppkey").cast("string").alias("vt_symbol"), F.lit(5.0).alias("size")))),
    f"WITH {BARS} SELECT datetime, {r('sum(close * 50)', 'holding_value')} FROM bars GROUP BY 1")
register("pf_signal_at_times", lambda spark, sf: tidy(pf.signal_at(signal(spark, sf), bars(spark, sf).where("month(datetime) = 6")).select("datetime", "vt_symbol", "signal")),
         f"WITH {SIG} SELECT datetime, vt_symbol, {r('signal', 'signal')} FROM sig WHERE month(datetime) = 6")
register("pf_net_return", lambda spark, sf: tidy(bars(spark, sf).select("vt_symbol", "datetime", pf.net_return(F.col("open"), F.col("close"), 0.001, 0.002).alias("net"))),
         f"WITH {BARS} SELECT vt_symbol, datetime, {r('close * 0.998 / (open * 1.001) - 1', 'net')} FROM bars")
