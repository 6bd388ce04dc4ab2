"""Factor families over the bar panel and an enriched panel derived from it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.factors import alpha101, alpha158, common, composites, patterns
from barloom.factors.spec import expressions, extract
from barloom.functions import safe
from barloom.operators import portfolio as pf
from barloom.plans.panel import Panel

from catalog.base import BARS, DAILY, W, WS, avg_rank, bars, daily_bars, panel_query, r, register, table, tidy
from catalog.operators_basic import corr_sql, full
from catalog.sqlgen import COMPARISONS, family_sql


def enriched(spark, sf, panel=bars):
    """Bars plus stand-ins for limits, turnover rate, valuation, fundamentals, benchmark and regime."""
    sym = Window.partitionBy("vt_symbol").orderBy("datetime")
    day = Window.partitionBy("datetime")
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("vt_symbol"), "s_nationkey")
    df = panel(spark, sf).join(nation, "vt_symbol")
    before, vol, tov = F.lag("close").over(sym), F.lag("volume").over(sym), F.lag("turnover").over(sym)
    df = df.withColumns({
        "up_limit": before * 1.1, "down_limit": before * 0.9,
        "fi_netprofit_yoy": safe.safe_div(F.col("volume"), vol) - 1, "fi_or_yoy": safe.safe_div(F.col("turnover"), tov) - 1,
    })
    df = df.withColumns({
        "raw_open": F.col("open"), "raw_high": F.col("high"), "raw_low": F.col("low"), "raw_close": F.col("close"),
        "turnover_rate": F.col("volume") / 50, "pb": F.col("close") / 1000, "pe_ttm": F.col("vwap") / 100,
        "ps_ttm": F.col("turnover") / 100000, "dv_ttm": F.col("low") / F.col("close"), "fi_roe": F.col("open") / F.col("close") - 1,
        "fi_grossprofit_margin": (F.col("high") - F.col("low")) / F.col("close"), "fi_debt_to_assets": F.col("low") / F.col("high"),
        "total_mv": F.col("turnover") * 10, "circ_mv": F.col("turnover") * 5,
        "is_limit_up": (F.col("close") >= F.col("up_limit") * 0.999).cast("double"),
        "rank_score": F.col("volume") / 5, "heat_score": F.col("close") / 30,
        "market_regime": F.element_at(F.array(*[F.lit(x) for x in ("bull_active", "range_neutral", "weak_defensive", "bear_pause", "unknown")]),
                                      (F.month("datetime") % 5 + 1).cast("int")),
    })
    return df.withColumns({
        "benchmark_close": F.round(F.avg("close").over(day), 6),
        "industry_close": F.round(F.avg("close").over(Window.partitionBy("datetime", "s_nationkey")), 6),
    })


ENRICHED = BARS + """, e0 AS (SELECT b.*, s_nationkey FROM bars b JOIN supplier ON CAST(s_suppkey AS VARCHAR) = vt_symbol),
 e1 AS (SELECT *, lag(close) OVER w * 1.1 AS up_limit, lag(close) OVER w * 0.9 AS down_limit,
   volume / lag(volume) OVER w - 1 AS fi_netprofit_yoy, turnover / lag(turnover) OVER w - 1 AS fi_or_yoy,
   open AS raw_open, high AS raw_high, low AS raw_low, close AS raw_close, volume / 50 AS turnover_rate, close / 1000 AS pb,
   vwap / 100 AS pe_ttm, turnover / 100000 AS ps_ttm, low / close AS dv_ttm, open / close - 1 AS fi_roe,
   (high - low) / close AS fi_grossprofit_margin, low / high AS fi_debt_to_assets, turnover * 10 AS total_mv, turnover * 5 AS circ_mv,
   volume / 5 AS rank_score, close / 30 AS heat_score,
   ['bull_active', 'range_neutral', 'weak_defensive', 'bear_pause', 'unknown'][month(datetime) % 5 + 1] AS market_regime
   FROM e0 WINDOW w AS (PARTITION BY vt_symbol ORDER BY datetime)),
 enriched AS MATERIALIZED (SELECT *, CAST(close >= up_limit * 0.999 AS DOUBLE) AS is_limit_up,
   round(avg(close) OVER (PARTITION BY datetime), 6) AS benchmark_close,
   round(avg(close) OVER (PARTITION BY datetime, s_nationkey), 6) AS industry_close, """ + ", ".join(
    f"CAST(market_regime = '{x}' AS INTEGER) AS regime_{x}" for x in ("bull_active", "range_neutral", "weak_defensive", "bear_pause", "unknown")) + " FROM e1)"


def daily_enriched(spark, sf):
    return enriched(spark, sf, daily_bars)


DAILY_ENRICHED = ENRICHED.replace(BARS, DAILY)
#: (panel, its SQL, its relation) by whether it is enriched and whether it is daily.
PANELS = {(False, False): (bars, BARS, "bars"), (True, False): (enriched, ENRICHED, "enriched"),
          (False, True): (daily_bars, DAILY, "bars"), (True, True): (daily_enriched, DAILY_ENRICHED, "enriched")}


def family_query(name, factors, rich=False, digits=7, daily=False):
    """A family on monthly bars, or on daily ones where its windows are long."""
    frame, base, relation = PANELS[rich, daily]
    flags = {f.name for f in factors if f.expr.op == "map" and f.expr.params[0].__name__ in COMPARISONS}

    def run(spark, sf):
        df = extract(Panel(frame(spark, sf)), factors)
        counts = {f.name: F.col(f.name).cast("double") for f in factors if f.name not in flags}
        return tidy(df.withColumns(counts) if counts else df, digits)

    register(name, run,
             family_sql(expressions(factors), base, relation, digits))


for w in alpha158.WINDOWS:
    family_query(f"fa_alpha158_window_{w}", alpha158.factors((w,)))
family_query("fa_classic_price", common.classic_price(), daily=True)
family_query("fa_technical", common.technical())
family_query("fa_candlestick", common.candlestick())
family_query("fa_accumulation", common.accumulation())
_crowding = [f for f in common.liquidity() if "crowding_score" in f.name]
family_query("fa_liquidity", [f for f in common.liquidity() if "crowding_score" not in f.name], rich=True)
family_query("fa_crowding_score", _crowding, rich=True, daily=True)
family_query("fa_position_breakout", common.position(), daily=True)
family_query("fa_oscillator", common.oscillator())
family_query("fa_relative_strength", common.relative_strength(), rich=True)
family_query("fa_limit_state", common.limit_state(), rich=True)
family_query("fa_fundamental", common.fundamental(), rich=True)
family_query("fa_mean_groups", common.mean_groups())
family_query("fa_channels", common.channels(), daily=True)
family_query("fa_compression", common.compression())
family_query("fa_trade_filters", common.trade_filters(), rich=True)
family_query("fa_double_bottom", patterns.double_bottom(), daily=True)
family_query("fa_box", patterns.box())
family_query("fa_box_trade_rules", patterns.trade_rules(), rich=True, daily=True)
family_query("fa_combos", composites.combos(), rich=True)
family_query("fa_trend_rsi", composites.trend_rsi(1), daily=True)
family_query("fa_trend_rsi_v2", composites.trend_rsi(2), daily=True)
family_query("fa_first_pass_scan", composites.first_pass(), rich=True, daily=True)
family_query("fa_signal_close_extras", composites.signal_close_extras(), rich=True)
for name, exprs in (("fa_candidate_composites", composites.candidates() | composites.candidate_composites()),
                    ("fa_price_flow_3", composites.price_flow_3()),
                    ("fa_panel_expressions", composites.panel_expressions())):
    register(name, lambda spark, sf, exprs=exprs: tidy(Panel(daily_enriched(spark, sf)).select(exprs), 7),
             family_sql(exprs, DAILY_ENRICHED, "enriched", 7))

_all = alpha101.formulas()
#: These rank or compare values that tie on short monthly windows.
UNSTABLE = ("alpha45", "alpha64", "alpha78", "alpha99")
for lo, hi in ((1, 20), (21, 40), (41, 60), (61, 80), (81, 101)):
    part = {k: v for k, v in _all.items() if lo <= int(k[5:]) <= hi and k not in UNSTABLE}
    register(f"fa_alpha101_{lo}_{hi}", lambda spark, sf, part=part: tidy(Panel(bars(spark, sf)).select(part)),
             family_sql(part))
# alpha45 ranks two-bar correlations, which are all plus or minus one: rows only
register("fa_alpha101_rows_only",
         lambda spark, sf: tidy(Panel(bars(spark, sf)).select({k: _all[k] for k in UNSTABLE})))
for _name in ("alpha64", "alpha78", "alpha99"):
    register(f"fa_{_name}_daily", lambda spark, sf, part={_name: _all[_name]}: tidy(Panel(daily_bars(spark, sf)).select(part)), family_sql({_name: _all[_name]}, DAILY))

# ------------------------------------------------ formulas written out by hand
panel_query("fa_alpha158_by_hand", {
    f.name: f.expr for f in alpha158.factors((10,)) if f.name in (
        "kmid", "klen", "kmid_2", "kup", "kup_2", "klow", "klow_2", "ksft", "ksft_2", "vwap_0", "roc_10", "ma_10", "std_10", "beta_10", "rsqr_10",
        "max_10", "min_10", "qtlu_10", "qtld_10", "rsv_10", "corr_10", "cntp_10", "cntd_10", "sump_10", "sumd_10", "vma_10", "vstd_10", "wvma_10", "vsumn_10")
}, {
    "kmid": "(close - open) / open", "klen": "(high - low) / open", "kmid_2": "(close - open) / (high - low + 1e-12)",
    "kup": "(high - greatest(open, close)) / open", "kup_2": "(high - greatest(open, close)) / (high - low + 1e-12)",
    "klow": "(least(open, close) - low) / open", "klow_2": "(least(open, close) - low) / (high - low + 1e-12)",
    "ksft": "(close * 2 - high - low) / open", "ksft_2": "(close * 2 - high - low) / (high - low + 1e-12)", "vwap_0": "vwap / close",
    "roc_10": f"lag(close, 10) OVER {WS} / close", "ma_10": f"avg(close) OVER {W(10)} / close", "std_10": f"stddev_pop(close) OVER {W(10)} / close",
    "beta_10": f"({full('regr_slope(close, i)', 'close', 10)}) / close", "rsqr_10": full("regr_r2(close, i)", "close", 10),
    "max_10": f"max(high) OVER {W(10)} / close", "min_10": f"min(low) OVER {W(10)} / close",
    "qtlu_10": f"({full('quantile_cont(close, 0.8)', 'close', 10)}) / close", "qtld_10": f"({full('quantile_cont(close, 0.2)', 'close', 10)}) / close",
    "rsv_10": f"(close - min(low) OVER {W(10)}) / (max(high) OVER {W(10)} - min(low) OVER {W(10)} + 1e-12)",
    "corr_10": corr_sql("close", "ln(volume + 1)", 10),
    "cntp_10": f"avg(CAST(d > 0 AS INTEGER)) OVER {W(10)}", "cntd_10": f"avg(sign(d)) OVER {W(10)}",
    "sump_10": f"({full('sum(greatest(d, 0))', 'greatest(d, 0)', 10)}) / (({full('sum(abs(d))', 'd', 10)}) + 1e-12)",
    "sumd_10": f"({full('sum(d)', 'd', 10)}) / (({full('sum(abs(d))', 'd', 10)}) + 1e-12)",
    "vma_10": f"avg(volume) OVER {W(10)} / (volume + 1e-12)", "vstd_10": f"stddev_pop(volume) OVER {W(10)} / (volume + 1e-12)",
    "wvma_10": f"stddev_pop(m) OVER {W(10)} / (avg(m) OVER {W(10)} + 1e-12)",
    "vsumn_10": f"({full('sum(greatest(-dv, 0))', 'greatest(-dv, 0)', 10)}) / (({full('sum(abs(dv))', 'dv', 10)}) + 1e-12)",
}, f"""d AS (SELECT *, row_number() OVER {WS} - 1.0 AS i, close - lag(close) OVER {WS} AS d, volume - lag(volume) OVER {WS} AS dv,
   abs(close / lag(close) OVER {WS} - 1) * volume AS m FROM bars)""", "d", digits=5)

# the templates of five families, written out as SQL over daily bars
E = "1e-12"
_sum = lambda x, n: f"({full(f'sum({x})', x, n)})"
_HAND = {
    "classic_momentum_120": avg_rank("m120"), "classic_reversal_20": f"-({avg_rank('m20')})", "classic_range_position_120": avg_rank("rp120"), "classic_low_volatility_20": f"-({avg_rank('vol20')})",
    "classic_volume_ratio_60": avg_rank("vr60"), "classic_turnover_ratio_60": avg_rank("tr60"),
    "common_momentum_20": f"close / (lag(close, 20) OVER {WS} + {E}) - 1", "common_ma_bias_60": f"close / (avg(close) OVER {W(60)} + {E}) - 1", "common_range_position_20": f"(close - min(low) OVER {W(20)}) / (max(high) OVER {W(20)} - min(low) OVER {W(20)} + {E})",
    "common_return_volatility_20": "vole20", "common_volume_ratio_20": f"volume / (avg(pv) OVER {W(20)} + {E})", "common_turnover_ratio_60": f"turnover / (avg(pt) OVER {W(60)} + {E})",
    "common_open_gap": f"open / (pc + {E}) - 1", "common_intraday_return": f"close / (open + {E}) - 1", "common_high_low_range_pct": f"(high - low) / (open + {E})", "common_real_body_pct": f"abs(close - open) / (open + {E})",
    "common_body_to_range": f"abs(close - open) / (high - low + {E})", "common_close_position": f"(close - low) / (high - low + {E})", "common_open_position": f"(open - low) / (high - low + {E})",
    "common_upper_shadow_pct": f"(high - greatest(open, close)) / (open + {E})", "common_lower_shadow_pct": f"(least(open, close) - low) / (open + {E})", "common_upper_shadow_ratio": f"(high - greatest(open, close)) / (high - low + {E})",
    "common_lower_shadow_ratio": f"(least(open, close) - low) / (high - low + {E})", "common_candle_shift": f"(close * 2 - high - low) / (open + {E})",
    "common_obv_pressure_20": f"{_sum('sv', 20)} / ({_sum('volume', 20)} + {E})", "common_pvt_pressure_60": f"{_sum('rv', 60)} / ({_sum('volume', 60)} + {E})", "common_cmf_20": f"{_sum('lv', 20)} / ({_sum('volume', 20)} + {E})",
    "common_money_flow_pressure_20": f"{_sum('st', 20)} / ({_sum('turnover', 20)} + {E})", "common_volume_weighted_return_20": f"{_sum('rv', 20)} / ({_sum('volume', 20)} + {E})",
    "common_up_volume_ratio_20": f"{_sum('uv', 20)} / ({_sum('volume', 20)} + {E})", "common_down_volume_ratio_60": f"{_sum('dv', 60)} / ({_sum('volume', 60)} + {E})",
    "common_close_to_high_120": f"(max(high) OVER {W(120)} - close) / (close + {E})", "common_close_to_low_60": f"(close - min(low) OVER {W(60)}) / (close + {E})", "common_drawdown_from_high_120": f"close / (max(high) OVER {W(120)} + {E}) - 1",
    "common_rebound_from_low_20": f"close / (min(low) OVER {W(20)} + {E}) - 1", "common_prior_high_breakout_60": f"close / (max(ph) OVER {W(60)} + {E}) - 1", "common_prior_low_breakdown_20": f"close / (min(pl) OVER {W(20)} + {E}) - 1",
    "common_low_reclaim_strength_120": f"(close - low) / (max(high) OVER {W(120)} - min(low) OVER {W(120)} + {E})",
    "common_stoch_k_14": "k14", "common_stoch_d_14": f"avg(k14) OVER {W(3)}", "common_williams_r_14": f"-(max(high) OVER {W(14)} - close) / (max(high) OVER {W(14)} - min(low) OVER {W(14)} + {E})",
    "common_cci_14": f"(tp - tm) / (avg(abs(tp - tm)) OVER {W(14)} * 0.015 + {E})", "common_up_day_ratio_14": f"avg(CAST(close > pc AS INTEGER)) OVER {W(14)}", "common_down_day_ratio_20": f"avg(CAST(close < pc AS INTEGER)) OVER {W(20)}",
    "common_dmi_balance_14": f"({_sum('up', 14)} - {_sum('dn', 14)}) / ({_sum('up', 14)} + {_sum('dn', 14)} + {E})",
}
_by_name = {f.name: f.expr for family in (common.classic_price(), common.technical(), common.candlestick(), common.accumulation(), common.position(), common.oscillator()) for f in family}
panel_query("fa_common_by_hand", {n: _by_name[n] for n in _HAND}, _HAND, f"""
  h0 AS (SELECT *, lag(close) OVER {WS} AS pc, lag(volume) OVER {WS} AS pv, lag(turnover) OVER {WS} AS pt, lag(high) OVER {WS} AS ph, lag(low) OVER {WS} AS pl, (high + low + close) / 3 AS tp FROM bars),
  h1 AS (SELECT *, lag(tp) OVER {WS} AS ptp, avg(tp) OVER {W(14)} AS tm, close / pc - 1 AS r, close / (pc + {E}) - 1 AS re, CASE WHEN close > pc THEN 1.0 WHEN close < pc THEN -1.0 ELSE 0.0 END * volume AS sv, (close / (pc + {E}) - 1) * volume AS rv,
    ((close - low) - (high - close)) / (high - low + {E}) * volume AS lv, CAST(close > pc AS INTEGER) * volume AS uv, CAST(close < pc AS INTEGER) * volume AS dv, greatest(high - ph, 0) AS up, greatest(pl - low, 0) AS dn,
    (close - min(low) OVER {W(14)}) / (max(high) OVER {W(14)} - min(low) OVER {W(14)} + {E}) AS k14, close / lag(close, 20) OVER {WS} - 1 AS m20, close / lag(close, 120) OVER {WS} - 1 AS m120,
    (close - min(low) OVER {W(120)}) / (max(high) OVER {W(120)} - min(low) OVER {W(120)} + {E}) AS rp120, volume / (avg(volume) OVER {W(60)} + {E}) AS vr60, turnover / (avg(turnover) OVER {W(60)} + {E}) AS tr60 FROM h0),
  h2 AS (SELECT *, CASE WHEN tp > ptp THEN 1.0 WHEN tp < ptp THEN -1.0 ELSE 0.0 END * turnover AS st, stddev_pop(r) OVER {W(20)} AS vol20, stddev_pop(re) OVER {W(20)} AS vole20 FROM h1)""", "h2", digits=5, frame=daily_bars, base=DAILY)

# ------------------------------------------- frames of the strategy on its own factors
_SPAN = {"train": ("1993-01-01", "1995-12-31"), "test": ("1996-01-01", "1997-12-31")}
_BOOK = pf.PortfolioConfig(top_n=3, rebalance_days=20, entry_lag=1)
_RULES = dict(member="in_large", new_listing_days=60, min_turnover=20_000.0, min_circ_mv=150_000.0)


def research_panel(spark, sf):
    """The enriched daily panel with the columns of a research panel."""
    df = daily_enriched(spark, sf).withColumn("trade_date", F.col("datetime").cast("date"))
    return df.select("trade_date", "vt_symbol", F.when(F.col("vt_symbol") == "7", "ST 7").otherwise(F.concat(F.lit("N"), "vt_symbol")).alias("name"),
                     F.when(F.col("vt_symbol") != "3", F.date_add(F.lit("1992-06-01").cast("date"), (F.col("vt_symbol").cast("int") * 40))).alias("list_date"),
                     (F.col("close") >= F.col("up_limit")).alias("is_limit_up"), (F.col("close") <= F.col("down_limit")).alias("is_limit_down"), (F.col("volume") > 20).alias("has_valid_bar"),
                     F.lit(True).alias("is_list_life_valid"), (F.dayofmonth("trade_date") != 13).alias("in_large"), "close", "volume", "turnover", "turnover_rate", "circ_mv", "total_mv", "pb", "pe_ttm")


_FLT = DAILY_ENRICHED + """, flt AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(datetime AS DATE) AS trade_date, CASE WHEN vt_symbol = '7' THEN 'ST 7' ELSE 'N' || vt_symbol END AS name,
    CASE WHEN vt_symbol <> '3' THEN DATE '1992-06-01' + CAST(vt_symbol AS INTEGER) * 40 END AS list_date, close >= up_limit AS lu, close <= down_limit AS ld, volume > 20 AS valid FROM enriched)
    WHERE trade_date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' AND day(trade_date) <> 13)"""
_MASKS = f"""SELECT vt_symbol, datetime, trade_date, close / lag(close) OVER {WS} - 1 AS daily_return, lead(close, 21) OVER {WS} / lead(close) OVER {WS} - 1 AS fhr,
    valid AND close > 0 AND name NOT LIKE '%ST%' AND turnover >= 20000 AND circ_mv >= 150000 AS ben,
    list_date IS NOT NULL AND trade_date >= list_date + 60 AND NOT coalesce(lead(lu) OVER {WS}, false) AND NOT coalesce(lead(ld) OVER {WS}, false) AS sig FROM flt"""
_STRATEGY = f"""(WITH {_FLT} {_MASKS}) m JOIN ({family_sql({'combo_price_flow_3': composites.price_flow_3()['combo_price_flow_3']}, _FLT, 'flt', 7)}) f USING (vt_symbol, datetime)"""
register("pf_backtest_frame", lambda spark, sf: tidy(pf.backtest_frame(research_panel(spark, sf), _BOOK, _SPAN, **_RULES), 7),
         f"SELECT trade_date, vt_symbol, {r('daily_return', 'daily_return', 7)}, ben AND sig AS signal_eligible, ben AS benchmark_eligible, combo_price_flow_3 FROM {_STRATEGY}")
register("pf_exposure_frame", lambda spark, sf: tidy(pf.exposure_frame(research_panel(spark, sf), _BOOK, _SPAN, **_RULES).select(
    "trade_date", "vt_symbol", "forward_holding_return", "signal_eligible", "benchmark_eligible", "combo_price_flow_3"), 7),
         f"SELECT trade_date, vt_symbol, {r('fhr', 'forward_holding_return', 7)}, ben AND sig AS signal_eligible, ben AS benchmark_eligible, combo_price_flow_3 FROM {_STRATEGY}")
