"""Event studies, exit rules, minute studies, streaming operators and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import ta
from barloom.functions.expr import apply, close, col, high, low, shift
from barloom.functions.ts import full_max, full_mean, full_min, full_pct_rank, ts_mean, ts_sum
from barloom.operators import events as es
from barloom.operators import minute as mn
from barloom.operators import models as ml
from barloom.operators import paths as pa
from barloom.plans import intervals as iv
from barloom.plans.panel import Panel
from barloom.streaming import bars as sb
from barloom.streaming import state as st

from catalog.base import BARS, W, WS, bars, panel_query, r, register, table, tidy
from catalog.evaluation import FEATURES, LABELS, SCORED
from catalog.operators_basic import full
from catalog.portfolio import SEG


# ------------------------------------------------------------------ event pool
def events(spark, sf):
    """Jumps above the previous close as signals, with scores and flags."""
    df = Panel(bars(spark, sf)).with_columns({"jump": close / shift(close, 1) - 1.0, "h1": LABELS["h1"], "h3": LABELS["h3"], "f1": FEATURES["f1"]})
    nation = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("vt_symbol"), "s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey") % 5).alias("industry"))
    df = df.where("jump > 0.1").join(nation, "vt_symbol")
    m = F.col("s_suppkey") % 3
    return df.select(
        F.concat_ws("|", "vt_symbol", F.date_format("datetime", "yyyy-MM")).alias("event_id"), "vt_symbol", F.col("datetime").alias("signal_date"), "industry", "jump",
        F.col("high").alias("signal_high"), F.col("low").alias("signal_low"), F.col("close").alias("signal_close"), "h1", "h3", "volume", "s_suppkey",
        F.when(m == 0, "L1").when(m == 1, "L2").otherwise("L3").alias("buy_point_type"),
        F.when(F.col("s_suppkey") % 4 == 0, F.lit("panic_reversal")).when(F.col("s_suppkey") % 4 == 1, F.lit("both")).alias("start_type"),
        F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("B").alias("start_grade"), (F.col("volume") > 60).alias("open_executable"),
        F.round(F.col("volume") / 300, 6).alias("start_score"), F.round(F.col("jump") / (1 + F.col("jump")), 6).alias("score2"))


EV = BARS + f""", eb AS (SELECT *, close / lag(close) OVER {WS} - 1 AS jump, lead(close, 2) OVER {WS} / lead(close, 1) OVER {WS} - 1 AS h1,
  lead(close, 4) OVER {WS} / lead(close, 1) OVER {WS} - 1 AS h3, row_number() OVER {WS} - 1 AS idx FROM bars),
  ev AS MATERIALIZED (SELECT vt_symbol || '|' || strftime(datetime, '%Y-%m') AS event_id, vt_symbol, datetime AS signal_date, 'N' || s_nationkey % 5 AS industry, jump, high AS signal_high, low AS signal_low,
    close AS signal_close, h1, h3, volume, s_suppkey, idx, CASE s_suppkey % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' ELSE 'L3' END AS buy_point_type,
    CASE s_suppkey % 4 WHEN 0 THEN 'panic_reversal' WHEN 1 THEN 'both' END AS start_type, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS start_grade,
    volume > 60 AS open_executable, round(volume / 300, 6) AS start_score, round(jump / (1 + jump), 6) AS score2 FROM eb JOIN supplier ON CAST(s_suppkey AS VARCHAR) = vt_symbol WHERE jump > 0.1)"""

register("es_buy_points", lambda spark, sf: es.buy_point_columns(events(spark, sf), {"L1": "start", "L2": "confirm"}).select("event_id", "buy_point_label", "buy_point_subtype"),
         f"""WITH {EV} SELECT event_id, CASE buy_point_type WHEN 'L1' THEN 'start' WHEN 'L2' THEN 'confirm' ELSE buy_point_type END AS buy_point_label,
         CASE buy_point_type WHEN 'L1' THEN coalesce(start_type, 'unknown_start_type') WHEN 'L2' THEN 'confirm_raw' ELSE 'raw' END AS buy_point_subtype FROM ev""")
register("es_signal_pool", lambda spark, sf: es.signal_pool(events(spark, sf), "L1", {"open_executable": True, "absent": True}).select("event_id"), f"WITH {EV} SELECT event_id FROM ev WHERE buy_point_type = 'L1' AND open_executable")
register("es_day_filter", lambda spark, sf: tidy(es.day_filter(events(spark, sf), "start_score", 0.4).select("event_id", "signal_count", "symbol_count", "score_mean", "score_max")),
         f"WITH {EV}, d AS (SELECT signal_date, count(*) AS signal_count, count(DISTINCT vt_symbol) AS symbol_count, avg(start_score) AS m, max(start_score) AS x FROM ev GROUP BY 1 HAVING avg(start_score) >= 0.4) "
         f"SELECT event_id, signal_count, symbol_count, {r('m', 'score_mean')}, {r('x', 'score_max')} FROM ev JOIN d USING (signal_date)")
register("es_resolve_signal_date", lambda spark, sf: es.resolve_signal_date(events(spark, sf), "start_score", 0.4), f"WITH {EV} SELECT max(signal_date) AS signal_date FROM (SELECT signal_date FROM ev GROUP BY 1 HAVING avg(start_score) >= 0.4)")
_RK = EV + ", rk AS (SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY start_score DESC NULLS LAST, score2 DESC NULLS LAST, vt_symbol) AS rk FROM ev)"
ranked = lambda spark, sf: es.rank_pool(events(spark, sf), ["start_score", "score2"])
register("es_rank_pool", lambda spark, sf: ranked(spark, sf).select("event_id", "signal_close_rank"), f"WITH {_RK} SELECT event_id, CAST(rk AS INTEGER) AS signal_close_rank FROM rk")
register("es_top_executable", lambda spark, sf: es.top_executable(ranked(spark, sf), 3).select("event_id", "next_open_execution_rank"),
         f"WITH {_RK} SELECT event_id, CAST(k AS INTEGER) AS next_open_execution_rank FROM (SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY rk) AS k FROM rk WHERE open_executable) WHERE k <= 3")
register("es_industry_capped", lambda spark, sf: es.industry_capped(ranked(spark, sf), 5, 0.3).select("event_id", "pick"),
         f"WITH {_RK}, i AS (SELECT *, row_number() OVER (PARTITION BY signal_date, industry ORDER BY rk) AS n FROM rk), p AS (SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY rk) AS pick FROM i WHERE n <= 2) "
         "SELECT event_id, CAST(pick AS INTEGER) AS pick FROM p WHERE pick <= 5")
planned = lambda spark, sf: es.plan_return(events(spark, sf).withColumns({"hit": F.col("h1") > 0.1, "net": F.lit(0.1)}), "hit", "net", "h3")
_PL = EV + ", pl AS (SELECT *, CASE WHEN coalesce(h1 > 0.1, false) THEN 0.1 ELSE h3 END AS plan_return FROM ev)"
register("es_plan_return", lambda spark, sf: tidy(planned(spark, sf).select("event_id", "plan_return")), f"WITH {_PL} SELECT event_id, {r('plan_return', 'plan_return')} FROM pl")
_DS = _PL + """, dr AS (SELECT signal_date, avg(plan_return) AS x, count(*) AS n FROM pl GROUP BY 1), de AS (SELECT *, product(1 + coalesce(x, 0)) OVER (ORDER BY signal_date ROWS UNBOUNDED PRECEDING) AS e FROM dr),
  dd AS (SELECT *, e / max(e) OVER (ORDER BY signal_date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM de)"""
_sum = (f"count(*) AS days, {r('avg(x)', 'mean')}, {r('quantile_cont(x, 0.1)', 'p10')}, {r('median(x)', 'median')}, {r('avg(CAST(x > 0 AS DOUBLE))', 'win_rate')}, {r('min(d)', 'max_drawdown')}, {r('product(1 + x) - 1', 'compounded')}")
register("es_daily_summary", lambda spark, sf: tidy(es.daily_summary(es.equal_weight_daily(planned(spark, sf), "plan_return"))), f"WITH {_DS} SELECT {_sum} FROM dd")
_AR = lambda x: f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY signal_date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY signal_date, {x}) - 1) / 2.0 END"
register("es_pct_rank_by_day", lambda spark, sf: tidy(es.pct_rank_by_day(es.pct_rank_by_day(events(spark, sf), ["start_score"], "up_"), ["h1"], "down_", False).select("event_id", "up_start_score", "down_h1")),
         f"WITH {EV}, n AS (SELECT *, -h1 AS nh FROM ev) SELECT event_id, {r('(' + _AR('start_score') + ') / count(start_score) OVER (PARTITION BY signal_date)', 'up_start_score')}, "
         f"{r('coalesce((' + _AR('nh') + ') / count(nh) OVER (PARTITION BY signal_date), 0.5)', 'down_h1')} FROM n")


def score_source(spark, sf):
    v = F.col("volume") / 400
    return events(spark, sf).withColumns({
        "bar_range_pct": (F.col("signal_high") - F.col("signal_low")) / F.col("signal_close"), "turnover_rate": v, "rsi": F.col("jump"), "circ_mv": F.col("signal_close"),
        "factor_core4_pct": v, "factor_pvcorr60_pct": F.col("score2"), "candidate_pool_score": 1 - v, "short_tp_score_v1": F.col("score2"), "industry_rs_bucket_score": F.col("s_suppkey") % 6,
        "market_stage_bucket_score": F.col("s_suppkey") % 5, "vol_quality_bucket_score": F.col("s_suppkey") % 4, "rank_score_core4_short70_30": v, "rank_score_short_tp_v1": F.col("score2")})


_c5 = lambda x: f"greatest(0, least(1, coalesce({x}, 0.5)))"
_pr = lambda x: _c5("(" + _AR(x) + f") / count({x}) OVER (PARTITION BY signal_date)")
_SC = EV + f""", s0 AS (SELECT *, (signal_high - signal_low) / signal_close AS rng, volume / 400 AS v FROM ev), s1 AS (SELECT *, {_pr('start_score')} AS c_ss, {_pr('rng')} AS c_rng, {_pr('v')} AS c_to, {_pr('jump')} AS c_rsi, {_pr('signal_close')} AS c_sz,
  {_c5('v')} AS core4, {_c5('score2')} AS pv, {_c5('1 - v')} AS cp, {_c5('score2')} AS stp, {_c5('s_suppkey % 6')} AS ind, {_c5('s_suppkey % 4')} AS vq,
  CASE start_type WHEN 'panic_reversal' THEN 1.0 WHEN 'both' THEN 0.85 WHEN 'exhaustion_start' THEN 0.6 ELSE 0.5 END AS st FROM s0),
  s2 AS (SELECT *, (c_rng + 0.5 + c_to + 0.5 + 0.5 + 0.5 + 0.5) / 7 AS thrust, (0.5 * 5 + c_rsi) / 6 AS repair, (core4 + pv + 0.5 + 0.5 + c_sz) / 5 AS fs, (ind + 0.5 + vq) / 3 AS ctx, (c_ss + st) / 2 AS sq FROM s1)"""
register("es_score_candidates", lambda spark, sf: tidy(es.score_candidates(score_source(spark, sf)).select(
    "event_id", "l1_rank_score_eod_v1", "l1_rank_score_balanced_v1", "l1_rank_score_short_focus_v1", "l1_rank_score_context_safe_v1", "l1_rank_score_thrust_v1", "blend_core4_candidate_70_30",
    "blend_core4_pvcorrpct_80_20", "cond_panic_core4_else_candidate", "cond_grade_a_core4_else_short", "cond_weak_market_context_else_core4", "cond_strong_industry_core4_else_candidate"), 9),
    f"""WITH {_SC} SELECT event_id, {r('least(1, 0.34*thrust + 0.22*sq + 0.20*fs + 0.14*ctx + 0.10*stp)', 'l1_rank_score_eod_v1', 9)}, {r('least(1, 0.35*core4 + 0.30*stp + 0.20*thrust + 0.15*ctx)', 'l1_rank_score_balanced_v1', 9)},
    {r('least(1, 0.45*stp + 0.25*thrust + 0.20*core4 + 0.10*ctx)', 'l1_rank_score_short_focus_v1', 9)}, {r('least(1, 0.35*fs + 0.25*ctx + 0.20*sq + 0.20*vq)', 'l1_rank_score_context_safe_v1', 9)},
    {r('least(1, 0.58*thrust + 0.22*repair + 0.20*sq)', 'l1_rank_score_thrust_v1', 9)}, {r('0.7*core4 + 0.3*cp', 'blend_core4_candidate_70_30', 9)}, {r('0.8*core4 + 0.2*pv', 'blend_core4_pvcorrpct_80_20', 9)},
    {r("CASE WHEN start_type = 'panic_reversal' THEN core4 ELSE cp END", 'cond_panic_core4_else_candidate', 9)}, {r("CASE WHEN start_grade = 'A' THEN core4 ELSE stp END", 'cond_grade_a_core4_else_short', 9)},
    {r('CASE WHEN s_suppkey % 5 <= 2 THEN least(1, 0.35*fs + 0.25*ctx + 0.20*sq + 0.20*vq) ELSE core4 END', 'cond_weak_market_context_else_core4', 9)}, {r('CASE WHEN s_suppkey % 6 >= 4 THEN core4 ELSE cp END', 'cond_strong_industry_core4_else_candidate', 9)} FROM s2""")
_SG = EV + """, sg0 AS (SELECT event_id, vt_symbol, signal_date, h1, h3, 'start_score' AS score_name, start_score AS score FROM ev UNION ALL SELECT event_id, vt_symbol, signal_date, h1, h3, 'score2', score2 FROM ev),
  sg1 AS (SELECT *, row_number() OVER (PARTITION BY score_name, signal_date ORDER BY score DESC NULLS LAST, vt_symbol) AS rank FROM sg0), sg AS (SELECT * FROM sg1, (VALUES (1), (3)) k(top_k) WHERE rank <= top_k)"""
picked = lambda spark, sf: es.selection_grid(events(spark, sf).select("event_id", "vt_symbol", "signal_date", "h1", "h3", "start_score", "score2"), ["start_score", "score2"], [1, 3])
register("es_selection_grid", lambda spark, sf: picked(spark, sf).select("event_id", "score_name", "rank", "top_k"), f"WITH {_SG} SELECT event_id, score_name, CAST(rank AS INTEGER) AS rank, top_k FROM sg")
_days = lambda spark, sf: bars(spark, sf).select(F.col("datetime").alias("signal_date")).distinct()
by_rule = lambda spark, sf: es.daily_by_rule(picked(spark, sf), _days(spark, sf), ["h1", "h3"], ["score_name", "top_k"])
_BR = _SG + """, br0 AS (SELECT score_name, top_k, 'h1' AS exit_rule, signal_date, h1 AS x FROM sg UNION ALL SELECT score_name, top_k, 'h3', signal_date, h3 FROM sg), br1 AS (SELECT score_name, top_k, exit_rule, signal_date, avg(x) AS x FROM br0 GROUP BY ALL),
  br AS (SELECT k.*, d.datetime AS signal_date, coalesce(x, 0) AS x FROM (SELECT DISTINCT score_name, top_k, exit_rule FROM br1) k CROSS JOIN (SELECT DISTINCT datetime FROM bars) d LEFT JOIN br1 ON br1.score_name = k.score_name
    AND br1.top_k = k.top_k AND br1.exit_rule = k.exit_rule AND br1.signal_date = d.datetime)"""
register("es_daily_by_rule", lambda spark, sf: tidy(by_rule(spark, sf)), f"WITH {_BR} SELECT score_name, top_k, exit_rule, signal_date, {r('x', 'daily_return')} FROM br")
register("es_grouped_summary", lambda spark, sf: tidy(es.grouped_summary(by_rule(spark, sf), ["score_name", "top_k", "exit_rule"], "daily_return")),
         f"WITH {_BR} SELECT score_name, top_k, exit_rule, count(*) AS n, {r('avg(CAST(x <> 0 AS DOUBLE))', 'trade_day_rate')}, {r('avg(x)', 'mean')}, {r('median(x)', 'median')}, {r('quantile_cont(x, 0.1)', 'p10')}, "
         f"{r('quantile_cont(x, 0.25)', 'p25')}, {r('avg(CAST(x > 0 AS DOUBLE))', 'win_rate')} FROM br GROUP BY 1, 2, 3")
panel_query("es_rolling_by_symbol", {"mean": full_mean(close, 10), "lo": full_min(low, 10), "hi": full_max(high, 10), "total": ts_sum(close, 10), "pct": full_pct_rank(close, 10)},
            {"mean": full("avg(close)", "close", 10), "lo": full("min(low)", "low", 10), "hi": full("max(high)", "high", 10), "total": full("sum(close)", "close", 10),
             "pct": "CASE WHEN len(xs) = 10 THEN (len(list_filter(xs, lambda e: e < close)) + (len(list_filter(xs, lambda e: e = close)) + 1) / 2.0) / 10 END"},
            f"lists AS (SELECT *, list(close) OVER {W(10)} AS xs FROM bars)", "lists")


# ----------------------------------------------------------------- paths, exits
def _limit_up(close, before): return F.coalesce(close >= before * 1.5, F.lit(False))
def _limit_down(close, before): return F.coalesce(close <= before * 0.5, F.lit(False))


def path_bars(spark, sf):
    return pa.indexed(bars(spark, sf), exprs={
        "ema_fast": ts_mean(close, 3), "ema_mid": ts_mean(close, 6), "rsi": ta.ta_rsi(close, 5), "atr": ts_mean(high - low, 5),
        "is_limit_up": apply(_limit_up, close, shift(close, 1)), "is_limit_down": apply(_limit_down, close, shift(close, 1))}, keep=["open", "high", "low", "close"])


def label_bars(spark, sf):
    return pa.indexed(bars(spark, sf), keep=["open", "high", "low", "close"])


def located(spark, sf, frame=path_bars):
    b = frame(spark, sf)
    ev = events(spark, sf).withColumns({"entry_price": F.when(F.col("s_suppkey") % 5 == 0, F.col("signal_close")), "stop": F.col("signal_low") * 0.8})
    return pa.locate(ev.select("event_id", "vt_symbol", "signal_date", "signal_high", "entry_price", "stop"), b), b


PATH = EV + f""", pb AS (SELECT *, avg(close) OVER {W(3)} AS ef, avg(close) OVER {W(6)} AS em, avg(high - low) OVER {W(5)} AS atr, coalesce(close >= lag(close) OVER {WS} * 1.5, false) AS lu,
  coalesce(lead(open) OVER {WS}, open) AS nxt, count(*) OVER (PARTITION BY vt_symbol) - 1 AS last_idx FROM eb),
  pe AS (SELECT e.event_id, e.vt_symbol, e.idx + 1 AS entry_idx, last_idx, e.signal_high, CASE WHEN s_suppkey % 5 = 0 THEN e.signal_close END AS given, e.signal_low * 0.8 AS stop FROM ev e JOIN pb b ON b.vt_symbol = e.vt_symbol AND b.idx = e.idx),
  pp AS MATERIALIZED (SELECT pe.*, b.idx - entry_idx AS step, open, high, low, close, ef, em, atr, lu, nxt, first_value(open) OVER (PARTITION BY event_id ORDER BY b.idx) AS eo, least(5, pe.last_idx - entry_idx) AS last5
    FROM pe JOIN pb b ON b.vt_symbol = pe.vt_symbol AND b.idx BETWEEN entry_idx AND entry_idx + 6),
  px AS (SELECT *, coalesce(given, eo) AS ep, max(high) OVER (PARTITION BY event_id ORDER BY step) AS rh, min(low) OVER (PARTITION BY event_id ORDER BY step) AS rl,
    greatest(coalesce(given, eo), max(CASE WHEN step >= 1 THEN high END) OVER (PARTITION BY event_id ORDER BY step)) AS rh1 FROM pp)"""
labels = lambda spark, sf: pa.forward_labels(*located(spark, sf, label_bars), fixed=(1, 3), horizons=(1, 3), levels=(0.05, 0.3), open_rate=0.001, close_rate=0.002)
_net = lambda p: f"({p}) * 0.998 / (eo * 1.001) - 1"
_at = lambda c, k: f"max(CASE WHEN step = {k} THEN {c} END)"
register("es_forward_labels", lambda spark, sf: tidy(labels(spark, sf).select(
    "event_id", "entry_open", "fixed_0d_net_return", "fixed_3d_net_return", "has_full_3d", "mfe_3d", "mae_3d", "tp30_hit_3d", "days_to_tp30_3d", "timeout_5d_net_return", "plan_tp30_hit", "tp30_plan_net_return_5d")),
    f"""WITH {PATH}, g AS (SELECT event_id, any_value(eo) AS eo, bool_and(entry_idx + 3 <= last_idx) AS ok, {_at('close', 0)} AS c0, {_at('close', 3)} AS c3, max(high) FILTER (step <= 3) AS h3m, min(low) FILTER (step <= 3) AS l3m,
      min(step) FILTER (step <= 3 AND high >= eo * 1.3) AS d30, arg_max(close, step) FILTER (step <= 5) AS ct, min(step) FILTER (step BETWEEN 1 AND 5 AND high >= eo * 1.3) AS p30 FROM pp GROUP BY 1)
    SELECT event_id, {r('eo', 'entry_open')}, {r(_net('c0'), 'fixed_0d_net_return')}, {r('CASE WHEN ok THEN ' + _net('c3') + ' END', 'fixed_3d_net_return')}, ok AS has_full_3d, {r('CASE WHEN ok THEN h3m / eo - 1 END', 'mfe_3d')},
    {r('CASE WHEN ok THEN l3m / eo - 1 END', 'mae_3d')}, ok AND d30 IS NOT NULL AS tp30_hit_3d, CAST(CASE WHEN ok THEN d30 END AS INTEGER) AS days_to_tp30_3d, {r(_net('ct'), 'timeout_5d_net_return')}, p30 IS NOT NULL AS plan_tp30_hit,
    {r('CASE WHEN p30 IS NOT NULL THEN ' + _net('eo * 1.3') + ' ELSE ' + _net('ct') + ' END', 'tp30_plan_net_return_5d')} FROM g""")
brk = lambda spark, sf: pa.breakout_labels(*located(spark, sf, label_bars), levels=(0.3,), horizon=3)


def _brk_sql(name, conds):
    case = " ".join(f"WHEN {c} THEN {{'s': step, 'p': {p}, 'r': '{n}'}}" for c, p, n in conds)
    return f"SELECT event_id, '{name}' AS rule, any_value(eo) AS eo, coalesce(min(CASE {case} END), max({{'s': step, 'p': close, 'r': 'timeout'}})) AS x FROM pp WHERE step <= 3 GROUP BY 1"


_win, _fade, _cut = ("high >= eo * 1.3", "eo * 1.3", "tp30"), ("close < signal_high", "close", "close_below_signal_high"), ("low <= signal_high * 0.995", "signal_high * 0.995", "low_break_signal_high")
register("es_breakout_labels", lambda spark, sf: tidy(brk(spark, sf)), f"WITH {PATH}, z AS ({_brk_sql('close_fail_tp30', [_win, _fade])} UNION ALL {_brk_sql('low_fail_stop_first_tp30', [_cut, _win])} UNION ALL {_brk_sql('low_fail_tp_first_tp30', [_win, _cut])}) "
         f"SELECT event_id, rule, x.r AS exit_reason, CAST(x.s AS INTEGER) AS exit_day, {r('x.p / eo - 1', 'net_return')} FROM z")
RULES = [pa.ExitRule("fixed_3", "fixed", 3), pa.ExitRule("tp30_stop", "target", 5, 0.3, "stop"), pa.ExitRule("limit_next", "limit_up", 5, 0.6), pa.ExitRule("protect", "protect", 5, 0.5, "stop", trigger=0.1),
         pa.ExitRule("confirm3", "confirm3", 5, 0.5, "stop", trigger=0.1)]
exits = lambda spark, sf, **kw: pa.simulate_exits(*located(spark, sf), RULES, 0.001, 0.002, **kw)
_X = PATH + """, hit AS (SELECT event_id, 'tp30_stop' AS exit_rule, coalesce(min(CASE WHEN step <= last5 AND step >= least(1, last5) AND low <= stop THEN {'s': step, 'e': step, 'p': stop, 'r': 'stop_priority'}
    WHEN step <= last5 AND step >= least(1, last5) AND high >= ep * 1.3 THEN {'s': step, 'e': step, 'p': ep * 1.3, 'r': 'target_hit'} END), min(CASE WHEN step = last5 THEN {'s': step, 'e': step, 'p': close, 'r': 'timeout'} END)) AS x FROM px WHERE last5 > 0 GROUP BY 1
  UNION ALL SELECT event_id, 'fixed_3', min(CASE WHEN step = 3 THEN {'s': step, 'e': step, 'p': close, 'r': 'fixed_3d_close'} END) FROM px GROUP BY 1
  UNION ALL SELECT event_id, 'limit_next', coalesce(min(CASE WHEN step <= last5 AND step >= 1 AND high >= ep * 1.6 THEN {'s': step, 'e': step, 'p': ep * 1.6, 'r': 'target_hit'}
    WHEN step <= last5 AND lu AND step < last_idx - entry_idx THEN {'s': step, 'e': least(step + 1, last5), 'p': CASE WHEN step + 1 <= last5 THEN nxt ELSE open END, 'r': 'limit_up_next_open'} END),
    min(CASE WHEN step = last5 THEN {'s': step, 'e': step, 'p': close, 'r': 'timeout'} END)) FROM px WHERE last5 > 0 GROUP BY 1
  UNION ALL SELECT event_id, 'protect', coalesce(min(CASE WHEN step BETWEEN 1 AND last5 AND low <= stop THEN {'s': step, 'e': step, 'p': stop, 'r': 'disaster_stop'} WHEN step BETWEEN 1 AND last5 AND high >= ep * 1.5 THEN {'s': step, 'e': step, 'p': ep * 1.5, 'r': 'target_hit'}
    WHEN step BETWEEN 1 AND last5 AND rh1 >= ep * 1.1 AND close < greatest(ep * 1.002, rh1 - atr * 2.5) THEN {'s': step, 'e': least(step + 1, last_idx - entry_idx), 'p': nxt, 'r': 'profit_protect'} END),
    min(CASE WHEN step = last5 THEN {'s': step, 'e': step, 'p': close, 'r': 'timeout'} END)) FROM px WHERE last5 > 0 GROUP BY 1),
  ex AS (SELECT h.event_id, exit_rule, x.r AS exit_reason, x.e AS e, x.p AS p, ep, rh, rl FROM hit h JOIN px ON px.event_id = h.event_id AND px.step = x.e WHERE x IS NOT NULL)"""
_CF = """, cf AS (SELECT *, coalesce(max(CASE WHEN step >= 1 AND (close > signal_high OR (close > ef AND r5 >= 50) OR close > em) THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY step), 0) = 1 AS ok FROM
  (SELECT px.*, rs.v AS r5 FROM px JOIN rsi rs ON rs.vt_symbol = px.vt_symbol AND rs.idx = px.entry_idx + px.step)),
  h3 AS (SELECT event_id, any_value(ep) AS ep, coalesce(min(CASE WHEN step BETWEEN 1 AND last5 AND low <= stop THEN {'s': step, 'e': step, 'p': stop, 'r': 'wide_stop'} WHEN step BETWEEN 1 AND last5 AND high >= ep * 1.5 THEN {'s': step, 'e': step, 'p': ep * 1.5, 'r': 'target_hit'}
    WHEN step BETWEEN 1 AND last5 AND rh1 >= ep * 1.1 AND close < greatest(ep * 1.002, rh1 - atr * 2.5) THEN {'s': step, 'e': least(step + 1, last_idx - entry_idx), 'p': nxt, 'r': 'profit_protect'}
    WHEN step BETWEEN 3 AND last5 AND NOT ok THEN {'s': step, 'e': least(step + 1, last_idx - entry_idx), 'p': nxt, 'r': 'unconfirmed_3d_exit'} END),
    min(CASE WHEN step = last5 THEN {'s': step, 'e': step, 'p': close, 'r': 'timeout'} END)) AS x FROM cf WHERE last5 > 0 GROUP BY 1)"""
_RSI5 = f""", dx AS (SELECT *, close - lag(close) OVER {WS} AS dd FROM eb), dm AS (SELECT *, avg(greatest(dd, 0)) OVER {W(5)} AS mu, avg(greatest(-dd, 0)) OVER {W(5)} AS md FROM dx),
  rw AS (SELECT vt_symbol, idx, 0e0 AS u, 0e0 AS w FROM dm WHERE idx = 0 UNION ALL SELECT s.vt_symbol, s.idx, CASE WHEN s.idx < 5 THEN 0e0 WHEN s.idx = 5 THEN s.mu ELSE (p.u * 4 + greatest(s.dd, 0)) / 5 END,
    CASE WHEN s.idx < 5 THEN 0e0 WHEN s.idx = 5 THEN s.md ELSE (p.w * 4 + greatest(-s.dd, 0)) / 5 END FROM rw p JOIN dm s ON s.vt_symbol = p.vt_symbol AND s.idx = p.idx + 1),
  rsi AS (SELECT vt_symbol, idx, CASE WHEN idx < 5 THEN CAST('nan' AS DOUBLE) WHEN u + w = 0 THEN 0 ELSE 100 * u / (u + w) END AS v FROM rw)"""
_C3 = PATH + _RSI5 + _CF
_A = _X + _RSI5 + _CF + """, al AS (SELECT * FROM ex UNION ALL SELECT h3.event_id, 'confirm3', x.r, x.e, x.p, px.ep, rh, rl FROM h3 JOIN px ON px.event_id = h3.event_id AND px.step = x.e WHERE x IS NOT NULL)"""
register("es_simulate_exits", lambda spark, sf: tidy(exits(spark, sf).select("event_id", "exit_rule", "exit_reason", "holding_bars", "gross_return", "net_return", "mfe", "mae")),
         f"WITH RECURSIVE {_A} SELECT event_id, exit_rule, exit_reason, CAST(e AS INTEGER) AS holding_bars, {r('p / ep - 1', 'gross_return')}, {r('p * 0.998 / (ep * 1.001) - 1', 'net_return')}, {r('rh / ep - 1', 'mfe')}, {r('rl / ep - 1', 'mae')} FROM al")
register("es_exit_confirm3", lambda spark, sf: tidy(exits(spark, sf).where("exit_rule = 'confirm3'").select("event_id", "exit_reason", "holding_bars", "net_return")),
         f"WITH RECURSIVE {_C3} SELECT event_id, x.r AS exit_reason, CAST(x.e AS INTEGER) AS holding_bars, {r('x.p * 0.998 / (ep * 1.001) - 1', 'net_return')} FROM h3")
register("es_exit_summary", lambda spark, sf: tidy(pa.exit_summary(exits(spark, sf))), f"WITH RECURSIVE {_A}, n AS (SELECT *, p * 0.998 / (ep * 1.001) - 1 AS nr FROM al) SELECT exit_rule, count(*) AS trades, {r('avg(nr)', 'mean_return')}, "
         f"{r('quantile_cont(nr, 0.1)', 'p10')}, {r('median(nr)', 'median_return')}, {r('avg(CAST(nr > 0 AS DOUBLE))', 'win_rate')}, {r('avg(CAST(exit_reason = $$target_hit$$ AS DOUBLE))', 'target_rate')}, {r('avg(e)', 'avg_bars')} FROM n GROUP BY 1")
register("es_reason_shares", lambda spark, sf: tidy(pa.reason_shares(exits(spark, sf))), f"WITH RECURSIVE {_A} SELECT exit_rule, exit_reason, count(*) AS n, {r('avg(p * 0.998 / (ep * 1.001) - 1)', 'mean_return')}, "
         f"{r('count(*) / sum(count(*)) OVER (PARTITION BY exit_rule)', 'share')} FROM al GROUP BY 1, 2")
register("es_zero_filled_curve", lambda spark, sf: tidy(pa.zero_filled_curve(exits(spark, sf, carry=("signal_date",)), _days(spark, sf)), 4),
         f"""WITH RECURSIVE {_A}, d AS (SELECT exit_rule, signal_date, avg(p * 0.998 / (ep * 1.001) - 1) AS x FROM al JOIN ev USING (event_id) GROUP BY 1, 2), f AS (SELECT k.exit_rule, b.datetime AS signal_date, coalesce(x, 0) AS ret
         FROM (SELECT DISTINCT exit_rule FROM al) k CROSS JOIN (SELECT DISTINCT datetime FROM bars) b LEFT JOIN d ON d.exit_rule = k.exit_rule AND d.signal_date = b.datetime)
         SELECT exit_rule, signal_date, {r('ret', 'ret', 4)}, {r('product(1 + ret) OVER (PARTITION BY exit_rule ORDER BY signal_date ROWS UNBOUNDED PRECEDING)', 'equity', 4)} FROM f""")


# ------------------------------------------------------------ buckets, segments
def opened(spark, sf):
    b = pa.indexed(bars(spark, sf), keep=["open"])
    ev = events(spark, sf)
    first = pa.event_paths(pa.locate(ev, b), b, 0).withColumnRenamed("open", "entry_open").select(*ev.columns, "entry_open")
    return es.open_confirm_fields(first.withColumn("entry_limit_up", F.col("s_suppkey") % 10 == 0))


_OC = EV + f""", oc0 AS (SELECT e.*, b.open AS eo, b.open / signal_close - 1 AS g FROM ev e JOIN eb b ON b.vt_symbol = e.vt_symbol AND b.idx = e.idx + 1),
  oc AS (SELECT *, CASE WHEN g < -0.03 THEN 'low_open_lt_-3' WHEN g < -0.01 THEN 'small_low_-3_-1' WHEN g < 0.01 THEN 'flat_-1_+1' WHEN g < 0.03 THEN 'small_high_+1_+3' WHEN g < 0.05 THEN 'high_open_+3_+5' ELSE 'chase_gt_+5' END AS gb,
    CASE WHEN open_executable AND g >= 0.03 AND g < 0.05 AND NOT eo > signal_high THEN 'high_open_watch' WHEN open_executable AND eo >= signal_low AND g >= -0.03 AND g < 0 THEN 'small_low_hold_structure'
    WHEN open_executable AND eo > signal_close AND g >= 0 AND g < 0.03 AND NOT eo > signal_high THEN 'normal_open_above_close' WHEN open_executable AND eo > signal_high AND g < 0.05 THEN 'strong_open_break_high'
    WHEN g < -0.03 OR eo < signal_low THEN 'fail_low_or_break_structure' WHEN s_suppkey % 10 = 0 OR g >= 0.05 THEN 'reject_chase_or_limit' ELSE 'other_open' END AS ob FROM oc0)"""
register("es_open_confirm", lambda spark, sf: tidy(opened(spark, sf).select("event_id", "open_vs_signal_close", "open_gap_bucket", "open_confirm_bucket", "open_confirm_pass")),
         f"WITH {_OC} SELECT event_id, {r('g', 'open_vs_signal_close')}, gb AS open_gap_bucket, ob AS open_confirm_bucket, ob IN ('strong_open_break_high', 'normal_open_above_close', 'small_low_hold_structure') AS open_confirm_pass FROM oc")
register("es_bucket_summary", lambda spark, sf: tidy(es.bucket_summary(opened(spark, sf), ["open_gap_bucket", "open_confirm_bucket"], ["open_executable"], ["h1"])),
         f"WITH {_OC}, l AS (SELECT 'open_gap_bucket' AS bucket_name, gb AS bucket_value, * FROM oc UNION ALL SELECT 'open_confirm_bucket', ob, * FROM oc) SELECT bucket_name, bucket_value, count(*) AS n, {r('avg(CAST(open_executable AS DOUBLE))', 'open_executable_rate')}, {r('avg(h1)', 'h1_mean')}, {r('median(h1)', 'h1_median')} FROM l GROUP BY 1, 2")
register("es_named_segments", lambda spark, sf: es.named_segments(events(spark, sf), {"hot": F.col("jump") > 0.5, "liquid": F.col("open_executable"), "grade_a": F.col("start_grade") == "A"}).groupBy("segment").agg(F.count("*").alias("n")),
         f"WITH {EV} SELECT 'hot' AS segment, count(*) AS n FROM ev WHERE jump > 0.5 UNION ALL SELECT 'liquid', count(*) FROM ev WHERE open_executable UNION ALL SELECT 'grade_a', count(*) FROM ev WHERE start_grade = 'A'")
register("es_daily_top_k", lambda spark, sf: tidy(es.daily_top_k_summary(events(spark, sf).where("h1 is not null"), "start_score", [3], "h1").drop("top_k")),
         f"""WITH {EV}, t AS (SELECT *, row_number() OVER (PARTITION BY signal_date ORDER BY start_score DESC NULLS LAST, vt_symbol) AS k FROM ev WHERE h1 IS NOT NULL), dr AS (SELECT signal_date, avg(h1) AS x FROM t WHERE k <= 3 GROUP BY 1),
         de AS (SELECT *, product(1 + x) OVER (ORDER BY signal_date ROWS UNBOUNDED PRECEDING) AS e FROM dr), dd AS (SELECT *, e / max(e) OVER (ORDER BY signal_date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM de) SELECT {_sum} FROM dd""")
register("es_tags_and_quality", lambda spark, sf: events(spark, sf).select("event_id", es.tags({"hot": F.col("jump") > 0.5, "liquid": F.col("open_executable")}).alias("tags"), es.day_quality(F.col("start_score"), [0.2, 0.4], ["weak", "normal", "strong"]).alias("quality")),
         f"WITH {EV} SELECT event_id, concat_ws(',', CASE WHEN jump > 0.5 THEN 'hot' END, CASE WHEN open_executable THEN 'liquid' END) AS tags, CASE WHEN start_score < 0.2 THEN 'weak' WHEN start_score < 0.4 THEN 'normal' ELSE 'strong' END AS quality FROM ev")
_flags = lambda spark, sf: Panel(bars(spark, sf)).with_columns({"before": shift(close, 1)}, keep=["open", "high", "low", "close", "volume"]).select(
    "vt_symbol", "datetime", *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in {
        "exhaust_raw": F.col("close") < F.col("before") * 0.7, "start_raw": F.col("close") > F.col("before") * 1.5, "strict": F.col("close") > F.col("before") * 1.2, "false_break_repair": F.col("close") > F.col("open") * 1.3,
        "panic_pre": F.col("volume") > 350, "near_price_break": F.col("close") > F.col("open"), "momentum_pre": F.col("volume") > 150, "rsi_repairing": F.col("volume") > 200, "false_break_low": F.col("low") < F.col("before") * 0.6,
        "strong_close": F.col("close") >= F.col("high") * 0.9, "vol_not_climax": F.col("volume") < 300, "anti_chase": F.col("close") < F.col("before") * 2}.items()])
_FL = BARS + f""", fl0 AS (SELECT *, lag(close) OVER {WS} AS b, row_number() OVER {WS} - 1 AS i FROM bars), fl AS (SELECT *, coalesce(close < b * 0.7, false) AS ex, CAST(coalesce(close > b * 1.2, false) AS INT) AS c1, CAST(close > open * 1.3 AS INT) AS c2, CAST(volume > 350 AS INT) AS c3 FROM fl0),
  fm AS (SELECT *, c1 + c2 + c3 AS cc, CAST(ex OR coalesce(max(CAST(ex AS INT)) OVER (PARTITION BY vt_symbol ORDER BY datetime ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) = 1 AS INT) AS exn FROM fl),
  wk AS (SELECT vt_symbol, i, CASE WHEN cc > 0 THEN 0 ELSE -1000000 END AS l, cc > 0 AS k FROM fm WHERE i = 0 UNION ALL SELECT s.vt_symbol, s.i, CASE WHEN s.cc > 0 AND s.i - w.l > 5 THEN s.i ELSE w.l END, s.cc > 0 AND s.i - w.l > 5 FROM wk w JOIN fm s ON s.vt_symbol = w.vt_symbol AND s.i = w.i + 1)"""
register("es_pre_start_collector", lambda spark, sf: es.pre_start_events(Panel(_flags(spark, sf))), f"""WITH RECURSIVE {_FL} SELECT m.vt_symbol, datetime, concat_ws('+', CASE WHEN c1 = 1 THEN 'strict' END, CASE WHEN c2 = 1 THEN 'false_break_repair' END, CASE WHEN c3 = 1 THEN 'panic_pre' END) AS pre_type, cc AS component_count,
  greatest(0, least(100, 20 * exn + 16 * CAST(close > open AS INT) + 14 * CAST(volume > 150 AS INT) + 12 * CAST(volume > 200 AS INT) + 10 * CAST(coalesce(low < b * 0.6, false) AS INT) + 8 * CAST(close >= high * 0.9 AS INT) + CASE WHEN volume < 300 THEN 8 ELSE -12 END
  + CASE WHEN coalesce(close < b * 2, false) THEN 6 ELSE -8 END + CASE WHEN cc >= 2 THEN 6 ELSE 0 END)) AS pre_score FROM fm m JOIN wk ON wk.vt_symbol = m.vt_symbol AND wk.i = m.i WHERE k""")
register("es_followed_by", lambda spark, sf: es.followed_by(Panel(_flags(spark, sf)), "start_raw").select("vt_symbol", "datetime", "within_1", "within_3", "within_5"),
         f"WITH {BARS}, f AS (SELECT *, CAST(coalesce(close > lag(close) OVER {WS} * 1.5, false) AS INT) AS s FROM bars) SELECT vt_symbol, datetime, " + ", ".join(
             f"coalesce(max(s) OVER (PARTITION BY vt_symbol ORDER BY datetime ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING), 0) AS within_{n}" for n in (1, 3, 5)) + " FROM f")
_earn = lambda spark, sf: bars(spark, sf).select("vt_symbol", F.col("datetime").alias("trade_date"), "open", F.trunc("datetime", "quarter").cast("timestamp_ntz").alias("ann_date"), (F.col("close") / F.col("open") - 1).alias("growth"))
register("es_earnings_drift", lambda spark, sf: tidy(es.earnings_drift(_earn(spark, sf), 5).select("vt_symbol", "trade_date", "entry_date", "entry_open", "rank")),
         f"""WITH {BARS}, a AS (SELECT *, date_trunc('quarter', datetime)::TIMESTAMP AS q FROM bars), b AS (SELECT *, lag(q) OVER {WS} AS pq, lead(datetime) OVER {WS} AS ed, lead(open) OVER {WS} AS eo FROM a),
         c AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY close / open - 1 DESC NULLS LAST, vt_symbol) AS k FROM b WHERE pq IS NOT NULL AND q <> pq AND q <= datetime AND eo IS NOT NULL)
         SELECT vt_symbol, datetime AS trade_date, ed AS entry_date, {r('eo', 'entry_open')}, CAST(k AS INTEGER) AS rank FROM c WHERE k <= 5""")
register("es_replace_day", lambda spark, sf: es.replace_day(events(spark, sf).select("event_id", "signal_date", "buy_point_type"), events(spark, sf).where("s_suppkey < 10 and year(signal_date) = 1999").select("event_id", "signal_date", "buy_point_type", F.lit("new").alias("mark"))),
         f"WITH {EV}, n AS (SELECT event_id, signal_date, buy_point_type, 'new' AS mark FROM ev WHERE s_suppkey < 10 AND year(signal_date) = 1999) SELECT event_id, signal_date, buy_point_type, NULL::VARCHAR AS mark FROM ev WHERE (signal_date, buy_point_type) NOT IN (SELECT (signal_date, buy_point_type) FROM n) UNION ALL SELECT * FROM n")
register("es_window_start", lambda spark, sf: es.window_start(_days(spark, sf), 20, "signal_date"), f"WITH {BARS} SELECT datetime AS signal_date FROM (SELECT DISTINCT datetime FROM bars) ORDER BY datetime DESC LIMIT 1 OFFSET 19")
register("es_signal_day_join", lambda spark, sf: es.signal_day_join(events(spark, sf).select("event_id", "vt_symbol", "signal_date"), bars(spark, sf).where("volume > 50").select("vt_symbol", F.col("datetime").alias("signal_date"), F.lit("1995-06-01").cast("date").alias("list_date"), (F.col("volume") > 100).alias("is_big")), {"is_big": False}, 800)
         .select("event_id", "listing_age_days", "is_new_stock", "is_big"), f"WITH {EV} SELECT event_id, CASE WHEN volume > 50 THEN CAST(CAST(signal_date AS DATE) - DATE '1995-06-01' AS INTEGER) END AS listing_age_days, coalesce(volume > 50 AND CAST(signal_date AS DATE) - DATE '1995-06-01' < 800, false) AS is_new_stock, volume > 100 AS is_big FROM ev")
register("es_quote_overlay", lambda spark, sf: tidy(es.overlay(events(spark, sf).select("event_id", "vt_symbol", "signal_close"), bars(spark, sf).where("cast(vt_symbol as long) % 2 = 0").select("vt_symbol", F.col("close").alias("signal_close"), F.col("datetime").alias("quote_time")), ["signal_close"])),
         f"WITH {EV}, q AS (SELECT vt_symbol, arg_max(close, datetime) AS c FROM bars WHERE CAST(vt_symbol AS BIGINT) % 2 = 0 GROUP BY 1) SELECT event_id, ev.vt_symbol, {r('coalesce(c, signal_close)', 'signal_close')} FROM ev LEFT JOIN q ON q.vt_symbol = ev.vt_symbol")
register("es_attach_industry", lambda spark, sf: es.attach_industry(events(spark, sf).drop("industry"), table(spark, sf, "supplier").where("s_nationkey > 5").select(F.col("s_suppkey").cast("string").alias("vt_symbol"), F.col("s_name").alias("industry"))).select("event_id", "industry"),
         f"WITH {EV} SELECT event_id, CASE WHEN s_nationkey > 5 THEN s_name ELSE 'UNKNOWN' END AS industry FROM ev JOIN supplier s ON s.s_suppkey = ev.s_suppkey")
register("es_symbol_shards", lambda spark, sf: es.symbol_shards(bars(spark, sf), 7), f"WITH {BARS} SELECT vt_symbol, CAST((row_number() OVER (ORDER BY vt_symbol) - 1) % 7 AS INTEGER) AS shard FROM (SELECT DISTINCT vt_symbol FROM bars)")
register("es_event_calendar", lambda spark, sf: es.attach_index(events(spark, sf).select("event_id", F.col("signal_date").cast("date").alias("signal_date")), es.event_calendar(events(spark, sf), ["signal_date"]), "signal_date", "signal_index"),
         f"WITH {EV}, c AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT CAST(signal_date AS DATE) AS d FROM ev)) SELECT CAST(signal_date AS DATE) AS signal_date, event_id, i AS signal_index FROM ev JOIN c ON d = CAST(signal_date AS DATE)")


# --------------------------------------------------------------- minute studies
def minutes(spark, sf):
    """Price events as five-minute bars: symbol = user modulo 20, day = month-free date."""
    e = table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("vt_symbol"), "ts", "value", "event_id")
    key = F.struct("ts", "event_id")
    return e.groupBy("vt_symbol", F.to_date("ts").alias("date"), (F.hour("ts") * 100 + F.floor(F.minute("ts") / 30) * 30).cast("int").alias("minute_hhmm")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").cast("double").alias("volume"), F.round(F.sum("value"), 2).alias("amount")).withColumn("time", F.col("minute_hhmm"))


MIN = """mi AS MATERIALIZED (SELECT CAST(user_id % 20 AS VARCHAR) AS vt_symbol, CAST(ts AS DATE) AS date, CAST(hour(ts) * 100 + (minute(ts) // 30) * 30 AS INTEGER) AS hm, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume, round(sum(value), 2) AS amount FROM events GROUP BY 1, 2, 3),
  me AS (SELECT vt_symbol || '|' || date AS event_id, vt_symbol, date AS entry_date, dop AS entry_open, dop * 1.5 AS signal_high, dop * 0.2 AS signal_low, date % 2 AS z FROM
    (SELECT vt_symbol, date, arg_min(open, hm) * 2 AS dop, extract(day FROM date) AS dd FROM mi GROUP BY 1, 2))""".replace(", date % 2 AS z", "")


def minute_events(spark, sf):
    day = minutes(spark, sf).groupBy("vt_symbol", "date").agg((F.min_by("open", "minute_hhmm") * 2).alias("entry_open"))
    return day.select(F.concat_ws("|", "vt_symbol", F.col("date").cast("string")).alias("event_id"), "vt_symbol", F.col("date").alias("entry_date"), "entry_open", (F.col("entry_open") * 1.5).alias("signal_high"), (F.col("entry_open") * 0.2).alias("signal_low"))


_MP = MIN + """, mp AS MATERIALIZED (SELECT e.*, hm, open, high, low, close, volume, amount, row_number() OVER (PARTITION BY event_id ORDER BY hm) AS bar, first_value(open) OVER (PARTITION BY event_id ORDER BY hm) AS po FROM me e JOIN mi ON mi.vt_symbol = e.vt_symbol AND mi.date = e.entry_date)"""
register("mn_minute_features", lambda spark, sf: tidy(mn.minute_features(minute_events(spark, sf), minutes(spark, sf), {"w3": 3}).select(
    "event_id", "minute_bars", "first_time", "last_time", "price_ratio", "day_return", "day_mfe", "day_mae", "tp5_hit", "tp5_time", "w3_return", "w3_range", "w3_volume_share", "w3_amount_share", "w3_break_high", "w3_hold_low")),
    f"""WITH {_MP} SELECT event_id, count(*) AS minute_bars, arg_min(hm, bar) AS first_time, arg_max(hm, bar) AS last_time, {r('any_value(po / entry_open)', 'price_ratio')}, {r('arg_max(close, bar) / any_value(po) - 1', 'day_return')}, {r('max(high) / any_value(po) - 1', 'day_mfe')},
    {r('min(low) / any_value(po) - 1', 'day_mae')}, bool_or(high >= po * 1.05) AS tp5_hit, arg_min(hm, bar) FILTER (high >= po * 1.05) AS tp5_time, {r('arg_max(close, bar) FILTER (bar <= 3) / any_value(po) - 1', 'w3_return')}, {r('max(high) FILTER (bar <= 3) / min(low) FILTER (bar <= 3) - 1', 'w3_range')},
    {r('sum(volume) FILTER (bar <= 3) / sum(volume)', 'w3_volume_share')}, {r('sum(amount) FILTER (bar <= 3) / sum(amount)', 'w3_amount_share')}, max(high) FILTER (bar <= 3) >= any_value(signal_high * (po / entry_open)) AS w3_break_high, min(low) FILTER (bar <= 3) >= any_value(signal_low * (po / entry_open)) AS w3_hold_low FROM mp GROUP BY 1""")
register("mn_buckets_quintiles", lambda spark, sf: mn.quintiles(mn.fixed_buckets(minutes(spark, sf).select("vt_symbol", "date", "minute_hhmm", "amount"), "amount", [50.0, 150.0], ["low", "mid", "high"]), "amount").groupBy("amount_bucket", "amount_q").agg(F.count("*").alias("n")),
         f"WITH {MIN}, q AS (SELECT quantile_cont(amount, [0.2, 0.4, 0.6, 0.8]) AS qs FROM mi) SELECT CASE WHEN amount <= 50 THEN 'low' WHEN amount <= 150 THEN 'mid' ELSE 'high' END AS amount_bucket, CAST(len(list_filter(qs, lambda x: x < amount)) + 1 AS INTEGER) AS amount_q, count(*) AS n FROM mi, q GROUP BY 1, 2")
_ED = _MP + """, md AS (SELECT vt_symbol, date, dense_rank() OVER (PARTITION BY vt_symbol ORDER BY date) AS dn FROM (SELECT DISTINCT vt_symbol, date FROM mi)),
  ed AS MATERIALIZED (SELECT e.*, b.dn - a.dn AS off, hm, open, high, low, close, row_number() OVER (PARTITION BY event_id ORDER BY mi.date, hm) AS bar, first_value(open) OVER (PARTITION BY event_id ORDER BY mi.date, hm) AS po FROM me e JOIN md a ON a.vt_symbol = e.vt_symbol AND a.date = e.entry_date
    JOIN md b ON b.vt_symbol = e.vt_symbol AND b.dn BETWEEN a.dn AND a.dn + 2 JOIN mi ON mi.vt_symbol = e.vt_symbol AND mi.date = b.date)"""


def entry_specs(spark):
    return spark.createDataFrame([("up2", 2, 0.0, None, -0.9, None), ("calm4", 4, None, 0.5, None, 0.1)], "rule string, confirm_bars int, min_close_return double, max_close_return double, min_mae double, min_mfe double")


_ST = lambda n: f"SELECT event_id, count(*) AS seen, arg_max(close, bar) / any_value(po) - 1 AS cr, max(high) / any_value(po) - 1 AS mfe, min(low) / any_value(po) - 1 AS mae FROM ed WHERE off = 0 AND bar <= {n} GROUP BY 1"
register("mn_delayed_entries", lambda spark, sf: tidy(mn.delayed_entries(minute_events(spark, sf), minutes(spark, sf), entry_specs(spark), 2, (0.5,), 0.001)),
         f"""WITH {_ED}, sz AS (SELECT event_id, count(*) AS n FROM ed WHERE off = 0 GROUP BY 1), a AS ({_ST(2)}), b AS ({_ST(4)}), ok AS (SELECT event_id, 'up2' AS rule, 3 AS eb FROM a JOIN sz USING (event_id) WHERE seen = 2 AND n > 2 AND cr > 0 AND mae > -0.9
         UNION ALL SELECT event_id, 'calm4', 5 FROM b JOIN sz USING (event_id) WHERE seen = 4 AND n > 4 AND cr <= 0.5 AND mfe >= 0.1), p AS (SELECT ok.rule, ok.eb, ed.*, first_value(open) OVER (PARTITION BY ok.event_id, rule ORDER BY bar) AS ep FROM ok JOIN ed ON ed.event_id = ok.event_id AND bar >= eb),
         g AS (SELECT event_id, rule, any_value(ep) AS ep, count(*) AS n, arg_max(close, bar) / any_value(ep) - 1 - 0.001 AS fr, max(high) / any_value(ep) - 1 AS mfe, min(low) / any_value(ep) - 1 AS mae, min(bar - eb) FILTER (high >= ep * 1.5) AS o FROM p GROUP BY 1, 2)
         SELECT event_id, rule, {r('ep', 'price')}, n AS path_bars, {r('fr', 'fixed_return')}, {r('mfe', 'mfe')}, {r('mae', 'mae')}, o IS NOT NULL AS tp50_hit, CAST(o AS INTEGER) AS tp50_offset, {r('CASE WHEN o IS NOT NULL THEN 0.499 ELSE fr END', 'tp50_plan_return')} FROM g""")


def fail_specs(spark):
    return spark.createDataFrame([("any2", 2, -0.2, -0.5, None, "any"), ("all3", 3, 0.1, None, 0.4, "all")], "rule string, check_bars int, max_close_return double, max_mae double, min_mfe double, mode string")


fails = lambda spark, sf: mn.fail_exits(minute_events(spark, sf), minutes(spark, sf), fail_specs(spark), 2, 0.5, 0.001)
_FE = _ED + f""", fa AS ({_ST(2)}), fb AS ({_ST(3)}), fi AS (SELECT event_id, 'any2' AS rule, seen = 2 AND (cr <= -0.2 OR mae <= -0.5) AS fired, cr FROM fa UNION ALL SELECT event_id, 'all3', seen = 3 AND cr <= 0.1 AND mfe < 0.4, cr FROM fb),
  pl AS (SELECT event_id, any_value(po) AS ep, arg_min(open, bar) FILTER (off > 0) AS no, coalesce(bool_or(high >= po * 1.5) FILTER (off > 0), false) AS hit, arg_max(close, bar) FILTER (off > 0) / any_value(po) - 1 - 0.001 AS tr FROM ed GROUP BY 1),
  fx AS (SELECT *, CASE WHEN fired THEN no / ep - 1 - 0.001 WHEN hit THEN 0.499 ELSE tr END AS pr FROM fi JOIN pl USING (event_id) WHERE no IS NOT NULL)"""
register("mn_fail_exits", lambda spark, sf: tidy(fails(spark, sf).select("event_id", "rule", "fired", "close_return", "tp_hit", "timeout_return", "policy_return")),
         f"WITH {_FE} SELECT event_id, rule, fired, {r('cr', 'close_return')}, hit AS tp_hit, {r('tr', 'timeout_return')}, {r('pr', 'policy_return')} FROM fx")
register("mn_policy_summary", lambda spark, sf: tidy(mn.policy_summary(fails(spark, sf), ["rule", "fired"], "policy_return")), f"WITH {_FE} SELECT rule, fired, count(*) AS n, {r('avg(pr)', 'mean')}, {r('median(pr)', 'median')}, {r('avg(CAST(pr > 0 AS DOUBLE))', 'win_rate')} FROM fx GROUP BY 1, 2")


def sampled(spark, sf):
    e = events(spark, sf).select("event_id", F.col("signal_date").alias("entry_date"), F.col("buy_point_type").alias("pre_l1_type"), (F.col("start_score") * 100).alias("pre_l1_score"), (F.col("s_suppkey") % 8 == 0).alias("tomorrow_l1"))
    return mn.matched_negatives(e, 2).groupBy("match_key", "sample_label").agg(F.count("*").alias("n"))


register("mn_matched_negatives", sampled, f"""WITH {EV}, k AS (SELECT strftime(signal_date, '%Y-%m-%d') || '|' || buy_point_type || '|' || CASE WHEN start_score * 100 <= 20 THEN '0_20' WHEN start_score * 100 <= 40 THEN '21_40' WHEN start_score * 100 <= 60 THEN '41_60'
  WHEN start_score * 100 <= 80 THEN '61_80' ELSE '81_100' END AS match_key, s_suppkey % 8 = 0 AS p FROM ev), c AS (SELECT match_key, count(*) FILTER (p) AS a, count(*) FILTER (NOT p) AS b FROM k GROUP BY 1)
  SELECT match_key, 'positive' AS sample_label, a AS n FROM c WHERE a > 0 UNION ALL SELECT match_key, 'negative', least(b, 2 * a) FROM c WHERE a > 0 AND b > 0""")
_cal = lambda spark, sf: iv.calendar(bars(spark, sf).select(F.col("datetime").cast("date").alias("trade_date")), "trade_date")
needed = lambda spark, sf: mn.required_dates(events(spark, sf).select("vt_symbol", F.col("signal_date").cast("date").alias("entry_date")), _cal(spark, sf), 3)
_RD = EV + """, ca AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT CAST(datetime AS DATE) AS d FROM bars)), rd AS (SELECT DISTINCT vt_symbol, b.d AS trade_date, b.i FROM ev JOIN ca a ON a.d = CAST(signal_date AS DATE) JOIN ca b ON b.i BETWEEN a.i AND a.i + 3)"""
register("mn_required_dates", needed, f"WITH {_RD} SELECT vt_symbol, trade_date FROM rd")
register("mn_fetch_ranges", lambda spark, sf: mn.fetch_ranges(needed(spark, sf), _cal(spark, sf)), f"WITH {_RD} SELECT vt_symbol, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS interval_days FROM (SELECT *, i - row_number() OVER (PARTITION BY vt_symbol ORDER BY i) AS g FROM rd) GROUP BY vt_symbol, g")



def fetched(spark, sf):
    """Overlapping fetched ranges per symbol, from quarters of the bar calendar."""
    d = bars(spark, sf).select("vt_symbol", F.col("datetime").cast("date").alias("d")).where("month(d) % 3 = 1")
    return d.select("vt_symbol", F.col("d").alias("start_date"), F.add_months("d", F.month("d") % 4 + 1).alias("end_date"), F.date_format("d", "yyyyMM").alias("cache"))


_FT = """ft AS (SELECT vt_symbol, d AS start_date, CAST(d + to_months(CAST(month(d) % 4 + 1 AS INTEGER)) AS DATE) AS end_date, strftime(d, '%Y%m') AS cache FROM (SELECT vt_symbol, CAST(datetime AS DATE) AS d FROM bars) WHERE month(d) % 3 = 1)"""
_wanted = lambda spark, sf: events(spark, sf).select("event_id", "vt_symbol", F.col("signal_date").cast("date").alias("entry_date"))
register("mn_plan_lookup", lambda spark, sf: mn.plan_lookup(_wanted(spark, sf), fetched(spark, sf)),
         f"""WITH {EV}, {_FT}, j AS (SELECT event_id, e.vt_symbol, CAST(signal_date AS DATE) AS entry_date, start_date, end_date, cache, row_number() OVER (PARTITION BY event_id ORDER BY start_date, end_date DESC) AS k
         FROM ev e LEFT JOIN ft ON ft.vt_symbol = e.vt_symbol AND CAST(signal_date AS DATE) BETWEEN start_date AND end_date) SELECT event_id, vt_symbol, entry_date, start_date, end_date, cache FROM j WHERE k = 1""")
register("mn_negative_plan", lambda spark, sf: mn.negative_fetch_plan(_wanted(spark, sf).withColumn("sample_label", F.when(F.col("vt_symbol").cast("long") % 3 > 0, "negative").otherwise("positive")), _cal(spark, sf), 3, fetched(spark, sf)),
         f"""WITH {EV}, {_FT}, ca AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT CAST(datetime AS DATE) AS d FROM bars)),
         need AS (SELECT DISTINCT vt_symbol, b.d, b.i FROM ev JOIN ca a ON a.d = CAST(signal_date AS DATE) JOIN ca b ON b.i BETWEEN a.i AND a.i + 3 WHERE CAST(vt_symbol AS BIGINT) % 3 > 0),
         open AS (SELECT * FROM need n WHERE NOT EXISTS (SELECT 1 FROM ft WHERE ft.vt_symbol = n.vt_symbol AND n.d BETWEEN start_date AND end_date))
         SELECT vt_symbol, min(d) AS start_date, max(d) AS end_date FROM (SELECT *, i - row_number() OVER (PARTITION BY vt_symbol ORDER BY i) AS g FROM open) GROUP BY vt_symbol, g""")


_ewm_step = lambda c, a, x: f"(1 - {a}) * p.{c} + {a} * {x}"
panel_query("es_path_indicators", pa.path_indicators(), {
    "ema_fast": "CASE WHEN i >= 20 THEN ef END", "ema_mid": "CASE WHEN i >= 60 THEN em END", "rsi": "CASE WHEN i >= 15 THEN 100 - 100 / (1 + u / d) END", "atr": "CASE WHEN i >= 14 THEN t END"},
    f"""pb AS (SELECT *, row_number() OVER {WS} AS i, close - lag(close) OVER {WS} AS dc, greatest(high - low, abs(high - lag(close) OVER {WS}), abs(low - lag(close) OVER {WS})) AS tr FROM bars),
    wk AS (WITH RECURSIVE w AS (SELECT vt_symbol, datetime, i, close AS ef, close AS em, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS d, tr AS t FROM pb WHERE i = 1 UNION ALL
      SELECT b.vt_symbol, b.datetime, b.i, {_ewm_step('ef', '2.0 / 21', 'b.close')}, {_ewm_step('em', '2.0 / 61', 'b.close')}, CASE WHEN b.i = 2 THEN greatest(dc, 0) ELSE {_ewm_step('u', '1.0 / 14', 'greatest(dc, 0)')} END,
      CASE WHEN b.i = 2 THEN greatest(-dc, 0) ELSE {_ewm_step('d', '1.0 / 14', 'greatest(-dc, 0)')} END, {_ewm_step('t', '1.0 / 14', 'b.tr')} FROM w p JOIN pb b ON b.vt_symbol = p.vt_symbol AND b.i = p.i + 1) SELECT * FROM w)""", "wk")


# -------------------------------------------------------------------- streaming
def ticks(spark, sf):
    """Events as ticks: price = value, cumulative counters and day extremes per user."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("vt_symbol"), F.col("ts").alias("datetime"), F.col("value").alias("last_price"))
    w = Window.partitionBy("vt_symbol").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumns({"volume": F.count("*").over(w).cast("double"), "turnover": F.round(F.sum("last_price").over(w), 2), "high_price": F.max("last_price").over(w), "low_price": F.min("last_price").over(w)})


TICKS = """tk AS (SELECT CAST(user_id AS VARCHAR) AS vt_symbol, ts AS datetime, value AS p, count(*) OVER w AS v, round(sum(value) OVER w, 2) AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
  ts AS (SELECT *, coalesce(v - lag(v) OVER w, 0) AS dv, coalesce(greatest(0, t - lag(t) OVER w), 0) AS dt FROM tk WHERE p <> 0 WINDOW w AS (PARTITION BY vt_symbol ORDER BY datetime)),
  mb AS MATERIALIZED (SELECT vt_symbol, date_trunc('minute', datetime) AS datetime, arg_min(p, datetime) AS open, max(p) AS high, min(p) AS low, arg_max(p, datetime) AS close, CAST(sum(dv) AS DOUBLE) AS volume, sum(dt) AS turnover FROM ts GROUP BY 1, 2)"""
_mb = ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume", "turnover"))
_roll = lambda key, src="mb": f"SELECT vt_symbol, {key}, arg_min(open, datetime) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) AS close, sum(volume) AS volume, sum(turnover) AS turnover FROM {src}"
register("sm_minute_bars", lambda spark, sf: tidy(sb.minute_bars(ticks(spark, sf))), f"WITH {TICKS} SELECT vt_symbol, datetime, {_mb} FROM mb")
register("sm_window_bars", lambda spark, sf: tidy(sb.window_bars(sb.minute_bars(ticks(spark, sf)), 15)), f"WITH {TICKS}, x AS ({_roll('time_bucket(INTERVAL 15 MINUTE, datetime) AS k')} GROUP BY 1, 2) SELECT vt_symbol, k AS datetime, {_mb} FROM x")
_five = lambda spark, sf: sb.window_bars(sb.minute_bars(ticks(spark, sf)), 5)
_BB = TICKS + """, cl AS (SELECT *, CAST((minute(datetime) + 1) % 5 = 0 AS INT) AS c FROM mb), nm AS (SELECT *, sum(c) OVER (PARTITION BY vt_symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING) - c AS part FROM cl)"""
register("sm_boundary_bars", lambda spark, sf: tidy(sb.boundary_bars(sb.minute_bars(ticks(spark, sf)), 5)), f"WITH {_BB}, x AS ({_roll('part, min(datetime) AS dt, max(c) AS closed', 'nm')} GROUP BY 1, 2) SELECT vt_symbol, dt AS datetime, {_mb} FROM x WHERE closed = 1")
_HB = TICKS + f", hb AS (SELECT * FROM (SELECT vt_symbol, k AS datetime, open, high, low, close, volume, turnover FROM ({_roll('date_trunc($$hour$$, datetime) AS k')} GROUP BY 1, 2)))"
hours = lambda spark, sf: sb.hour_bars(sb.minute_bars(ticks(spark, sf)))
register("sm_hour_bars", lambda spark, sf: tidy(hours(spark, sf)), f"WITH {_HB} SELECT vt_symbol, datetime, {_mb} FROM hb")
register("sm_n_hour_bars", lambda spark, sf: tidy(sb.n_hour_bars(hours(spark, sf), 4)), f"WITH {_HB}, n AS (SELECT *, (row_number() OVER {WS} - 1) // 4 AS g FROM hb), x AS ({_roll('g, min(datetime) AS dt, count(*) AS k', 'n')} GROUP BY 1, 2) SELECT vt_symbol, dt AS datetime, {_mb} FROM x WHERE k = 4")
register("sm_session_bars", lambda spark, sf: tidy(sb.session_bars(sb.minute_bars(ticks(spark, sf)), "15:00:00")), f"WITH {TICKS}, x AS ({_roll('CAST(datetime AS DATE) + CASE WHEN CAST(datetime AS TIME) > TIME $$15:00:00$$ THEN 1 ELSE 0 END AS d')} GROUP BY 1, 2) SELECT vt_symbol, d AS trade_date, {_mb} FROM x")


def orders(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id"), (F.col("event_id") % 500).alias("orderid"), F.col("ts").alias("datetime"), (F.col("event_id") % 500 % 20).cast("string").alias("vt_symbol"), F.when(F.col("event_id") % 500 % 2 == 0, "long").otherwise("short").alias("direction"),
        F.element_at(F.array(*[F.lit(x) for x in ("open", "close", "closetoday", "closeyesterday")]), (F.col("event_id") % 500 % 4 + 1).cast("int")).alias("offset"), F.lit(10.0).alias("volume"), (F.col("event_id") % 7).cast("double").alias("traded"),
        F.when(F.col("event_type") == "click", "nottraded").when(F.col("event_type") == "view", "parttraded").otherwise("alltraded").alias("status"))


ORD = """od AS (SELECT event_id, event_id % 500 AS orderid, ts AS datetime, CAST(event_id % 500 % 20 AS VARCHAR) AS vt_symbol, CASE WHEN event_id % 500 % 2 = 0 THEN 'long' ELSE 'short' END AS direction, ['open', 'close', 'closetoday', 'closeyesterday'][event_id % 500 % 4 + 1] AS offset_,
  10.0 AS volume, event_id % 7 AS traded, CASE event_type WHEN 'click' THEN 'nottraded' WHEN 'view' THEN 'parttraded' ELSE 'alltraded' END AS status FROM events), la AS (SELECT * FROM od QUALIFY row_number() OVER (PARTITION BY orderid ORDER BY datetime DESC) = 1)"""
register("sm_latest_state", lambda spark, sf: st.latest(orders(spark, sf), ["orderid"], "datetime").select("orderid", "event_id", "status"), f"WITH {ORD} SELECT orderid, event_id, status FROM la")
register("sm_active_orders", lambda spark, sf: st.active_orders(orders(spark, sf)).select("orderid", "status"), f"WITH {ORD} SELECT orderid, status FROM la WHERE status IN ('nottraded', 'parttraded')")
register("sm_enrich", lambda spark, sf: tidy(st.enrich(ticks(spark, sf).select("vt_symbol", "datetime", "last_price"), table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("vt_symbol"), F.col("c_acctbal").alias("size")))),
         f"SELECT CAST(user_id AS VARCHAR) AS vt_symbol, ts AS datetime, {r('value', 'last_price')}, {r('c_acctbal', 'size')} FROM events LEFT JOIN customer ON c_custkey = user_id")


def trades(spark, sf):
    return table(spark, sf, "events").select(
        (F.col("user_id") % 50).cast("string").alias("vt_symbol"), (F.unix_micros(F.col("ts").cast("timestamp")) * 100 + F.col("event_id") % 100).alias("datetime"), F.when(F.col("event_id") % 2 == 0, "long").otherwise("short").alias("direction"),
        F.element_at(F.array(*[F.lit(x) for x in ("open", "close", "closetoday")]), (F.col("event_id") % 3 + 1).cast("int")).alias("offset"), (F.col("event_id") % 9 + 1).cast("double").alias("volume"), (F.col("user_id") % 5 == 0).alias("old_first"))


_side = lambda n, opens: f"""CASE WHEN {opens} AND o = 'open' THEN v WHEN NOT ({opens}) AND (o = 'closetoday' OR (o = 'close' AND NOT old)) THEN -v ELSE 0 END AS {n}td,
    CASE WHEN {opens} AND o = 'open' THEN v WHEN NOT ({opens}) AND o <> 'open' THEN -v ELSE 0 END AS {n}all, NOT ({opens}) AND o = 'close' AND NOT old AS {n}c"""
_walk = lambda n: f"CASE WHEN s.{n}c THEN greatest(0, w.{n}td + s.{n}td) ELSE w.{n}td + s.{n}td END, w.{n}pos + s.{n}all"
_LG = f"""tr AS (SELECT CAST(user_id % 50 AS VARCHAR) AS vt_symbol, epoch_us(ts) * 100 + event_id % 100 AS datetime, event_id % 2 = 0 AS lng, ['open', 'close', 'closetoday'][event_id % 3 + 1] AS o, event_id % 9 + 1.0 AS v, user_id % 5 = 0 AS old FROM events),
  sq AS (SELECT *, row_number() OVER (PARTITION BY vt_symbol ORDER BY datetime) AS i FROM tr), st AS (SELECT *, {_side('l', 'lng')}, {_side('s', 'NOT lng')} FROM sq),
  wk AS (SELECT vt_symbol, datetime, i, {', '.join(f"CAST(CASE WHEN {n}c THEN greatest(0, {n}td) ELSE {n}td END AS DOUBLE) AS {n}td, CAST({n}all AS DOUBLE) AS {n}pos" for n in 'ls')} FROM st WHERE i = 1 UNION ALL
    SELECT s.vt_symbol, s.datetime, s.i, {_walk('l')}, {_walk('s')} FROM wk w JOIN st s ON s.vt_symbol = w.vt_symbol AND s.i = w.i + 1)"""
register("sm_position_ledger", lambda spark, sf: tidy(st.position_ledger(trades(spark, sf)).select("vt_symbol", "datetime", *(f"{side}_{n}" for side in ("long", "short") for n in ("td", "yd", "pos")))),
         f"WITH RECURSIVE {_LG} SELECT vt_symbol, datetime, " + ", ".join(f"{r(n + 'td', side + '_td')}, {r(n + 'pos - ' + n + 'td', side + '_yd')}, {r(n + 'pos', side + '_pos')}" for n, side in (("l", "long"), ("s", "short"))) + " FROM wk")
_pos = lambda spark, sf: orders(spark, sf).select("vt_symbol").distinct().select("vt_symbol", *[(F.col("vt_symbol").cast("int") * k % 30).cast("double").alias(n) for n, k in (("long_td", 3), ("long_yd", 5), ("short_td", 7), ("short_yd", 11))])
_FZ = ORD + """, ps AS (SELECT DISTINCT vt_symbol, CAST(vt_symbol AS INT) * 3 % 30 AS ltd, CAST(vt_symbol AS INT) * 5 % 30 AS lyd, CAST(vt_symbol AS INT) * 7 % 30 AS std, CAST(vt_symbol AS INT) * 11 % 30 AS syd FROM od),
  ac AS (SELECT vt_symbol, direction, offset_ AS o, volume - traded AS lft FROM la WHERE status IN ('nottraded', 'parttraded')),
  sm AS (SELECT p.*, """ + ", ".join(f"coalesce((SELECT sum(lft) FROM ac WHERE ac.vt_symbol = p.vt_symbol AND direction = '{d}' AND o = '{o}'), 0) AS {n}" for d, o, n in (
    ("short", "closetoday", "lt"), ("short", "closeyesterday", "ly"), ("short", "close", "lc"), ("long", "closetoday", "st"), ("long", "closeyesterday", "sy"), ("long", "close", "sc"))) + """ FROM ps p),
  sp AS (SELECT *, least(lc, greatest(0, lt + lc - ltd)) AS lx, least(sc, greatest(0, st + sc - std)) AS sx FROM sm),
  fz AS (SELECT vt_symbol, least(lt + lc - lx, ltd) AS a, least(ly + lx, lyd) AS b, least(st + sc - sx, std) AS c, least(sy + sx, syd) AS d FROM sp)"""
register("sm_frozen_volume", lambda spark, sf: tidy(st.frozen_volume(orders(spark, sf), _pos(spark, sf))),
         f"WITH {_FZ} SELECT vt_symbol, {r('a', 'long_td_frozen')}, {r('b', 'long_yd_frozen')}, {r('c', 'short_td_frozen')}, {r('d', 'short_yd_frozen')}, {r('a + b', 'long_pos_frozen')}, {r('c + d', 'short_pos_frozen')} FROM fz")

register("sm_flush_open_bars", lambda spark, sf: tidy(sb.open_bars(sb.minute_bars(ticks(spark, sf)))), f"WITH {TICKS} SELECT vt_symbol, datetime, {_mb} FROM mb QUALIFY datetime = max(datetime) OVER (PARTITION BY vt_symbol)")


def streamed(spark, sf):
    """The same ticks through the streaming plan (available-now trigger), read back."""
    from catalog.storage import scratch
    root = scratch(spark)
    source = ticks(spark, sf).withColumn("datetime", F.col("datetime").cast("timestamp"))
    source.write.parquet(f"{root}/ticks")
    stream = spark.readStream.schema(source.schema).parquet(f"{root}/ticks")
    sb.record(sb.stream_minute_bars(stream), f"{root}/bars", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/bars")


# append mode holds back the minutes the final watermark (last tick - 2 minutes) has not passed
register("sm_stream_minute_bars", lambda spark, sf: tidy(streamed(spark, sf).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))),
         f"WITH {TICKS} SELECT vt_symbol, datetime, {_mb} FROM mb WHERE datetime + INTERVAL 1 MINUTE <= (SELECT max(datetime) FROM ts) - INTERVAL 2 MINUTE")


# ----------------------------------------------------------------------- models
def learn(spark, sf):
    df = Panel(bars(spark, sf)).select(FEATURES | {"label": LABELS["h1"]})
    return df, df.where("datetime < '1999-01-01'"), df.where("datetime >= '1999-01-01' and datetime < '2000-07-01'")


NAMES = list(FEATURES)


def lasso(spark, sf):
    df, train, valid = learn(spark, sf)
    return df, ml.lasso_path(train.unionByName(valid), NAMES, [0.0005])[0.0005]


def tree_signal(spark, sf):
    df, train, valid = learn(spark, sf)
    return ml.predict(ml.fit_trees(train, valid, NAMES, rounds=8, depth=3), df, NAMES)


_OK = " AND ".join(f"isfinite({c})" for c in ("f1", "f2", "f3", "h1"))


def lasso_sql(name, where, alpha):
    """Coordinate descent as a recursion of 600 sweeps over the 3 x 3 cross-products."""
    soft = lambda x: f"(sign({x}) * greatest(abs({x}) - {alpha}, 0))"
    pairs = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a <= b]
    gram = ", ".join([f"sum(f{a} * f{b}) / count(*) AS g{a}{b}" for a, b in pairs] + [f"sum(f{a} * h1) / count(*) AS c{a}" for a in (1, 2, 3)])
    return f"""{name}g AS (SELECT {gram} FROM scored WHERE {where} AND {_OK}),
      {name}w AS (SELECT 0 AS it, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2, CAST(0 AS DOUBLE) AS w3 UNION ALL
        SELECT it + 1, w1, w2, {soft('(c3 - g13 * w1 - g23 * w2)')} / g33 FROM (SELECT it, w1, {soft('(c2 - g12 * w1 - g23 * w3)')} / g22 AS w2, c3, g13, g23, g33 FROM
          (SELECT it, {soft('(c1 - g12 * w2 - g13 * w3)')} / g11 AS w1, w3, g.* FROM {name}w, {name}g g WHERE it < 600))),
      {name} AS (SELECT w1, w2, w3 FROM {name}w WHERE it = 600)"""


_FIT = f"WITH RECURSIVE {SCORED}, {lasso_sql('m', "datetime < TIMESTAMP '2000-07-01'", 0.0005)}"
_ZERO = [f"CASE WHEN isfinite(f{i}) THEN f{i} ELSE 0 END" for i in (1, 2, 3)]
register("ml_lasso_signal", lambda spark, sf: tidy((lambda df, m: m.predict(df))(*lasso(spark, sf))),
         f"{_FIT} SELECT vt_symbol, datetime, {r(' + '.join(f'coalesce({z}, 0) * w{i}' for i, z in enumerate(_ZERO, 1)), 'signal')} FROM scored, m")
register("ml_tree_signal", lambda spark, sf: tidy(tree_signal(spark, sf)))
register("ml_importance", lambda spark, sf: tidy(lasso(spark, sf)[1].detail(spark)),
         f"{_FIT} " + " UNION ALL ".join(f"SELECT 'f{i}' AS feature, {r(f'w{i}', 'value')} FROM m WHERE w{i} <> 0" for i in (1, 2, 3)))
register("ml_grid_search", lambda spark, sf: tidy(ml.grid_search(*learn(spark, sf)[1:], NAMES, [0.0005, 0.01])),
         f"WITH RECURSIVE {SCORED}, " + ", ".join(lasso_sql(n, "datetime < TIMESTAMP '1999-01-01'", x) for n, x in (("ma", 0.0005), ("mb", 0.01))) + " " + " UNION ALL ".join(
             f"SELECT CAST({x} AS DOUBLE) AS alpha, {r('avg(pow(f1 * w1 + f2 * w2 + f3 * w3 - h1, 2))', 'mse')} FROM scored, {n} WHERE datetime >= TIMESTAMP '1999-01-01' AND datetime < TIMESTAMP '2000-07-01' AND {_OK}"
             for n, x in (("ma", 0.0005), ("mb", 0.01))))
