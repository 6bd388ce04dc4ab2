"""Technical indicators: window forms against SQL, recursions against recursive SQL."""

from __future__ import annotations

from barloom.functions import ta
from barloom.functions.expr import close, high, low, volume
from barloom.operators import indicators as ind
from barloom.plans.panel import Panel

from catalog.base import BARS, W, WS, bars, panel_query, r, register, tidy
from catalog.operators_basic import full

# --------------------------------------------------- recursive, as recursive SQL
_SEQ = f"seq AS (SELECT *, row_number() OVER {WS} - 1 AS i FROM bars)"


def walk(cols: str, start: str, step: str, seq: str = _SEQ, extra: str = "") -> str:
    """A recursive CTE along each symbol: ``start`` at bar 0, ``step`` from p to s."""
    return f"""WITH RECURSIVE {BARS}, {seq}{extra}, walk AS (
      SELECT s.vt_symbol, s.datetime, s.i, {start} FROM seq s WHERE i = 0
      UNION ALL SELECT s.vt_symbol, s.datetime, s.i, {step}
      FROM walk p JOIN seq s ON s.vt_symbol = p.vt_symbol AND s.i = p.i + 1) SELECT vt_symbol, datetime, {cols} FROM walk"""


def nan_until(n: int, x: str) -> str:
    return f"CASE WHEN i < {n} THEN CAST('nan' AS DOUBLE) ELSE {x} END"


def ema_step(y: str, x: str, n: int, at: int, mean: str) -> str:
    k = 2.0 / (n + 1)
    return f"CASE WHEN s.i < {at} THEN 0e0 WHEN s.i = {at} THEN s.{mean} ELSE p.{y} * (1 - {k!r}) + s.{x} * {k!r} END AS {y}"


def walk_query(name, exprs, sql, digits=6):
    register(name, lambda spark, sf: tidy(Panel(bars(spark, sf)).select(exprs), digits), sql)


walk_query("ta_ema", {"v": ta.ta_ema(close, 10)}, walk(
    r(nan_until(9, "y"), "v"), "0e0 AS y", ema_step("y", "close", 10, 9, "m"),
    f"seq AS (SELECT *, row_number() OVER {WS} - 1 AS i, avg(close) OVER {W(10)} AS m FROM bars)"))

_RSI_SEQ = f"""step AS (SELECT *, row_number() OVER {WS} - 1 AS i, close - lag(close) OVER {WS} AS d FROM bars),
 seq AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn, avg(greatest(d, 0)) OVER {W(14)} AS mu,
   avg(greatest(-d, 0)) OVER {W(14)} AS md FROM step)"""


def wilder_step(y, x, n, at, mean):
    return f"CASE WHEN s.i < {at} THEN 0e0 WHEN s.i = {at} THEN s.{mean} ELSE (p.{y} * {n - 1} + s.{x}) / {n} END AS {y}"


walk_query("ta_rsi", {"v": ta.ta_rsi(close, 14), "cmo": ta.cmo(close, 14)}, walk(
    r(nan_until(14, "CASE WHEN u + w = 0 THEN 0 ELSE 100 * u / (u + w) END"), "v") + ", " +
    r(nan_until(14, "CASE WHEN u + w = 0 THEN 0 ELSE 100 * (u - w) / (u + w) END"), "cmo"), "0e0 AS u, 0e0 AS w",
    wilder_step("u", "up", 14, 14, "mu") + ", " + wilder_step("w", "dn", 14, 14, "md"), _RSI_SEQ))

_TR = f"greatest(high - low, abs(high - lag(close) OVER {WS}), abs(low - lag(close) OVER {WS}))"
_ATR_SEQ = f"""step AS (SELECT *, row_number() OVER {WS} - 1 AS i, {_TR} AS tr FROM bars),
 seq AS (SELECT *, avg(tr) OVER {W(14)} AS m FROM step)"""
walk_query("ta_atr", {"atr": ta.ta_atr(high, low, close, 14), "natr": ta.natr(high, low, close, 14)}, walk(
    r(nan_until(14, "y"), "atr") + ", " + r(nan_until(14, "y / c * 100"), "natr"), "0e0 AS y, s.close AS c",
    wilder_step("y", "tr", 14, 14, "m") + ", s.close AS c", _ATR_SEQ))

_MACD_SEQ = f"seq AS (SELECT *, row_number() OVER {WS} - 1 AS i, avg(close) OVER {W(12)} AS mf, avg(close) OVER {W(26)} AS ms FROM bars)"
_fast, _slow = ema_step("f", "close", 12, 25, "mf"), ema_step("g", "close", 26, 25, "ms")
_dif, _dea, _hist = ta.macd(close)
walk_query("ta_macd", {"dif": _dif, "dea": _dea, "hist": _hist}, f"""WITH RECURSIVE {BARS}, {_MACD_SEQ},
  walk AS (SELECT vt_symbol, datetime, i, 0e0 AS f, 0e0 AS g FROM seq WHERE i = 0 UNION ALL
    SELECT s.vt_symbol, s.datetime, s.i, {_fast}, {_slow} FROM walk p JOIN seq s ON s.vt_symbol = p.vt_symbol AND s.i = p.i + 1),
  line AS (SELECT vt_symbol, datetime, i, CASE WHEN i < 25 THEN 0e0 ELSE f - g END AS x FROM walk),
  lm AS (SELECT *, avg(x) OVER {W(9)} AS m FROM line),
  w2 AS (SELECT vt_symbol, datetime, i, x, 0e0 AS y FROM lm WHERE i = 0 UNION ALL
    SELECT s.vt_symbol, s.datetime, s.i, s.x, {ema_step("y", "x", 9, 33, "m")} FROM w2 p JOIN lm s ON s.vt_symbol = p.vt_symbol AND s.i = p.i + 1)
  SELECT vt_symbol, datetime, {r(nan_until(33, "x"), "dif")}, {r(nan_until(33, "y"), "dea")}, {r(nan_until(33, "x - y"), "hist")} FROM w2""")

_DM_SEQ = f"""step AS (SELECT *, row_number() OVER {WS} - 1 AS i, {_TR} AS tr, high - lag(high) OVER {WS} AS u, lag(low) OVER {WS} - low AS d FROM bars),
 moves AS (SELECT *, CASE WHEN u > 0 AND u > d THEN u ELSE 0 END AS up, CASE WHEN d > 0 AND d > u THEN d ELSE 0 END AS dn FROM step),
 seq AS (SELECT *, sum(up) OVER {W(13)} AS su, sum(dn) OVER {W(13)} AS sd, sum(tr) OVER {W(13)} AS st FROM moves)"""


def dm_step(y, x, total):
    return f"CASE WHEN s.i < 13 THEN 0e0 WHEN s.i = 13 THEN s.{total} ELSE p.{y} - p.{y} / 14 + s.{x} END AS {y}"


_dm_steps = ", ".join([dm_step("a", "up", "su"), dm_step("b", "dn", "sd"), dm_step("t", "tr", "st")])
walk_query("in_directional_movement", {
    "plus_dm": ta.plus_dm(high, low), "minus_dm": ta.minus_dm(high, low),
    "plus_di": ta.plus_di(high, low, close), "minus_di": ta.minus_di(high, low, close),
}, walk(r(nan_until(13, "a"), "plus_dm") + ", " + r(nan_until(13, "b"), "minus_dm") + ", "
        + r(nan_until(14, "100 * a / t"), "plus_di") + ", " + r(nan_until(14, "100 * b / t"), "minus_di"),
        "0e0 AS a, 0e0 AS b, 0e0 AS t", _dm_steps, _DM_SEQ))

_DX = "CASE WHEN i >= 14 AND a + b <> 0 THEN 100 * abs(a - b) / (a + b) ELSE 0 END"
walk_query("in_adx_dx", {"dx": ta.dx(high, low, close), "adx": ta.adx(high, low, close), "adxr": ta.adxr(high, low, close)},
           f"""WITH RECURSIVE {BARS}, {_DM_SEQ},
  walk AS (SELECT vt_symbol, datetime, i, 0e0 AS a, 0e0 AS b, 0e0 AS t FROM seq WHERE i = 0 UNION ALL
    SELECT s.vt_symbol, s.datetime, s.i, {_dm_steps} FROM walk p JOIN seq s ON s.vt_symbol = p.vt_symbol AND s.i = p.i + 1),
  line AS (SELECT vt_symbol, datetime, i, {_DX} AS x FROM walk), lm AS (SELECT *, avg(x) OVER {W(14)} AS m FROM line),
  w2 AS (SELECT vt_symbol, datetime, i, x, 0e0 AS y FROM lm WHERE i = 0 UNION ALL
    SELECT s.vt_symbol, s.datetime, s.i, s.x, {wilder_step("y", "x", 14, 27, "m")} FROM w2 p JOIN lm s ON s.vt_symbol = p.vt_symbol AND s.i = p.i + 1),
  shown AS (SELECT *, {nan_until(27, "y")} AS v FROM w2)
  SELECT vt_symbol, datetime, {r(nan_until(14, "x"), "dx")}, {r("v", "adx")}, {r(f"(v + lag(v, 13) OVER {WS}) / 2", "adxr")} FROM shown""")

_ME = lambda n: f"avg(x) OVER {W(n)}"
walk_query("in_trix", {"v": ta.trix(close, 5)}, f"""WITH RECURSIVE {BARS},
  s1 AS (SELECT vt_symbol, datetime, close AS x, row_number() OVER {WS} - 1 AS i, avg(close) OVER {W(5)} AS m FROM bars),
  w1 AS (SELECT vt_symbol, datetime, i, 0e0 AS y FROM s1 WHERE i = 0 UNION ALL SELECT s.vt_symbol, s.datetime, s.i, {ema_step("y", "x", 5, 4, "m")} FROM w1 p JOIN s1 s ON s.vt_symbol = p.vt_symbol AND s.i = p.i + 1),
  s2 AS (SELECT vt_symbol, datetime, i, y AS x, avg(y) OVER {W(5)} AS m FROM w1),
  w2 AS (SELECT vt_symbol, datetime, i, 0e0 AS y FROM s2 WHERE i = 0 UNION ALL SELECT s.vt_symbol, s.datetime, s.i, {ema_step("y", "x", 5, 8, "m")} FROM w2 p JOIN s2 s ON s.vt_symbol = p.vt_symbol AND s.i = p.i + 1),
  s3 AS (SELECT vt_symbol, datetime, i, y AS x, avg(y) OVER {W(5)} AS m FROM w2),
  w3 AS (SELECT vt_symbol, datetime, i, 0e0 AS y FROM s3 WHERE i = 0 UNION ALL SELECT s.vt_symbol, s.datetime, s.i, {ema_step("y", "x", 5, 12, "m")} FROM w3 p JOIN s3 s ON s.vt_symbol = p.vt_symbol AND s.i = p.i + 1)
  SELECT vt_symbol, datetime, {r(f"CASE WHEN i = 0 THEN NULL WHEN i < 13 THEN CAST('nan' AS DOUBLE) ELSE (y / lag(y) OVER {WS} - 1) * 100 END", "v")} FROM w3""")

_KAMA_SEQ = f"""step AS (SELECT *, row_number() OVER {WS} - 1 AS i, close - lag(close, 10) OVER {WS} AS mv, abs(close - lag(close) OVER {WS}) AS d FROM bars),
 eff AS (SELECT *, sum(d) OVER {W(10)} AS path FROM step),
 seq AS (SELECT *, pow((CASE WHEN path <= mv OR path = 0 THEN 1 ELSE abs(mv / path) END) * (2/3.0 - 2/31.0) + 2/31.0, 2) AS sc FROM eff)"""
walk_query("in_kama", {"v": ta.kama(close, 10)}, walk(
    r(nan_until(10, "y"), "v"), "0e0 AS y",
    "CASE WHEN s.i < 9 THEN 0e0 WHEN s.i = 9 THEN s.close ELSE p.y + s.sc * (s.close - p.y) END AS y", _KAMA_SEQ))

_AD = "CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END"
_AD_SEQ = f"""flow AS (SELECT *, {_AD} AS f FROM bars),
 seq AS (SELECT *, row_number() OVER {WS} - 1 AS i, sum(f) OVER (PARTITION BY vt_symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS ad FROM flow)"""
walk_query("in_adosc", {"v": ta.adosc(high, low, close, volume, 3, 10)}, walk(
    r(nan_until(9, "f - g"), "v"), "s.ad AS f, s.ad AS g", "p.f * 0.5 + s.ad * 0.5 AS f, p.g * (9 / 11.0) + s.ad * (2 / 11.0) AS g", _AD_SEQ))

walk_query("es_ewm_span_and_wilder", {"span": ta.ewm(close, 2.0 / 11, 10), "wilder": ta.ewm(close, 1.0 / 14, 14)}, walk(
    r("CASE WHEN i >= 9 THEN y END", "span") + ", " + r("CASE WHEN i >= 13 THEN z END", "wilder"), "s.close AS y, s.close AS z",
    "p.y * (9 / 11.0) + s.close * (2 / 11.0) AS y, p.z * (13 / 14.0) + s.close / 14.0 AS z"))

# --------------------------------------------------------------- window forms
_sma = lambda n, x="close": full(f"avg({x})", x, n)
_up, _down = ind.boll(close, 20, 2.0)
_don_up, _don_down = ind.donchian(20)
panel_query("in_moving_averages", {
    "sma": ind.sma(close, 10), "wma": ind.wma(close, 4), "apo": ind.apo(close, 5, 12), "ppo": ind.ppo(close, 5, 12),
    "std": ind.std(close, 10, 2.0), "boll_up": _up, "boll_down": _down, "don_up": _don_up, "don_down": _don_down,
}, {
    "sma": _sma(10), "wma": f"(close * 4 + lag(close) OVER {WS} * 3 + lag(close, 2) OVER {WS} * 2 + lag(close, 3) OVER {WS}) / 10",
    "apo": f"({_sma(5)}) - ({_sma(12)})", "ppo": f"(({_sma(5)}) - ({_sma(12)})) / ({_sma(12)}) * 100",
    "std": f"2 * ({full('stddev_pop(close)', 'close', 10)})",
    "boll_up": f"({_sma(20)}) + 2 * ({full('stddev_pop(close)', 'close', 20)})",
    "boll_down": f"({_sma(20)}) - 2 * ({full('stddev_pop(close)', 'close', 20)})",
    "don_up": full("max(high)", "high", 20), "don_down": full("min(low)", "low", 20),
})
panel_query("in_momentum_ratios", {
    "mom": ind.mom(close, 10), "roc": ind.roc(close, 10), "rocp": ind.rocp(close, 10), "rocr": ind.rocr(close, 10),
    "rocr100": ind.rocr_100(close, 10), "bop": ind.bop(),
}, {
    "mom": "close - p", "roc": "(close / p - 1) * 100", "rocp": "(close - p) / p", "rocr": "close / p",
    "rocr100": "close / p * 100", "bop": "CASE WHEN high - low < 1e-14 THEN 0 ELSE (close - open) / (high - low) END",
}, f"d AS (SELECT *, lag(close, 10) OVER {WS} AS p FROM bars)", "d")
_RUN = "(PARTITION BY vt_symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING)"
panel_query("in_cumulative_obv_ad", {"obv": ind.obv(close, volume), "ad": ind.ad(high, low, close, volume)}, {
    "obv": f"sum(CASE WHEN d IS NULL OR d > 0 THEN volume WHEN d < 0 THEN -volume ELSE 0 END) OVER {_RUN}",
    "ad": f"sum({_AD}) OVER {_RUN}"}, f"d AS (SELECT *, close - lag(close) OVER {WS} AS d FROM bars)", "d")
panel_query("in_cci", {"v": ind.cci(n=14)}, {
    "v": "CASE WHEN len(xs) = 14 THEN CASE WHEN tp = m OR list_avg(list_transform(xs, lambda e: abs(e - m))) = 0 THEN 0 "
         "ELSE (tp - m) / (0.015 * list_avg(list_transform(xs, lambda e: abs(e - m)))) END END"},
    f"t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), d AS (SELECT *, avg(tp) OVER {W(14)} AS m, list(tp) OVER {W(14)} AS xs FROM t)", "d")
_k_up, _k_down = ind.stoch()
panel_query("in_oscillators", {"willr": ind.willr(n=14), "slowk": _k_up, "slowd": _k_down, "trange": ind.trange()}, {
    "willr": "CASE WHEN n14 = 14 THEN CASE WHEN h14 = l14 THEN 0 ELSE (h14 - close) / (h14 - l14) * -100 END END",
    "slowk": "CASE WHEN i >= 8 THEN k END", "slowd": f"CASE WHEN i >= 8 THEN avg(k) OVER {W(3)} END",
    "trange": "CASE WHEN i = 0 THEN CAST('nan' AS DOUBLE) ELSE tr END"},
    f"""d AS (SELECT *, row_number() OVER {WS} - 1 AS i, count(*) OVER {W(14)} AS n14, max(high) OVER {W(14)} AS h14, min(low) OVER {W(14)} AS l14,
    {_TR} AS tr, max(high) OVER {W(5)} AS h5, min(low) OVER {W(5)} AS l5 FROM bars),
    k0 AS (SELECT *, CASE WHEN i >= 4 THEN CASE WHEN h5 = l5 THEN 0 ELSE (close - l5) / (h5 - l5) * 100 END END AS raw FROM d),
    k1 AS (SELECT *, avg(raw) OVER {W(3)} AS k FROM k0)""", "k1")
_ar_up, _ar_down = ind.aroon(14)
_last = lambda xs, f: f"(len({xs}) - list_position(list_reverse({xs}), {f}({xs})))"
panel_query("in_aroon", {"up": _ar_up, "down": _ar_down, "osc": ind.aroonosc(14)}, {
    "up": f"CASE WHEN len(hs) = 15 THEN {_last('hs', 'list_max')} * 100.0 / 14 END",
    "down": f"CASE WHEN len(ls) = 15 THEN {_last('ls', 'list_min')} * 100.0 / 14 END",
    "osc": f"CASE WHEN len(hs) = 15 THEN ({_last('hs', 'list_max')} - {_last('ls', 'list_min')}) * 100.0 / 14 END"},
    f"d AS (SELECT *, list(high) OVER {W(15)} AS hs, list(low) OVER {W(15)} AS ls FROM bars)", "d")
panel_query("in_money_flow_ultosc", {"mfi": ind.mfi(14), "ultosc": ind.ultosc()}, {
    "mfi": f"CASE WHEN i >= 14 THEN 100 * sum(CASE WHEN tp > p THEN tp * volume ELSE 0 END) OVER {W(14)} / "
           f"(sum(CASE WHEN tp > p OR tp < p THEN tp * volume ELSE 0 END) OVER {W(14)}) END",
    "ultosc": "CASE WHEN i >= 28 THEN 100 / 7.0 * (" + " + ".join(
        f"{k} * sum(close - least(low, pc)) OVER {W(n)} / (sum(tr) OVER {W(n)})" for k, n in ((4, 7), (2, 14), (1, 28))) + ") END"},
    f"""t AS (SELECT *, row_number() OVER {WS} - 1 AS i, (high + low + close) / 3 AS tp, lag(close) OVER {WS} AS pc, {_TR} AS tr FROM bars),
    d AS (SELECT *, lag(tp) OVER {WS} AS p FROM t)""", "d")
_kel_up, _kel_down = ind.keltner(14, 2.0)
register("in_keltner", lambda spark, sf: tidy(Panel(bars(spark, sf)).select({"up": _kel_up, "down": _kel_down})),
         walk(r(f"CASE WHEN i = 13 THEN CAST('nan' AS DOUBLE) WHEN i > 13 THEN m14 + 2 * y END", "up") + ", " +
              r(f"CASE WHEN i = 13 THEN CAST('nan' AS DOUBLE) WHEN i > 13 THEN m14 - 2 * y END", "down"),
              "0e0 AS y, s.m14", wilder_step("y", "tr", 14, 14, "m") + ", s.m14",
              f"""step AS (SELECT *, row_number() OVER {WS} - 1 AS i, {_TR} AS tr, avg(close) OVER {W(14)} AS m14 FROM bars),
              seq AS (SELECT *, avg(tr) OVER {W(14)} AS m FROM step)"""))
#: The stop's state before each bar, bar by bar: side, next stop, extreme, factor and the bar before.
_SAR = f"""WITH RECURSIVE {BARS}, b AS (SELECT vt_symbol, datetime, high AS h, low AS l, row_number() OVER {WS} AS i FROM bars),
  sa AS (SELECT c.vt_symbol, c.i, up, CASE WHEN up THEN p.l ELSE p.h END AS stop, CASE WHEN up THEN c.h ELSE c.l END AS ep, CAST(0.02 AS DOUBLE) AS af, c.h AS ph, c.l AS pl
      FROM b c JOIN b p ON p.vt_symbol = c.vt_symbol AND c.i = 2 AND p.i = 1, LATERAL (SELECT NOT (p.l - c.l > 0 AND p.l - c.l > c.h - p.h) AS up)
    UNION ALL SELECT vt_symbol, i + 1, up1, CASE WHEN up1 THEN least(s1 + af1 * (ep1 - s1), pl, l) ELSE greatest(s1 + af1 * (ep1 - s1), ph, h) END, ep1, af1, h, l FROM (
      SELECT *, up <> turn AS up1, CASE WHEN NOT turn THEN stop WHEN up THEN greatest(ep, ph, h) ELSE least(ep, pl, l) END AS s1,
        CASE WHEN turn THEN 0.02 WHEN up AND h > ep OR NOT up AND l < ep THEN least(af + 0.02, 0.2) ELSE af END AS af1,
        CASE WHEN up = turn THEN CASE WHEN turn THEN l ELSE least(ep, l) END ELSE CASE WHEN turn THEN h ELSE greatest(ep, h) END END AS ep1
      FROM (SELECT sa.*, h, l, CASE WHEN up THEN l <= stop ELSE h >= stop END AS turn FROM sa JOIN b USING (vt_symbol, i))))"""
register("in_sar", lambda spark, sf: tidy(ind.sar(Panel(bars(spark, sf).select("vt_symbol", "datetime", "high", "low")))
                                          .select("vt_symbol", "datetime", "sar")),
         f"""{_SAR} SELECT vt_symbol, datetime, {r("CASE WHEN i = 1 THEN CAST('nan' AS DOUBLE) WHEN up AND l <= stop THEN greatest(ep, ph, h) WHEN NOT up AND h >= stop THEN least(ep, pl, l) ELSE stop END", 'sar')}
         FROM b LEFT JOIN sa USING (vt_symbol, i)""")
