"""Evaluation, processors, datasets, eligibility and storage over the bar panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.expr import close, shift, volume
from barloom.functions.ts import ts_mean, ts_std
from barloom.operators import dataset as ds
from barloom.operators import eligibility as el
from barloom.operators import evaluate as ev
from barloom.operators import processors as pr
from barloom.plans.panel import Panel

from catalog.base import BARS, W, WS, avg_rank, bars, r, register, table, tidy
from catalog.factors import ENRICHED, enriched

FEATURES = {"f1": close / shift(close, 5) - 1.0, "f2": -ts_std(close, 5), "f3": volume / ts_mean(volume, 10)}
LABELS = {"h1": ev.forward_return(1), "h3": ev.forward_return(3)}
SEGMENTS = {"train": ("1995-01-01", "1998-12-31"), "valid": ("1999-01-01", "2000-06-30"), "test": ("2000-07-01", "2002-12-31"),
            "empty": ("2030-01-01", "2031-01-01")}


def scored(spark, sf):
    return Panel(bars(spark, sf)).with_columns(FEATURES | LABELS, keep=["open", "close", "volume"])


SCORED = BARS + f""", scored AS (SELECT *, close / lag(close, 5) OVER {WS} - 1 AS f1, -stddev_pop(close) OVER {W(5)} AS f2,
  volume / avg(volume) OVER {W(10)} AS f3, lead(close, 2) OVER {WS} / lead(close, 1) OVER {WS} - 1 AS h1,
  lead(close, 4) OVER {WS} / lead(close, 1) OVER {WS} - 1 AS h3 FROM bars)"""
_CORR = "covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b}))"


def obs_sql(factors, labels):
    parts = [f"SELECT datetime, vt_symbol, '{f}' AS factor_name, '{h}' AS label_name, {f} AS factor, {h} AS label FROM scored "
             f"WHERE {f} IS NOT NULL AND {h} IS NOT NULL" for f in factors for h in labels]
    cell = "datetime, factor_name, label_name"
    return f"""obs AS ({' UNION ALL '.join(parts)}), rk AS (SELECT *, {avg_rank('factor', cell)} AS fr, {avg_rank('label', cell)} AS lr,
      count(*) OVER (PARTITION BY {cell}) AS n FROM obs), daily AS (SELECT datetime, factor_name, label_name,
      {_CORR.format(a='fr', b='lr')} AS ic, avg(label) FILTER (fr / n >= 0.8) - avg(label) FILTER (fr / n <= 0.2) AS spread, max(n) AS sample_count
      FROM rk WHERE n >= 10 GROUP BY 1, 2, 3)"""


def daily(spark, sf, factors=("f1", "f2", "f3"), labels=("h1", "h3")):
    return ev.daily_scores(ev.ranked(ev.observations(scored(spark, sf), list(factors), list(labels)), 10))


register("flagship_rank_ic", lambda spark, sf: tidy(daily(spark, sf)),
         f"WITH {SCORED}, {obs_sql(('f1', 'f2', 'f3'), ('h1', 'h3'))} SELECT datetime, factor_name, label_name, {r('ic', 'ic')}, "
         f"{r('spread', 'spread')}, sample_count FROM daily")
register("ev_forward_returns", lambda spark, sf: tidy(Panel(bars(spark, sf)).select(LABELS | {"h5": ev.forward_return(5, 0)})),
         f"WITH {SCORED} SELECT vt_symbol, datetime, {r('h1', 'h1')}, {r('h3', 'h3')}, {r(f'lead(close, 5) OVER {WS} / close - 1', 'h5')} FROM scored")
_SEG = " UNION ALL ".join(f"SELECT '{n}' AS segment, TIMESTAMP '{a}' AS a, TIMESTAMP '{b}' AS b" for n, (a, b) in SEGMENTS.items())
_NAN = "CAST('nan' AS DOUBLE)"
_SUMMARY = f"""seg AS ({_SEG}), cells AS (SELECT DISTINCT factor_name, label_name, segment, a, b FROM daily, seg),
  ok AS (SELECT c.factor_name, c.label_name, c.segment, CASE WHEN NOT isnan(ic) THEN ic END AS ic, spread, sample_count, d.datetime AS dt
         FROM cells c LEFT JOIN daily d ON d.factor_name = c.factor_name AND d.label_name = c.label_name AND d.datetime BETWEEN a AND b),
  summ AS (SELECT factor_name, label_name, segment, coalesce(avg(ic), {_NAN}) AS ic, coalesce(avg(ic) / nullif(stddev_samp(ic), 0), {_NAN}) AS icir,
    count(ic) AS days, coalesce(avg(CASE WHEN ic IS NOT NULL THEN CAST(ic > 0 AS DOUBLE) END), {_NAN}) AS positive_rate,
    coalesce(avg(sample_count), {_NAN}) AS samples_mean, coalesce(avg(spread), {_NAN}) AS spread,
    coalesce(avg(spread) / nullif(stddev_samp(spread), 0), {_NAN}) AS spread_ir FROM ok GROUP BY 1, 2, 3)"""
_GRID = f"WITH {SCORED}, {obs_sql(('f1', 'f2', 'f3'), ('h1', 'h3'))}, {_SUMMARY}"
grid = lambda spark, sf: ev.score_grid(scored(spark, sf), ["f1", "f2", "f3"], ["h1", "h3"], SEGMENTS, 10)
register("ev_score_grid", lambda spark, sf: tidy(grid(spark, sf)), f"{_GRID} SELECT factor_name, label_name, segment, " + ", ".join(
    r(c, c) for c in ("ic", "icir", "positive_rate", "samples_mean", "spread", "spread_ir")) + ", days FROM summ")
register("ev_sign_flags", lambda spark, sf: tidy(ev.sign_flags(grid(spark, sf))), _GRID + f""", w AS (SELECT factor_name, label_name,
  max(ic) FILTER (segment = 'train') AS a, max(ic) FILTER (segment = 'valid') AS b, max(ic) FILTER (segment = 'test') AS c FROM summ GROUP BY 1, 2)
  SELECT factor_name, label_name, {r('a', 'train_ic')}, {r('b', 'valid_ic')}, {r('c', 'test_ic')}, sign(a) = sign(b) AND a <> 0 AS valid_consistent,
  sign(a) = sign(c) AND a <> 0 AS test_consistent, sign(a) = sign(b) AND sign(a) = sign(c) AND a <> 0 AS all_consistent FROM w""")
register("ev_report_top", lambda spark, sf: tidy(ev.report(grid(spark, sf), "test", 4).select("factor_name", "label_name", "ic", "days")),
         f"{_GRID} SELECT factor_name, label_name, {r('ic', 'ic')}, days FROM (SELECT * FROM summ WHERE segment = 'test' ORDER BY abs(ic) DESC, factor_name, label_name LIMIT 4)")
register("ev_yearly", lambda spark, sf: tidy(ev.yearly(daily(spark, sf))), f"""WITH {SCORED}, {obs_sql(('f1', 'f2', 'f3'), ('h1', 'h3'))}
  SELECT factor_name, label_name, CAST(year(datetime) AS INTEGER) AS year, {r('avg(ic)', 'ic')}, {r(f'coalesce(avg(ic) / nullif(stddev_samp(ic), 0), {_NAN})', 'icir')}, count(ic) AS days,
  {r('avg(spread)', 'spread')} FROM (SELECT * REPLACE (CASE WHEN NOT isnan(ic) THEN ic END AS ic) FROM daily) GROUP BY 1, 2, 3""")
_PCT = "pct AS (SELECT * FROM (SELECT datetime, vt_symbol, " + ", ".join(
    f"({avg_rank(f)}) / count({f}) OVER (PARTITION BY datetime) AS {f}" for f in ("f1", "f2", "f3")) + " FROM scored) WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL)"
register("ev_rank_correlation", lambda spark, sf: tidy(ev.rank_correlation(scored(spark, sf), ["f1", "f2", "f3"])),
         f"WITH {SCORED}, {_PCT} " + " UNION ALL ".join(
             f"SELECT '{a}' AS factor, '{b}' AS other, {r(_CORR.format(a=a, b=b), 'corr')} FROM pct" for a in ("f1", "f2", "f3") for b in ("f1", "f2", "f3")))
register("ev_composite", lambda spark, sf: tidy(ev.composite(scored(spark, sf), {"f1": 0.5, "f2": 0.3, "f3": -0.2})),
         f"WITH {SCORED}, {_PCT} SELECT datetime, vt_symbol, {r('f1 * 0.5 + f2 * 0.3 + f3 * -0.2', 'factor')} FROM pct")


def backtest_sql(hold, long_only):
    w = ("CASE WHEN pct >= 0.8 THEN 1.0 / nl ELSE 0 END - 1.0 / n" if long_only else
         "CASE WHEN pct >= 0.8 THEN 1.0 / nl WHEN pct <= 0.2 THEN -1.0 / ns ELSE 0 END")
    return f"""WITH {SCORED}, x AS (SELECT datetime, vt_symbol, f1, lead(close, {hold}) OVER {WS} / close - 1 AS fwd FROM scored),
      y AS (SELECT *, dense_rank() OVER (ORDER BY datetime) - 1 AS d FROM x WHERE f1 IS NOT NULL AND fwd IS NOT NULL),
      z AS (SELECT *, ({avg_rank('f1')}) / count(*) OVER (PARTITION BY datetime) AS pct FROM y WHERE d % {hold} = 0),
      c AS (SELECT *, sum(CAST(pct >= 0.8 AS INT)) OVER d1 AS nl, sum(CAST(pct <= 0.2 AS INT)) OVER d1 AS ns, count(*) OVER d1 AS n FROM z WINDOW d1 AS (PARTITION BY datetime)),
      h AS (SELECT *, {w} AS w FROM c), g AS (SELECT *, coalesce(lag(w) OVER {WS}, 0) AS b FROM h),
      book AS (SELECT datetime, sum(w * greatest(least(fwd, 0.5), -0.5)) AS gross, sum(abs(w - b)) AS turnover,
        sum(w * greatest(least(fwd, 0.5), -0.5)) - 0.0005 * sum(abs(w - b)) AS net FROM g GROUP BY 1)"""


book = lambda spark, sf, hold, lo: ev.quantile_backtest(scored(spark, sf).withColumn("factor", F.col("f1")), hold, 0.2, 0.0005, 0.5, lo)
for hold, lo in ((1, False), (3, True)):
    register(f"ev_quantile_backtest_{'long' if lo else 'spread'}", lambda spark, sf, hold=hold, lo=lo: tidy(book(spark, sf, hold, lo)),
             f"{backtest_sql(hold, lo)} SELECT datetime, {r('gross', 'gross')}, {r('turnover', 'turnover')}, {r('net', 'net')} FROM book")
register("ev_backtest_summary", lambda spark, sf: tidy(ev.backtest_summary(book(spark, sf, 1, False), 12)),
         f"{backtest_sql(1, False)} SELECT {r('avg(gross) / stddev_samp(gross) * sqrt(12)', 'gross_sharpe')}, {r('avg(net) / stddev_samp(net) * sqrt(12)', 'net_sharpe')}, "
         f"{r('product(1 + net) - 1', 'net_total')}, {r('avg(net) * 12', 'ann_net')}, {r('avg(turnover)', 'avg_turnover')} FROM book")
_QR = f"""x AS (SELECT datetime, f1, lead(close) OVER {WS} / close - 1 AS fwd FROM scored), y AS (SELECT *, ({avg_rank('f1')}) / count(*) OVER (PARTITION BY datetime) AS pct FROM x
  WHERE f1 IS NOT NULL AND fwd IS NOT NULL)"""
register("ds_quantile_performance", lambda spark, sf: tidy(ev.quantile_returns(scored(spark, sf).withColumn("factor", F.col("f1")))),
         f"WITH {SCORED}, {_QR} SELECT datetime, CAST(greatest(1, ceil(round(pct * 10, 9))) AS INTEGER) AS quantile, {r('avg(fwd)', 'mean_return')}, count(*) AS n FROM y GROUP BY 1, 2")
from barloom.operators.dataset import signal_performance  # noqa: E402
from barloom.operators import eligibility as el_guard  # noqa: E402

register("ds_signal_performance", lambda spark, sf: tidy(signal_performance(Panel(bars(spark, sf)), scored(spark, sf).where("month(datetime) <> 7").select("datetime", "vt_symbol", F.col("f1").alias("signal")), 5, 3)),
         f"""WITH {SCORED}, x AS (SELECT datetime, CASE WHEN month(datetime) <> 7 THEN f1 END AS f1, lead(close, 3) OVER {WS} / close - 1 AS fwd FROM scored), y AS (SELECT *, ({avg_rank('f1')}) / count(*) OVER (PARTITION BY datetime) AS pct FROM x
  WHERE f1 IS NOT NULL AND fwd IS NOT NULL) SELECT datetime, CAST(greatest(1, ceil(round(pct * 5, 9))) AS INTEGER) AS quantile, {r('avg(fwd)', 'mean_return')}, count(*) AS n FROM y GROUP BY 1, 2""")


def snapshot(spark, sf):
    """A live slice of the events; the guard must have refused their future columns."""
    rows = _events(spark, sf).withColumnsRenamed({"h1": "future_h1", "h3": "next_h3"})
    try:
        el_guard.assert_no_lookahead(rows.columns)
        raise AssertionError("look-ahead columns passed")
    except ValueError:
        pass
    out = el_guard.live_snapshot(rows, "1995-01-01", "1996-12-31", ["f1", "vt_symbol"])
    el_guard.assert_no_lookahead(out.columns)
    return out


register("el_live_snapshot", lambda spark, sf: tidy(snapshot(spark, sf)),
         f"WITH {SCORED} SELECT datetime AS signal_date, vt_symbol, vt_symbol || '|' || strftime(datetime, '%Y-%m-%d %H:%M:%S') AS event_id, {r('f1', 'f1')} FROM scored WHERE datetime BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
_events = lambda spark, sf: scored(spark, sf).select(F.col("datetime").alias("signal_date"), "vt_symbol", F.concat_ws("|", "vt_symbol", F.col("datetime").cast("string")).alias("event_id"), "f1", "h1", "h3")
register("ev_event_score_ic", lambda spark, sf: tidy(ev.event_score_ic(_events(spark, sf), ["f1"], ["h1", "h3"])),
         f"WITH {SCORED}, {obs_sql(('f1',), ('h1', 'h3')).replace('n >= 10', 'n >= 3')} SELECT factor_name, label_name, {r('avg(ic)', 'ic_mean')}, {r('median(ic)', 'ic_median')}, "
         f"count(*) AS days, {r('avg(CAST(ic > 0 AS DOUBLE))', 'positive_rate')} FROM daily WHERE NOT isnan(ic) GROUP BY 1, 2")
register("ev_pooled_spearman", lambda spark, sf: tidy(ev.pooled_spearman(_events(spark, sf), "f1", "h1")),
         f"WITH {SCORED}, k AS (SELECT {avg_rank('f1', '1')} AS a, {avg_rank('h1', '1')} AS b FROM scored WHERE f1 IS NOT NULL AND h1 IS NOT NULL) SELECT {r(_CORR.format(a='a', b='b'), 'spearman')}, count(*) AS n FROM k")

# ---------------------------------------------------------------- processors
_raw = lambda spark, sf: scored(spark, sf).select("datetime", "vt_symbol", "f1", "f2", "f3", F.col("h1").alias("label"))
RAW = SCORED + ", rawf AS (SELECT datetime, vt_symbol, f1, f2, f3, h1 AS label FROM scored)"


def proc(name, step, cols, ctes="", source="rawf", where="", frame=_raw):
    sel = ", ".join(r(cols.get(c, c), c) for c in ("f1", "f2", "f3", "label") if cols.get(c, c) is not None)
    register(name, lambda spark, sf: tidy(step(frame(spark, sf))), f"WITH {RAW}{', ' + ctes if ctes else ''} SELECT datetime, vt_symbol, {sel} FROM {source} {where}")


proc("pr_drop_na", pr.drop_na, {}, where="WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND f3 IS NOT NULL")
proc("pr_fill_na", lambda d: pr.fill_na(d, 0.5), {c: f"coalesce({c}, 0.5)" for c in ("f1", "f2", "f3", "label")})
_D = "(PARTITION BY datetime)"
proc("pr_cs_norm_robust", pr.cs_norm, {c: f"CASE WHEN {c}z IS NULL OR isnan({c}z) THEN {c}z ELSE greatest(-3, least(3, {c}z)) END" for c in ("f1", "f2", "f3")},
     "m AS (SELECT *, " + ", ".join(f"{c} - median({c}) OVER {_D} AS {c}g" for c in ("f1", "f2", "f3")) + " FROM rawf), z AS (SELECT *, " + ", ".join(
         f"{c}g / median(abs({c}g)) OVER {_D} / 1.4826 AS {c}z" for c in ("f1", "f2", "f3")) + " FROM m)", "z")
proc("pr_cs_norm_zscore", lambda d: pr.cs_norm(d, method="zscore"), {c: f"({c} - avg({c}) OVER {_D}) / stddev_samp({c}) OVER {_D}" for c in ("f1", "f2", "f3")})
_inf = lambda spark, sf: _raw(spark, sf).withColumn("f3", F.when(F.col("f3") > 2, F.lit(float("inf"))).otherwise(F.col("f3")))
proc("pr_replace_inf", pr.replace_inf, {"f3": "CASE WHEN f3 > 2 THEN avg(f3) FILTER (f3 <= 2) OVER (PARTITION BY vt_symbol) ELSE f3 END"}, frame=_inf)
_fit = "fit AS (SELECT " + ", ".join(f"avg({c}) AS {c}m, stddev_pop({c}) AS {c}s" for c in ("f1", "f2", "f3", "label")) + " FROM rawf WHERE datetime BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31')"
proc("pr_ts_norm", lambda d: pr.ts_norm(d, "1995-01-01", "1998-12-31"), {c: f"({c} - {c}m) / {c}s" for c in ("f1", "f2", "f3", "label")}, _fit, "rawf, fit")
proc("pr_cs_fill_na", pr.cs_fill_na, {c: f"coalesce({c}, avg({c}) OVER {_D})" for c in ("f1", "f2", "f3")})
_rob = ("sm AS (SELECT * FROM rawf WHERE datetime BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31'), md AS (SELECT " + ", ".join(f"median({c}) AS {c}m" for c in ("f1", "f2", "f3"))
        + " FROM sm), ad AS (SELECT " + ", ".join(f"median(abs({c} - {c}m)) AS {c}d" for c in ("f1", "f2", "f3")) + " FROM sm, md)")
proc("pr_robust_zscore", lambda d: pr.robust_zscore_norm(d, "1995-01-01", "1998-12-31"),
     {c: f"CASE WHEN {c} IS NOT NULL THEN greatest(-3, least(3, ({c} - {c}m) / (({c}d + 1e-12) * 1.4826))) END" for c in ("f1", "f2", "f3")}, _rob, "rawf, md, ad")
proc("pr_cs_rank_norm", lambda d: pr.cs_rank_norm(d, ["f1", "f2"]), {c: f"(({avg_rank(c)}) / count(*) OVER {_D} - 0.5) * 3.46" for c in ("f1", "f2")})
proc("pr_drop_feature", lambda d: pr.drop_feature(d, ["f2"]), {"f2": None})


# -------------------------------------------------------------------- dataset
def built(spark, sf):
    f = ds.FeatureSet(Panel(bars(spark, sf)), {"train": SEGMENTS["train"], "test": SEGMENTS["test"]})
    f.add_feature("f1", FEATURES["f1"])
    f.add_feature("f2", FEATURES["f2"])
    f.add_feature("f3", result=Panel(bars(spark, sf)).select({"data": FEATURES["f3"]}))
    f.set_label(LABELS["h1"])
    f.add_processor("infer", lambda d: pr.cs_norm(d, method="zscore"))
    f.add_processor("learn", lambda d: pr.drop_na(d, ["label"]))
    universe = table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").cast("string").alias("vt_symbol"), F.lit("1996-01-01").cast("timestamp_ntz").alias("valid_from"),
        F.lit("2001-06-30").cast("timestamp_ntz").alias("valid_to"))
    f.prepare(universe)
    f.process()
    return f


_U = "uni AS (SELECT r.* FROM rawf r JOIN supplier ON CAST(s_suppkey AS VARCHAR) = vt_symbol WHERE s_acctbal > 0 AND datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-06-30')"
register("ds_prepare_raw", lambda spark, sf: tidy(built(spark, sf).raw),
         f"WITH {RAW}, {_U} SELECT datetime, vt_symbol, " + ", ".join(r(f"coalesce({c}, {_NAN})", c) for c in ("f1", "f2", "f3", "label")) + " FROM uni")
register("ds_fetch_learn_segment", lambda spark, sf: tidy(built(spark, sf).fetch("learn", "test")), f"WITH {RAW}, {_U}, z AS (SELECT datetime, vt_symbol, label, " + ", ".join(
    f"({c} - avg({c}) OVER {_D}) / stddev_samp({c}) OVER {_D} AS {c}" for c in ("f1", "f2", "f3")) + f""" FROM uni) SELECT datetime, vt_symbol,
    {r('f1', 'f1')}, {r('f2', 'f2')}, {r('f3', 'f3')}, {r('label', 'label')} FROM z WHERE label IS NOT NULL AND datetime BETWEEN TIMESTAMP '{SEGMENTS['test'][0]}' AND TIMESTAMP '{SEGMENTS['test'][1]}'""")
register("ds_price_matrix", lambda spark, sf: tidy(ds.price_matrix(bars(spark, sf), ["1", "2", "3"]).withColumnsRenamed({"1": "s1", "2": "s2", "3": "s3"})),
         f"WITH {BARS} SELECT datetime, " + ", ".join(r(f"max(close) FILTER (vt_symbol = '{i}')", f"s{i}") for i in (1, 2, 3)) + " FROM bars WHERE vt_symbol IN ('1', '2', '3') GROUP BY 1")


# ---------------------------------------------------------------- eligibility
def el_source(spark, sf):
    static = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("vt_symbol"),
        F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("*ST"), "s_name")).otherwise(F.col("s_name")).alias("name"),
        F.expr("date_add(date'1994-10-01', cast(s_suppkey % 11 * 60 as int))").alias("list_date"),
        F.when(F.col("s_suppkey") % 13 == 0, F.lit("2000-01-01").cast("date")).alias("delist_date"))
    df = enriched(spark, sf)
    return el.join_eligibility_source(df.select("vt_symbol", "datetime", "raw_open", "raw_close", "close", "open", "volume", F.col("turnover").alias("amount")),
                                      df.select("vt_symbol", "datetime", "circ_mv"), df.select("vt_symbol", "datetime", "up_limit", "down_limit"), static)


ELIG = ENRICHED + """, els AS (SELECT e.*, turnover AS amount, CASE WHEN s_suppkey % 7 = 0 THEN '*ST' || s_name ELSE s_name END AS name,
  DATE '1994-10-01' + CAST(s_suppkey % 11 * 60 AS INTEGER) AS list_date, CASE WHEN s_suppkey % 13 = 0 THEN DATE '2000-01-01' END AS delist_date
  FROM enriched e LEFT JOIN supplier s ON CAST(s.s_suppkey AS VARCHAR) = e.vt_symbol),
  elf AS (SELECT *, coalesce(raw_close >= up_limit * 0.999, false) AS lu, coalesce(raw_close <= down_limit * 1.001, false) AS ld FROM els),
  elm AS (SELECT *, coalesce(lead(lu) OVER w, false) AS eu, coalesce(lead(ld) OVER w, false) AS ed FROM elf WINDOW w AS (PARTITION BY vt_symbol ORDER BY datetime))"""
register("el_eligibility", lambda spark, sf: el.eligibility(el_source(spark, sf), "1996-01-01", "2001-01-01", 1, 400, min_amount=5000.0, min_circ_mv=30000.0),
         f"""WITH {ELIG} SELECT datetime, vt_symbol, coalesce(datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-01-01' AND raw_close > 0 AND amount IS NOT NULL
         AND (delist_date IS NULL OR datetime <= delist_date) AND datetime >= list_date + INTERVAL 400 DAY AND NOT contains(name, 'ST') AND NOT (eu OR ed)
         AND amount >= 5000 AND circ_mv >= 30000, false) AS eligible FROM elm""")


def research(spark, sf):
    """A small research panel (trade_date keyed) on the enriched bars."""
    df = el.limit_flags(el_source(spark, sf).withColumnsRenamed({"amount": "turnover"}))
    return df.withColumns({"trade_date": F.col("datetime").cast("date"), "has_valid_bar": F.col("volume") > 20, "is_list_life_valid": F.col("delist_date").isNull()})


register("el_panel_masks", lambda spark, sf: el.panel_masks(research(spark, sf), 1, 400, 3000.0, 20000.0).select("vt_symbol", "trade_date", "signal_eligible", "benchmark_eligible"),
         f"""WITH {ELIG}, b AS (SELECT *, volume > 20 AND delist_date IS NULL AND close > 0 AND NOT contains(name, 'ST') AND amount >= 3000 AND circ_mv >= 20000 AS base FROM elm)
         SELECT vt_symbol, CAST(datetime AS DATE) AS trade_date, base AND datetime >= list_date + INTERVAL 400 DAY AND NOT (eu OR ed) AS signal_eligible, base AS benchmark_eligible FROM b""")


def executed(spark, sf):
    """Signals on f1 > 0 entered on the next bar."""
    sig = Panel(el_source(spark, sf)).with_columns({"up": close > shift(close, 1)},
                                                   keep=["raw_open", "open", "close", "up_limit", "down_limit", "amount", "list_date", "name"])
    nxt = F.lead("datetime").over(Window.partitionBy("vt_symbol").orderBy("datetime"))
    events = sig.withColumn("entry_date", nxt).where("up = 1").select("vt_symbol", F.col("datetime").alias("signal_date"), F.col("close").alias("signal_close"), "entry_date")
    entries = el.entry_panel(sig.withColumnRenamed("amount", "turnover")).drop("signal_close")
    return el.execution_status(el.execution_fields(events, entries, 200, 3000.0, (-0.3, 0.5)), (-0.3, 0.5))


_EXEC = ELIG + f""", sg AS (SELECT *, close > lag(close) OVER {WS} AS up, lead(datetime) OVER {WS} AS entry_date FROM els),
  ex AS (SELECT s.vt_symbol, s.datetime AS signal_date, s.entry_date, e.open AS entry_open, e.open / s.close - 1 AS gap,
    coalesce(e.raw_open >= e.up_limit * 0.999, false) AS olu, coalesce(e.raw_open <= e.down_limit * 1.001, false) AS old, contains(e.name, 'ST') AS sp,
    CAST(e.datetime AS DATE) - e.list_date AS age, e.amount AS t FROM sg s LEFT JOIN els e ON e.vt_symbol = s.vt_symbol AND e.datetime = s.entry_date WHERE s.up),
  ey AS (SELECT *, coalesce(entry_open IS NOT NULL AND age >= 200 AND NOT sp AND t >= 3000 AND NOT olu AND NOT old AND gap >= -0.3 AND gap < 0.5, false) AS okx FROM ex)"""
register("el_execution_status", lambda spark, sf: tidy(executed(spark, sf).select("vt_symbol", "signal_date", "entry_gap_pct", "open_executable", "execution_status")),
         f"""WITH {_EXEC} SELECT vt_symbol, signal_date, {r('gap', 'entry_gap_pct')}, okx AS open_executable, CASE WHEN entry_open IS NULL THEN 'no_quote' WHEN olu THEN 'limit_up_open'
         WHEN old THEN 'limit_down_open' WHEN sp THEN 'special_name' WHEN gap < -0.3 THEN 'gap_too_low' WHEN gap >= 0.5 THEN 'gap_too_high' WHEN okx THEN 'executable' ELSE 'filtered' END AS execution_status FROM ey""")
register("el_eligible_events", lambda spark, sf: el.eligible_events(executed(spark, sf), -0.1, 0.1).select("vt_symbol", "signal_date"),
         f"WITH {_EXEC} SELECT vt_symbol, signal_date FROM ey WHERE okx AND gap BETWEEN -0.1 AND 0.1")
