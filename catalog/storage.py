"""Sources, sinks, text rules, joins and point-in-time preparation, against SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import symbols as sy
from barloom.operators import pit
from barloom.plans import intervals as iv
from barloom.session import durable, shared_folder
from barloom.sources import manifest as mf
from barloom.sources import tables as tb
from barloom.sources.store import PanelStore, price_range, scaled_panel

from catalog.base import BARS, WS, bars, r, register, table, tidy


def scratch(spark) -> str:
    """A new folder in the shared checkpoint area."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


OHLC = ("open", "high", "low", "close", "volume", "turnover")
_ohlc = ", ".join(r(c, c) for c in OHLC)


# ----------------------------------------------------------------------- bars
def stored(spark, sf):
    """Save all bars, then a second batch that rewrites 1998 closes."""
    store = PanelStore(spark, scratch(spark))
    df = bars(spark, sf).drop("vwap")
    store.save_bars(df, "1M")
    store.save_bars(df.where("year(datetime) = 1998").withColumn("close", F.col("close") * 2), "1M")
    return store


register("io_save_load_bars", lambda spark, sf: tidy(stored(spark, sf).load_bars("1M", "1997-06-01", "1999-06-01").select("vt_symbol", "datetime", *OHLC)),
         f"WITH {BARS} SELECT vt_symbol, datetime, {_ohlc} FROM (SELECT * REPLACE (CASE WHEN year(datetime) = 1998 THEN close * 2 ELSE close END AS close) FROM bars) "
         "WHERE datetime BETWEEN TIMESTAMP '1997-06-01' AND TIMESTAMP '1999-06-01'")
register("io_load_bar_panel", lambda spark, sf: tidy(stored(spark, sf).load_bar_panel("1M", "1999-01-01", "2000-01-01", 60).select("vt_symbol", "datetime", "open", "close", "vwap")),
         f"""WITH {BARS}, w AS (SELECT * FROM (SELECT * REPLACE (CASE WHEN year(datetime) = 1998 THEN close * 2 ELSE close END AS close) FROM bars)
         WHERE datetime BETWEEN TIMESTAMP '1999-01-01' - INTERVAL 60 DAY AND TIMESTAMP '2000-01-01' + INTERVAL 6 DAY), f AS (SELECT *, first_value(close) OVER {WS} AS f0 FROM w)
         SELECT vt_symbol, datetime, {r('open / f0', 'open')}, {r('close / f0', 'close')}, {r('vwap', 'vwap')} FROM f""")
register("io_scaled_panel_all", lambda spark, sf: tidy(scaled_panel(bars(spark, sf).drop("vwap")).select("vt_symbol", "datetime", "high", "low", "vwap")),
         f"WITH {BARS}, f AS (SELECT *, first_value(close) OVER {WS} AS f0 FROM bars) SELECT vt_symbol, datetime, {r('high / f0', 'high')}, {r('low / f0', 'low')}, {r('vwap', 'vwap')} FROM f")


def deleted(spark, sf):
    store = stored(spark, sf)
    store.delete_bars("1M", ["1", "2", "3"])
    return store.overview()


register("io_delete_and_overview", deleted, f"WITH {BARS} SELECT vt_symbol, '1M' AS interval, count(*) AS count, min(datetime) AS start, max(datetime) AS \"end\" "
         "FROM bars WHERE vt_symbol NOT IN ('1', '2', '3') GROUP BY 1")
register("io_price_range", lambda spark, sf: tidy(price_range(bars(spark, sf), "1996-01-01", "1999-12-31")),
         f"WITH {BARS} SELECT {r('min(low)', 'min_price')}, {r('max(high)', 'max_price')}, {r('max(volume)', 'max_volume')} FROM bars WHERE datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'")


# ------------------------------------------------------------------ universes
def members(spark, sf):
    """Active suppliers per month; low-volume months leave gaps."""
    return bars(spark, sf).where("volume >= 100").select(F.col("datetime").cast("date").alias("trade_date"), "vt_symbol")


MEMBERS = BARS + ", mem AS (SELECT CAST(datetime AS DATE) AS trade_date, vt_symbol FROM bars WHERE volume >= 100), cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS i FROM (SELECT DISTINCT trade_date FROM mem))"
_ISL = """, isl AS (SELECT vt_symbol, min(trade_date) AS valid_from, max(trade_date) AS valid_to, count(*) AS interval_days FROM (SELECT m.vt_symbol, m.trade_date,
  i - row_number() OVER (PARTITION BY vt_symbol ORDER BY i) AS g FROM mem m JOIN cal USING (trade_date)) GROUP BY vt_symbol, g)"""


def universe(spark, sf):
    store = PanelStore(spark, scratch(spark))
    m = members(spark, sf)
    store.save_members("idx", m)
    store.save_calendar(m)
    store.save_members("idx", m.where("trade_date = '1998-05-01' and vt_symbol < '5'"))  # replaces one date
    return store


_REP = MEMBERS.replace("WHERE volume >= 100)", "WHERE volume >= 100 AND (CAST(datetime AS DATE) <> DATE '1998-05-01' OR vt_symbol < '5'))")
register("io_members_replaced", lambda spark, sf: universe(spark, sf).members_by_date("idx", "1998-01-01", "1998-12-31"),
         f"WITH {_REP} SELECT trade_date, vt_symbol FROM mem WHERE trade_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
register("io_symbol_lists", lambda spark, sf: universe(spark, sf).symbol_lists("idx").select("trade_date", F.concat_ws(",", "symbols").alias("symbols")),
         f"WITH {_REP} SELECT trade_date, string_agg(vt_symbol, ',' ORDER BY vt_symbol) AS symbols FROM mem GROUP BY 1")
register("io_member_symbols", lambda spark, sf: universe(spark, sf).symbols("idx", "2001-06-01", "2001-09-30"),
         f"WITH {_REP} SELECT DISTINCT vt_symbol FROM mem WHERE trade_date BETWEEN DATE '2001-06-01' AND DATE '2001-09-30'")
register("io_component_intervals", lambda spark, sf: iv.islands(members(spark, sf), iv.calendar(members(spark, sf), "trade_date"), "vt_symbol", "trade_date"),
         f"WITH {MEMBERS}{_ISL} SELECT vt_symbol, valid_from, valid_to, interval_days FROM isl")


def interval_store(spark, sf):
    store = PanelStore(spark, scratch(spark))
    m = members(spark, sf)
    store.save_member_intervals("ivl", iv.islands(m, iv.calendar(m, "trade_date"), "vt_symbol", "trade_date"))
    store.save_calendar(m)
    return store


register("io_component_filters_clipped", lambda spark, sf: interval_store(spark, sf).member_intervals("ivl", "1997-03-15", "1999-03-15"),
         f"WITH {MEMBERS}{_ISL} SELECT vt_symbol, greatest(valid_from, DATE '1997-03-15') AS valid_from, least(valid_to, DATE '1999-03-15') AS valid_to FROM isl "
         "WHERE greatest(valid_from, DATE '1997-03-15') <= least(valid_to, DATE '1999-03-15')")
register("io_expand_intervals", lambda spark, sf: interval_store(spark, sf).members_by_date("ivl"), f"WITH {MEMBERS} SELECT trade_date, vt_symbol FROM mem")
register("io_member_bars", lambda spark, sf: tidy(_member_bars(spark, sf)), f"""WITH {MEMBERS}, w AS (SELECT * FROM bars WHERE datetime BETWEEN TIMESTAMP '2001-01-01' AND TIMESTAMP '2001-12-31'
  AND vt_symbol IN (SELECT vt_symbol FROM mem WHERE trade_date BETWEEN DATE '2001-01-01' AND DATE '2001-12-31')), f AS (SELECT *, first_value(close) OVER {WS} AS f0 FROM w)
  SELECT vt_symbol, datetime, {r('close / f0', 'close')} FROM f""")


def _member_bars(spark, sf):
    store = interval_store(spark, sf)
    store.save_bars(bars(spark, sf).drop("vwap"), "1M")
    return store.load_member_bars("ivl", "1M", "2001-01-01", "2001-12-31").select("vt_symbol", "datetime", "close")


# ------------------------------------------------------------ signals and text
def external(spark, sf):
    """Signals with vendor codes and eight-digit dates; several per key."""
    return table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyyMM01").alias("trade_date"), F.concat(F.lpad((F.col("l_suppkey") * 997 % 1000000).cast("string"), 6, "0"), F.lit(".SH")).alias("ts_code"),
        F.col("l_extendedprice").cast("string").alias("score"))


def imported(spark, sf):
    root = scratch(spark)
    external(spark, sf).write.csv(f"{root}/signal.csv", header=True)
    store = PanelStore(spark, root)
    store.save_signal("ext", tb.normalize_external_signal(tb.load_external_signal(spark, f"{root}/signal.csv")))
    assert store.list_signals() == ["ext"]
    return store.load_signal("ext")


register("io_import_external_signal", lambda spark, sf: tidy(imported(spark, sf)),
         f"SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS datetime, lpad(CAST(l_suppkey * 997 % 1000000 AS VARCHAR), 6, '0') || '.SSE' AS vt_symbol, {r('max(l_extendedprice)', 'signal')} FROM lineitem GROUP BY 1, 2")
_code = "lpad(CAST(s_suppkey * 7919 % 1000000 AS VARCHAR), 6, '0')"
register("st_vt_symbol_rules", lambda spark, sf: table(spark, sf, "supplier").withColumn("c", F.lpad((F.col("s_suppkey") * 7919 % 1000000).cast("string"), 6, "0")).select(
    "s_suppkey", sy.to_vt_symbol(F.col("c")).alias("bare"), sy.to_vt_symbol(F.concat(F.lit(" "), "c", F.lit(".sz "))).alias("suffixed"),
    sy.to_vt_symbol(F.col("s_suppkey")).alias("short"), sy.vendor_code(sy.to_vt_symbol(F.concat("c", F.lit(".SH")))).alias("vendor"),
    sy.split_vt_symbol(F.concat("c", F.lit(".X.SSE")))[0].alias("code"), sy.split_vt_symbol(F.concat("c", F.lit(".X.SSE")))[1].alias("exchange"),
    sy.is_special_name(F.concat(F.when(F.col("s_suppkey") % 3 == 0, F.lit("*ST ")).otherwise(F.lit("")), F.lit("n"))).alias("special"),
    sy.on_exchange(sy.to_vt_symbol(F.col("c")), "BSE").alias("on_bse"), sy.match_key(F.lit("2024-01-02").cast("date"), F.lit("L1"), F.col("s_nationkey")).alias("key")),
    f"""WITH c AS (SELECT *, {_code} AS c, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS s FROM supplier) SELECT s_suppkey,
    CASE WHEN c[1] IN ('6','5','9') THEN c || '.SSE' WHEN c[1] IN ('0','2','3') THEN c || '.SZSE' WHEN c[1] IN ('4','8') THEN c || '.BSE' ELSE c END AS bare, c || '.SZSE' AS suffixed,
    s || '.SZSE' AS short, 'sh.' || c AS vendor, c || '.X' AS code, 'SSE' AS exchange, s_suppkey % 3 = 0 AS special, c[1] IN ('4','8') AS on_bse, '2024-01-02|L1|' || s_nationkey AS key FROM c""")
register("st_symbol_string", lambda spark, sf: members(spark, sf).groupBy("trade_date").agg(F.concat_ws(",", F.sort_array(F.collect_list("vt_symbol"))).alias("symbols")),
         f"WITH {MEMBERS} SELECT trade_date, string_agg(vt_symbol, ',' ORDER BY vt_symbol) AS symbols FROM mem GROUP BY 1")
register("st_parse_time", lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", sy.parse_time(F.date_format("o_orderdate", "yyyyMMdd")).alias("eight"),
                                                                              sy.parse_time(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso"), sy.parse_time(F.lit("20241399")).alias("bad")),
         "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS eight, date_trunc('day', o_orderdate)::TIMESTAMP AS iso, CAST(NULL AS TIMESTAMP) AS bad FROM orders")


# ----------------------------------------------------------- tables and ledgers
def orders(spark, sf):
    return table(spark, sf, "orders").withColumn("trade_date", F.trunc("o_orderdate", "month"))


def replaced(spark, sf):
    old = orders(spark, sf).where("o_orderstatus <> 'P'").select("o_custkey", "trade_date", F.col("o_orderkey").cast("int").alias("k"))
    new = orders(spark, sf).where("o_orderstatus = 'P'").select("o_custkey", "trade_date", (F.col("o_totalprice") * 1).alias("k"), F.lit("p").alias("extra"))
    keys = spark.createDataFrame([("1997-03-01",), ("1998-03-01",)], "d string").select(F.to_date("d").alias("trade_date"))
    return tb.replace_rows(old, new, keys)


register("io_replace_rows_evolving_schema", lambda spark, sf: tidy(replaced(spark, sf)), f"""SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date, {r('o_orderkey', 'k')}, NULL::VARCHAR AS extra
  FROM orders WHERE o_orderstatus <> 'P' AND date_trunc('month', o_orderdate) NOT IN (DATE '1997-03-01', DATE '1998-03-01') UNION ALL
  SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE), {r('o_totalprice', 'k')}, 'p' FROM orders WHERE o_orderstatus = 'P'""")


def partitions(spark, sf):
    path = scratch(spark) + "/t"
    df = orders(spark, sf).groupBy("trade_date").agg(F.count("*").alias("n")).withColumn("year", F.year("trade_date"))
    tb.replace_partition(spark, path, df, "year")
    tb.replace_partition(spark, path, df.where("year = 1997").withColumn("n", -F.col("n")), "year")
    return spark.read.parquet(path).select("trade_date", "n", "year")


register("io_replace_partition", partitions, "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date, CASE WHEN year(any_value(o_orderdate)) = 1997 THEN -count(*) ELSE count(*) END AS n, "
         "CAST(year(any_value(o_orderdate)) AS INTEGER) AS year FROM orders GROUP BY 1")
register("io_normalize_source", lambda spark, sf: tb.normalize_source(table(spark, sf, "orders").select(
    "o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("trade_date"), F.col("o_custkey").alias("ts_code"), F.col("o_totalprice").cast("string").alias("amount"), F.col("o_orderpriority").alias("note")),
    ["trade_date"], ["ts_code"]).drop("synced_at"),
    "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_orderdate AS DATE) AS trade_date, CAST(o_custkey AS VARCHAR) AS ts_code, o_totalprice AS amount, o_orderpriority AS note FROM orders")
_ledger = lambda spark, sf: orders(spark, sf).select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"), F.col("o_orderkey").alias("synced_at"))
register("io_ledger_missing_work", lambda spark, sf: tb.missing_work(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), tb.mark_status(
    _ledger(spark, sf), _ledger(spark, sf).where("key % 10 = 0").withColumns({"synced_at": F.col("synced_at") + 1000000, "status": F.lit("ok")})), ["key"]),
    "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING arg_max(o_orderstatus, o_orderkey) = 'F' OR o_custkey % 10 = 0)")


def parts(spark, sf):
    df = orders(spark, sf).select(F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderdate").cast("string").alias("signal_date"), "o_totalprice")
    a, b = df.where("cast(event_id as long) % 3 <> 0"), df.where("cast(event_id as long) % 2 = 0").withColumn("o_totalprice", -F.col("o_totalprice"))
    return tb.merge_parts([a, b], tb.event_key(a), ["signal_date", "event_id"], "signal_date")


register("io_merge_parts", lambda spark, sf: tidy(parts(spark, sf)), f"""SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_orderdate AS DATE) AS signal_date,
  {r('CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE -o_totalprice END', 'o_totalprice')} FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""")


def panel_sink(spark, sf):
    path = scratch(spark) + "/panel"
    df = bars(spark, sf).withColumns({"trade_date": F.col("datetime").cast("date"), "member": F.col("volume") > 50})
    stats = tb.write_panel(df, path)
    kept = tb.scan_panel(spark, path, ["vt_symbol", "trade_date", "close"], "1996-01-01", "1997-12-31", "member")
    return stats.crossJoin(F.broadcast(kept.agg(F.count("*").alias("kept"), F.round(F.sum("close"), 2).alias("total"))))  # one row


register("io_panel_sink_manifest_scan", lambda spark, sf: panel_sink(spark, sf), f"""WITH {BARS} SELECT count(*) AS rows, count(DISTINCT vt_symbol) AS symbols, CAST(min(datetime) AS DATE) AS first, CAST(max(datetime) AS DATE) AS last,
  count(*) FILTER (volume > 50 AND year(datetime) IN (1996, 1997)) AS kept, round(sum(close) FILTER (volume > 50 AND year(datetime) IN (1996, 1997)), 2) AS total FROM bars""")


def minutes_csv(spark, sf):
    root = scratch(spark) + "/minutes"
    (table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.col("user_id").cast("string").alias("vt_symbol"), F.col("value").alias("open"), F.col("value").alias("close"))
     .write.csv(root, header=True))
    return tb.read_minutes(spark, root)


register("io_read_minutes", lambda spark, sf: tidy(minutes_csv(spark, sf)), f"""SELECT date_trunc('second', ts)::TIMESTAMP AS datetime, CAST(user_id AS VARCHAR) AS vt_symbol, {r('value', 'open')}, {r('value', 'close')},
  CAST(ts AS DATE) AS date, CAST(strftime(ts, '%H%M') AS INTEGER) AS minute_hhmm FROM events""")


# --------------------------------------------------------- joins, point in time
def reports(spark, sf):
    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 100).cast("string").alias("ts_code"), F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("end_date"),
        F.date_add(F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)), (F.col("o_orderkey") % 50).cast("int")).alias("ann_date"), "o_orderpriority", "o_totalprice")
    return o.groupBy("ts_code", "end_date", "ann_date").agg(F.max("o_orderpriority").alias("update_flag"), F.max("o_totalprice").alias("profit"))


def disclosures(spark, sf):
    return reports(spark, sf).groupBy("ts_code", "end_date").agg(F.date_add(F.min("ann_date"), 3).alias("actual_date")).where("month(end_date) <> 6")


REPORTS = """rp AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS ts_code, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS end_date,
  CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) + CAST(o_orderkey % 50 AS INTEGER) AS ann_date, max(o_orderpriority) AS update_flag, max(o_totalprice) AS profit FROM orders GROUP BY 1, 2, 3),
  disc AS (SELECT ts_code, end_date, min(ann_date) + 3 AS actual_date FROM rp WHERE month(end_date) <> 6 GROUP BY 1, 2),
  ev AS (SELECT * FROM (SELECT rp.*, actual_date, coalesce(actual_date, ann_date) AS pit_date FROM rp LEFT JOIN disc USING (ts_code, end_date))
    QUALIFY row_number() OVER (PARTITION BY ts_code, end_date, pit_date ORDER BY ann_date DESC NULLS LAST, update_flag DESC NULLS LAST) = 1),
  nw AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY ts_code, pit_date ORDER BY end_date DESC NULLS LAST, ann_date DESC NULLS LAST) = 1),
  pitv AS (SELECT ts_code, end_date, ann_date, profit, pit_date AS valid_from, lead(pit_date) OVER (PARTITION BY ts_code ORDER BY pit_date) - 1 AS valid_to FROM nw)"""
events_ = lambda spark, sf: pit.fundamental_events(reports(spark, sf), disclosures(spark, sf))
pitv = lambda spark, sf: pit.pit_intervals(events_(spark, sf))
register("pt_fundamental_events", lambda spark, sf: tidy(events_(spark, sf).select("ts_code", "end_date", "pit_date", "profit")), f"WITH {REPORTS} SELECT ts_code, end_date, pit_date, {r('profit', 'profit')} FROM ev")
register("pt_pit_intervals", lambda spark, sf: tidy(pitv(spark, sf).select("ts_code", "end_date", "valid_from", "valid_to", "profit")), f"WITH {REPORTS} SELECT ts_code, end_date, valid_from, valid_to, {r('profit', 'profit')} FROM pitv")
register("pt_no_overlap", lambda spark, sf: pit.overlapping(pitv(spark, sf), "ts_code").agg(F.count("*").alias("overlaps")), "SELECT CAST(0 AS BIGINT) AS overlaps")


def daily(spark, sf):
    return bars(spark, sf).select(F.col("vt_symbol").alias("ts_code"), F.col("datetime").cast("date").alias("trade_date"), "open", "high", "low", "close", "volume", F.col("turnover").alias("amount"))


DAILY = BARS + ", dl AS (SELECT vt_symbol AS ts_code, CAST(datetime AS DATE) AS trade_date, open, high, low, close, volume, turnover AS amount FROM bars)"
for how, sql_how in (("inner", "JOIN"), ("left", "LEFT JOIN")):
    register(f"jn_interval_{how}", lambda spark, sf, how=how: tidy(iv.interval_join(
        daily(spark, sf), pitv(spark, sf).select("ts_code", "profit", "valid_from", "valid_to"), "ts_code", "trade_date", "valid_from", "valid_to", how).select("ts_code", "trade_date", "profit", "valid_from")),
        f"WITH {DAILY}, {REPORTS} SELECT d.ts_code, trade_date, {r('profit', 'profit')}, valid_from FROM dl d {sql_how} pitv p ON p.ts_code = d.ts_code AND trade_date BETWEEN valid_from AND coalesce(valid_to, DATE '9999-01-01')")
register("jn_interval_semi_anti", lambda spark, sf: iv.interval_join(daily(spark, sf), _iv(spark, sf), "ts_code", "trade_date", "valid_from", "valid_to", "left_semi").select("ts_code", "trade_date", F.lit("in").alias("side")).union(
    iv.interval_join(daily(spark, sf), _iv(spark, sf), "ts_code", "trade_date", "valid_from", "valid_to", "left_anti").select("ts_code", "trade_date", F.lit("out"))),
    f"WITH {DAILY}, {REPORTS} SELECT ts_code, trade_date, CASE WHEN EXISTS (SELECT 1 FROM pitv p WHERE p.ts_code = d.ts_code AND trade_date BETWEEN valid_from AND coalesce(valid_to, DATE '9999-01-01')) THEN 'in' ELSE 'out' END AS side FROM dl d")
_iv = lambda spark, sf: pitv(spark, sf).select("ts_code", "profit", "valid_from", "valid_to")
_adj = lambda spark, sf: pit.merge_adjustment(daily(spark, sf), daily(spark, sf).select("ts_code", "trade_date", (F.year("trade_date") - 1990 + F.month("trade_date") / 12).alias("adj_factor"))).withColumn(
    "pre_close", F.lag("close").over(Window.partitionBy("ts_code").orderBy("trade_date")))
register("pt_forward_adjusted", lambda spark, sf: tidy(pit.forward_adjusted(_adj(spark, sf)).select("ts_code", "trade_date", "close_qfq", "pct_chg", "amount"), 4), f"""WITH {DAILY},
  a AS (SELECT *, year(trade_date) - 1990 + month(trade_date) / 12.0::DOUBLE AS adj, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pc FROM dl), l AS (SELECT ts_code, arg_max(adj, trade_date) AS la FROM a GROUP BY 1)
  SELECT ts_code, trade_date, {r('close * (adj / la)', 'close_qfq', 4)}, {r('(close - pc) / pc * 100', 'pct_chg', 4)}, {r('amount * 1000', 'amount', 4)} FROM a JOIN l USING (ts_code)""")
register("pt_coverage", lambda spark, sf: pit.coverage(daily(spark, sf)), f"WITH {DAILY} SELECT ts_code, count(*) AS bar_count, min(trade_date) AS first_date, max(trade_date) AS last_date, max(trade_date) = (SELECT max(trade_date) FROM dl) AS is_active FROM dl GROUP BY 1")
register("pt_threshold_universe", lambda spark, sf: pit.threshold_universe(pit.coverage(daily(spark, sf)), 83).select("ts_code", "bar_count"),
         f"WITH {DAILY} SELECT ts_code, count(*) AS bar_count FROM dl GROUP BY 1 HAVING count(*) >= 83 AND max(trade_date) = (SELECT max(trade_date) FROM dl)")
register("pt_dynamic_universe", lambda spark, sf: pit.dynamic_universe(daily(spark, sf).where("volume >= 100")), f"WITH {MEMBERS}{_ISL} SELECT vt_symbol AS ts_code, valid_from, valid_to, interval_days FROM isl")
_ind = lambda spark, sf: table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("ts_code"), F.concat(F.lit("N"), "s_nationkey").alias("industry"), F.explode(F.array(F.lit("1994-01-01").cast("date"), F.lit("1998-01-01").cast("date"))).alias("in_date")).withColumns(
    {"out_date": F.when(F.year("in_date") == 1994, F.lit("1997-12-31").cast("date")), "industry": F.when(F.year("in_date") == 1998, F.concat("industry", F.lit("b"))).otherwise(F.col("industry"))})
_last = lambda: F.lit("2002-12-31").cast("date")
register("pt_industry_intervals", lambda spark, sf: pit.industry_intervals(_ind(spark, sf), _last()), """SELECT CAST(s_suppkey AS VARCHAR) AS ts_code, 'N' || s_nationkey AS industry, DATE '1994-01-01' AS valid_from, DATE '1997-12-31' AS valid_to FROM supplier
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'N' || s_nationkey || 'b', DATE '1998-01-01', DATE '2002-12-31' FROM supplier""")
_wt = lambda spark, sf: daily(spark, sf).where("month(trade_date) in (3, 9) and volume > 80").select(F.lit("IDX").alias("index_code"), "ts_code", "trade_date", (F.col("volume") / 10).alias("weight"))
register("pt_weight_intervals", lambda spark, sf: tidy(pit.weight_intervals(_wt(spark, sf), _last())), f"""WITH {DAILY}, s AS (SELECT trade_date, coalesce(lead(trade_date) OVER (ORDER BY trade_date) - 1, DATE '2002-12-31') AS valid_to
  FROM (SELECT DISTINCT trade_date FROM dl WHERE month(trade_date) IN (3, 9) AND volume > 80)) SELECT 'IDX' AS index_code, ts_code, trade_date AS valid_from, valid_to, {r('volume / 10', 'weight')} FROM dl JOIN s USING (trade_date) WHERE volume > 80""")


def research(spark, sf):
    d = daily(spark, sf)
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    lim = d.select("ts_code", "trade_date", (F.lag("close").over(w) * 1.1).alias("up_limit"), (F.lag("close").over(w) * 0.9).alias("down_limit"))
    stock = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("ts_code"), F.lit("1996-01-01").cast("date").alias("list_date"), F.lit(None).cast("date").alias("delist_date"))
    return pit.research_panel(d, d.select("ts_code", "trade_date", (F.col("close") / 1000).alias("pb")), lim, stock, pit.coverage(d), _iv(spark, sf),
                              pit.industry_intervals(_ind(spark, sf), _last()), {"idx": pit.weight_intervals(_wt(spark, sf), _last())}, 83)


register("pt_research_panel", lambda spark, sf: tidy(research(spark, sf).select("ts_code", "trade_date", "pb", "fi_profit", "industry", "idx_weight", "is_idx", "is_limit_up", "vwap", "has_valid_bar", "is_list_life_valid", "has_enough_bars", "year")),
         f"""WITH {DAILY}, {REPORTS}, snap AS (SELECT trade_date AS vf, coalesce(lead(trade_date) OVER (ORDER BY trade_date) - 1, DATE '2002-12-31') AS vt FROM (SELECT DISTINCT trade_date FROM dl WHERE month(trade_date) IN (3, 9) AND volume > 80)),
  wi AS (SELECT ts_code, volume / 10 AS w, vf, vt FROM dl JOIN snap ON trade_date = vf WHERE volume > 80), b AS (SELECT *, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pc, count(*) OVER (PARTITION BY ts_code) AS n FROM dl)
  SELECT b.ts_code, b.trade_date, {r('close / 1000', 'pb')}, {r('profit', 'fi_profit')}, CASE WHEN b.trade_date < DATE '1998-01-01' THEN 'N' || s_nationkey ELSE 'N' || s_nationkey || 'b' END AS industry, {r('w', 'idx_weight')},
  w IS NOT NULL AS is_idx, coalesce(close >= pc * 1.1 * 0.999, false) AS is_limit_up, {r('amount / volume', 'vwap')}, close > 0 AND volume > 0 AS has_valid_bar, b.trade_date >= DATE '1996-01-01' AS is_list_life_valid, n >= 83 AS has_enough_bars, CAST(year(b.trade_date) AS INTEGER) AS year
  FROM b JOIN supplier ON CAST(s_suppkey AS VARCHAR) = b.ts_code LEFT JOIN pitv p ON p.ts_code = b.ts_code AND b.trade_date BETWEEN p.valid_from AND coalesce(p.valid_to, DATE '9999-01-01')
  LEFT JOIN wi ON wi.ts_code = b.ts_code AND b.trade_date BETWEEN vf AND vt""")
register("pt_report_periods", lambda spark, sf: pit.report_periods(spark, "1995-02-10", "2001-11-30").join(reports(spark, sf).groupBy("end_date").agg(F.count("*").alias("n")), "end_date"),
         f"WITH {REPORTS} SELECT end_date, count(*) AS n FROM rp WHERE end_date BETWEEN DATE '1995-02-10' AND DATE '2001-11-30' GROUP BY 1")
register("pt_open_days_bounds", lambda spark, sf: pit.date_bounds(daily(spark, sf), "1996-01-01").join(pit.open_days(iv.calendar(daily(spark, sf), "trade_date").select(
    F.col("trade_date").alias("cal_date"), (F.col("day_index") % 2).alias("is_open")), "1996-01-01", "2001-12-31").agg(F.count("*").alias("open_days"))),
    f"WITH {DAILY}, c AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT DISTINCT trade_date FROM dl)) SELECT DATE '1996-01-01' AS start, (SELECT max(trade_date) FROM dl) AS \"end\", "
    "count(*) AS open_days FROM c WHERE i % 2 = 1 AND trade_date BETWEEN DATE '1996-01-01' AND DATE '2001-12-31'")


# ------------------------------------------------- several tables in one commit
def _market(spark, sf):
    """Three market tables by trade date, from orders."""
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_custkey").cast("string").alias("vt_symbol"), "o_orderkey", "o_totalprice")
    o = o.withColumn("trade_date", F.trunc("trade_date", "year"))
    return {"daily": o.select("trade_date", "vt_symbol", "o_orderkey", F.col("o_totalprice").alias("close")), "valuation": o.select("trade_date", "vt_symbol", "o_orderkey", (F.col("o_totalprice") / 1000).alias("pb")),
            "limits": o.select("trade_date", "vt_symbol", "o_orderkey", (F.col("o_totalprice") * 2).alias("up_limit"))}


def replaced_dates(spark, sf):
    """Every date loaded, one replaced in all three tables, a second replacement that never commits."""
    store = mf.TableSet(spark, f"{scratch(spark)}/market")
    frames = {n: durable(df) for n, df in _market(spark, sf).items()}
    dates = [str(r[0]) for r in frames["daily"].select("trade_date").distinct().orderBy("trade_date").collect()]  # seven years
    on = lambda df, d: df.where(F.col("trade_date") == F.lit(d).cast("date"))
    store.replace({n: {d: on(df, d) for d in dates} for n, df in frames.items()})
    mf.replace_date(store, "1996-01-01", {n: on(df, "1996-01-01").where("o_orderkey % 2 = 0") for n, df in frames.items()})
    try:
        mf.replace_date(store, "1997-01-01", {"daily": on(frames["daily"], "1997-01-01").limit(0), "valuation": frames["valuation"]})
    except ValueError:
        pass
    d, v, u = (store.read(n) for n in ("daily", "valuation", "limits"))
    return d.join(v.drop("trade_date", "vt_symbol"), "o_orderkey").join(u.drop("trade_date", "vt_symbol"), "o_orderkey").groupBy("trade_date").agg(
        F.count("*").alias("n"), F.round(F.max("close"), 2).alias("close"), F.round(F.max("pb"), 6).alias("pb"), F.round(F.max("up_limit"), 2).alias("up_limit"))


register("io_replace_date_tables", replaced_dates,
         "SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS trade_date, count(*) AS n, round(max(o_totalprice), 2) AS close, round(max(o_totalprice / 1000), 6) AS pb, round(max(o_totalprice * 2), 2) AS up_limit "
         "FROM orders WHERE year(o_orderdate) <> 1996 OR o_orderkey % 2 = 0 GROUP BY 1")


def exported(spark, sf):
    store = mf.TableSet(spark, f"{scratch(spark)}/research")
    points = bars(spark, sf).select(F.to_date("datetime").alias("trade_date"), "vt_symbol", "volume")
    mf.export_research(store, bars(spark, sf), {"large": points.where("volume >= 150"), "small": points.where("volume < 60"), "all": points})
    spans = store.read("universes").groupBy("vt_symbol", "universe").agg(F.count("*").alias("spans"), F.sum("interval_days").alias("days"))
    wide = spans.groupBy("vt_symbol").pivot("universe", ["large", "small", "all"]).agg(F.first("spans").alias("spans"), F.first("days").alias("days"))
    return store.read("coverage").join(store.read("contracts"), "vt_symbol").join(wide, "vt_symbol").join(store.read("bars").groupBy("vt_symbol").agg(F.count("*").alias("stored")), "vt_symbol").select(
        "vt_symbol", "bar_count", "stored", "first_date", "last_date", F.round("coverage", 6).alias("coverage"), "pricetick", *[F.coalesce(f"{u}_{c}", F.lit(0)).alias(f"{u}_{c}") for u in ("large", "small", "all") for c in ("spans", "days")])


register("io_research_export", exported, f"""WITH {BARS}, ca AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT CAST(datetime AS DATE) AS d FROM bars)),
  p AS (SELECT vt_symbol, i, volume FROM bars JOIN ca ON d = CAST(datetime AS DATE)),
  u AS (SELECT vt_symbol, i, 'large' AS u FROM p WHERE volume >= 150 UNION ALL SELECT vt_symbol, i, 'small' FROM p WHERE volume < 60 UNION ALL SELECT vt_symbol, i, 'all' FROM p),
  g AS (SELECT vt_symbol, u, i - row_number() OVER (PARTITION BY vt_symbol, u ORDER BY i) AS g FROM u), c AS (SELECT vt_symbol, u, count(DISTINCT g) AS spans, count(*) AS days FROM g GROUP BY 1, 2)
  SELECT vt_symbol, any_value(n) AS bar_count, any_value(n) AS stored, any_value(f) AS first_date, any_value(l) AS last_date, round(any_value(n) * 1.0 / (any_value(j) - any_value(k) + 1), 6) AS coverage, CAST(0.01 AS DOUBLE) AS pricetick,
  """ + ", ".join(f"coalesce(max({c}) FILTER (u = '{u}'), 0) AS {u}_{c}" for u in ("large", "small", "all") for c in ("spans", "days")) + """
  FROM c JOIN (SELECT vt_symbol, count(*) AS n, min(CAST(datetime AS DATE)) AS f, max(CAST(datetime AS DATE)) AS l, max(i) AS j, min(i) AS k FROM bars JOIN ca ON d = CAST(datetime AS DATE) GROUP BY 1) USING (vt_symbol) GROUP BY 1""")


# ------------------------------------------- contracts, datasets, exports, symbol lists
def contracts(spark, sf):
    """A contract per large nation's first supplier, two of them set anew."""
    store = PanelStore(spark, scratch(spark))
    wanted = [r[0] for r in table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k")).orderBy("k").limit(3).select("k").collect()]  # three contracts
    for k in wanted:
        store.add_contract(str(k), 0.001, 0.002, 10, 0.5)
    for k in wanted[:2]:
        store.add_contract(str(k), 0.003, 0.004, 20, 1.0)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("vt_symbol"), "s_nationkey").join(store.contracts(), "vt_symbol")


_CON = "con AS (SELECT k, row_number() OVER (ORDER BY k) AS i FROM (SELECT min(s_suppkey) AS k FROM supplier GROUP BY s_nationkey))"
register("io_contracts", contracts, f"""WITH {_CON} SELECT CAST(k AS VARCHAR) AS vt_symbol, s_nationkey, CASE WHEN i < 3 THEN 0.003 ELSE 0.001 END::DOUBLE AS long_rate, CASE WHEN i < 3 THEN 0.004 ELSE 0.002 END::DOUBLE AS short_rate,
  CASE WHEN i < 3 THEN 20.0 ELSE 10.0 END::DOUBLE AS size, CASE WHEN i < 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS pricetick FROM con JOIN supplier ON s_suppkey = k WHERE i <= 3""")


def datasets(spark, sf):
    """Datasets saved, one replaced, one removed, read back with their settings."""
    store = PanelStore(spark, scratch(spark))
    df = bars(spark, sf).select("datetime", "vt_symbol", "close")
    for name, low in (("a", 0.0), ("b", 1000.0), ("a", 500.0)):
        store.save_dataset(name, df.where(F.col("close") > low), {"low": low})
    store.remove_dataset("b")
    data, meta = store.load_dataset("a")
    return data.groupBy("vt_symbol").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total")).withColumns({"low": F.lit(meta["low"]), "names": F.lit(",".join(store.list_datasets()))})


register("io_datasets", datasets, f"WITH {BARS} SELECT vt_symbol, count(*) AS n, round(sum(close), 4) AS total, CAST(500 AS DOUBLE) AS low, 'a' AS names FROM bars WHERE close > 500 GROUP BY 1")


def exports(spark, sf):
    """Factors written as CSV and Parquet, read back as a numeric panel, cut to a symbol list from a text file."""
    root = scratch(spark)
    df = bars(spark, sf).select("datetime", "vt_symbol", "close", F.col("volume").cast("int").alias("volume"))
    tb.export_frame(df, f"{root}/factors.parquet")
    tb.export_frame(df, f"{root}/factors.csv")
    lines = df.select("vt_symbol").distinct().where("vt_symbol LIKE '%1'").selectExpr("concat(vt_symbol, '.SSE, comment') AS value").union(spark.createDataFrame([("# picked",), ("vt_symbol",), ("",)], "value string"))
    lines.write.text(f"{root}/symbols")
    listed = tb.read_symbol_list(spark, f"{root}/symbols").select(F.split_part("vt_symbol", F.lit("."), F.lit(1)).alias("vt_symbol"))
    panel = tb.load_numeric_panel(spark, f"{root}/factors.parquet", "1994-01-01", "1997-12-31", 300.0)
    typed = spark.read.csv(f"{root}/factors.csv", header=True).select("vt_symbol", F.col("datetime").cast("timestamp_ntz").alias("datetime"), F.col("close").cast("double").alias("csv_close"))
    return tidy(tb.select_symbols(panel, listed, strict=True).join(typed, ["vt_symbol", "datetime"]).select("datetime", "vt_symbol", "close", "volume", "csv_close"))


register("io_factor_export", exports, f"WITH {BARS} SELECT datetime, vt_symbol, {r('close', 'close')}, volume, {r('close', 'csv_close')} FROM bars WHERE vt_symbol LIKE '%1' AND datetime BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1997-12-31' AND close >= 300")
