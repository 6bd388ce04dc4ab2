"""``tidy`` against its SQL counterpart, on values that lie at or next to a half."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from barloom.functions import maths
from barloom.functions.expr import close, volume
from barloom.functions.ts import ts_corr, ts_std
from barloom.plans.panel import Panel
from catalog.base import r, tidy
from tests.conftest import BAR_SCHEMA


def test_tidy_rounds_as_its_sql(spark):
    rng = np.random.default_rng(7)
    ties = (rng.integers(0, 10**9, 1000) * 2 + 1) / 32 / 10.0 ** rng.integers(0, 6, 1000)
    large = (rng.integers(10**7, 10**10, 1000) * 2 + 1) / 2.0 ** rng.integers(1, 6, 1000) * 10.0 ** rng.integers(0, 4, 1000)
    known = [2048.0134375, 1038.8834375, 3521.2075625, 34477344.125, 93119268.125, 0.4999999999999999e-6, 12345678905.0, 12345678915.0, 9999999999.5, 1e17, 3e21, 0.0]
    values = np.concatenate([ties, large, known])
    values = [float(v) for v in np.concatenate([values, -values])]
    got = [row[0] for row in tidy(spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)).collect()]
    rows = duckdb.connect().execute(f"SELECT {r('v', 'v')} FROM (SELECT unnest($1::DOUBLE[]) AS v)", [values]).fetchall()
    want = [row[0] for row in rows]
    assert [x for x in zip(values, got, want) if x[1] != x[2]] == []


def test_logs_equal_those_of_sql_bit_by_bit(spark):
    values = [float(v) for v in range(1, 4000)] + np.random.default_rng(9).uniform(0.5, 2000, 4000).tolist() + [0.0, -1.0, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = [repr(row[0]) for row in df.select(maths.safe_log(df.v)).collect()]
    con = duckdb.connect()
    sql = "CASE WHEN v > 0 THEN ln(v) WHEN v = 0 THEN -CAST('inf' AS DOUBLE) WHEN v < 0 THEN CAST('nan' AS DOUBLE) END"
    want = [repr(row[0]) for row in con.execute(f"SELECT {sql} FROM (SELECT unnest($1::DOUBLE[]) AS v)", [values]).fetchall()]
    assert [x for x in zip(values, got, want) if x[1] != x[2]] == []


def test_two_bars_correlate_bit_by_bit_as_in_sql(spark):
    rng = np.random.default_rng(8)
    rows = [(dt.datetime(2023, 1, 1 + d), f"S{i}", *[float(1000 + rng.random())] * 4, float(5e5 + 50 * rng.random()), 1.0, 1.0) for i in range(300) for d in range(3)]
    exprs = {"c": ts_corr(close, volume, 10), "s": ts_std(volume, 10)}
    key = lambda rows: sorted((s, str(t), repr(c), repr(d)) for s, t, c, d in rows)
    got = Panel(spark.createDataFrame(rows, BAR_SCHEMA)).select(exprs).select("vt_symbol", "datetime", "c", "s").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE given (datetime TIMESTAMP, vt_symbol VARCHAR, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, turnover DOUBLE, vwap DOUBLE)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    want = con.sql("""SELECT vt_symbol, datetime, round(covar_pop(close, volume) OVER w / sqrt(var_pop(close) OVER w * var_pop(volume) OVER w), 12), stddev_pop(volume) OVER w
        FROM given WINDOW w AS (PARTITION BY vt_symbol ORDER BY datetime ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""").fetchall()
    off = [x for x in zip(key(map(tuple, got)), key(want)) if x[0] != x[1]]
    assert off == []


def test_daily_alphas_equal_their_sql_on_drawn_days(spark, tmp_path):
    """Freshly drawn days, 144 rows a bar: the first two-bar correlations of ten symbols tie as in SQL."""
    source = pq.read_table("/root/testdata/sf0.1/lineitem.parquet")
    quantity, price, date = (source[c].to_numpy() for c in ("l_quantity", "l_extendedprice", "l_shipdate"))
    days = np.unique(date[date < date.min() + np.timedelta64(26, "D")])
    for seed, names in ((100, ("fa_alpha64_daily", "fa_alpha78_daily")), (106, ("fa_alpha99_daily",))):
        rng, n = np.random.default_rng(seed), 1440 * len(days)
        row = rng.integers(0, len(quantity), n)
        folder = tmp_path / str(seed)
        folder.mkdir()
        pq.write_table(pa.table({
            "l_orderkey": rng.integers(0, 900000, n), "l_partkey": rng.integers(0, 120000, n), "l_suppkey": rng.integers(0, 6000, n),
            "l_linenumber": rng.integers(1, 8, n).astype(np.int32), "l_quantity": quantity[row], "l_extendedprice": price[row],
            "l_shipdate": days[rng.integers(0, len(days), n)]}), folder / "lineitem.parquet")
        con = duckdb.connect()
        con.execute(f"SET TimeZone='UTC'; CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
        for name in names:
            got = sorted(map(str, map(tuple, entry.queries()[name](spark, str(folder)).collect())))
            assert got == sorted(map(str, con.sql(entry.oracle_sql()[name]).fetchall())), name
