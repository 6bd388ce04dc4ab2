"""Shared inputs of the registered queries: the bar panel and its derived tables.

``lineitem`` becomes a monthly bar panel: one symbol per supplier, price =
l_extendedprice / l_quantity. Every helper has a Spark form and the same
relation as DuckDB SQL, so each query is checked against independent SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.expr import Expr
from barloom.plans.panel import Panel
from barloom.session import quiet_planning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        quiet_planning(spark)
        return fn(spark, sf)

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly OHLCV bars per supplier."""
    return _ohlcv(table(spark, sf, "lineitem"), F.col("l_suppkey"), F.trunc("l_shipdate", "month"))


def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily OHLCV bars of ten symbols (suppliers by their last digit): years of bars for the long windows."""
    return _ohlcv(table(spark, sf, "lineitem"), F.col("l_suppkey") % 10 + 1, F.col("l_shipdate"))


def _ohlcv(lineitem: DataFrame, symbol: Column, time: Column) -> DataFrame:
    line = lineitem.select(
        symbol.cast("string").alias("vt_symbol"),
        time.cast("timestamp_ntz").alias("datetime"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.struct(
            "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"
        ).alias("seq"),
        "l_quantity", "l_extendedprice",
    )
    return line.groupBy("vt_symbol", "datetime").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("l_quantity").alias("volume"),
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.lit(100.0)).alias("turnover"),
    ).withColumn("vwap", F.col("turnover") / F.col("volume"))


BARS = """bars AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS vt_symbol,
         CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS datetime,
         first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
               l_quantity, l_extendedprice) AS open,
         max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
              l_quantity, l_extendedprice) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS turnover,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(l_quantity) AS vwap
  FROM lineitem GROUP BY 1, 2)"""

#: The same relation by day and last digit of the supplier.
DAILY = BARS.replace("CAST(l_suppkey AS VARCHAR)", "CAST(l_suppkey % 10 + 1 AS VARCHAR)").replace("date_trunc('month', l_shipdate)", "l_shipdate")

DIGITS = 6


def half_away(c: Column, digits: int) -> Column:
    """Round c * 10^digits, halves away from zero, as SQL engines do on doubles.

    Spark's own ``round`` goes by the shortest decimal form of c, which ties elsewhere.
    """
    t = F.abs(c) * 10.0 ** digits
    whole = F.floor(t).cast("double")
    return F.signum(c) * ((whole + F.when(t - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0 ** digits))


def ten_digits(c: Column) -> Column:
    """c, a million or more in size, with ten significant digits as C prints them: exact halves go to even.

    Java's formatter goes by the shortest decimal form and takes halves up, so it only gets what is no half.
    """
    x = F.abs(c)
    m = F.when(x < 1e7, 1000.0).when(x < 1e8, 100.0).otherwise(10.0)
    u = F.when(x < 1e11, 1e1).when(x < 1e12, 1e2).when(x < 1e13, 1e3).when(x < 1e14, 1e4).when(x < 1e15, 1e5).otherwise(1e6)
    half_above_even = (x < 9e15) & ((x % u) * 2 == u) & (((x - x % u) / u) % 2 == 0)
    return F.signum(c) * (
        F.when(x < 1e9, ((x - x % 1) * m + F.rint((x % 1) * m)) / m)  # exact up to the division
        .when(x < 1e10, F.rint(x)).when(half_above_even, x - x % u).otherwise(F.format_string("%.9e", x).cast("double")))


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles for comparison (10 digits from a million up); NaN, infinity and null stay."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.simpleString() in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), c).when(
                F.abs(c) >= 1e6, ten_digits(c)).otherwise(half_away(c, digits) + 0.0)
        elif f.dataType.simpleString() == "timestamp":
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(sql_expr: str, name: str, digits: int = DIGITS) -> str:
    """The SQL counterpart of ``tidy`` for one column."""
    x = f"CAST(({sql_expr}) AS DOUBLE)"
    return (f"CASE WHEN isnan({x}) OR isinf({x}) THEN {x} WHEN abs({x}) >= 1e6 "
            f"THEN CAST(printf('%.9e', {x}) AS DOUBLE) ELSE round({x}, {digits}) + 0.0 END AS {name}")


def panel_query(name: str, exprs: dict[str, Expr], cols_sql: dict[str, str] | None,
                ctes: str = "", source: str = "bars", digits: int = DIGITS,
                frame: Callable = bars, base: str = BARS) -> None:
    """Register expressions over the bar panel with the SQL of each column."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return tidy(Panel(frame(spark, sf)).select(exprs), digits)

    sql = None
    if cols_sql is not None:
        with_ = f"WITH {base}" + (f", {ctes}" if ctes else "")
        cols = ", ".join(r(s, c, digits) for c, s in cols_sql.items())
        sql = f"{with_} SELECT vt_symbol, datetime, {cols} FROM {source}"
    register(name, run, sql)


def W(n: int) -> str:
    return f"(PARTITION BY vt_symbol ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


WS = "(PARTITION BY vt_symbol ORDER BY datetime)"
WD = "(PARTITION BY datetime)"


def avg_rank(x: str, by: str = "datetime") -> str:
    """Average rank of x among the non-null values of a group, as SQL."""
    return (f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST)"
            f" + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 END")
