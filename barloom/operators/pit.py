"""Point-in-time preparation: adjusted prices, disclosure intervals, research panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import safe
from barloom.operators.eligibility import limit_flags
from barloom.plans.intervals import calendar, interval_join, islands, lead_intervals


def merge_adjustment(daily: DataFrame, factors: DataFrame) -> DataFrame:
    """Raw daily bars with their adjustment factor; thousands become units."""
    return daily.join(factors, ["ts_code", "trade_date"], "left").withColumn("amount", F.col("amount") * 1000)


def forward_adjusted(daily: DataFrame) -> DataFrame:
    """OHLC scaled by factor / latest factor of the symbol, rounded to 4; change in %."""
    latest = daily.where(F.col("adj_factor").isNotNull()).groupBy("ts_code").agg(F.max_by("adj_factor", "trade_date").alias("__latest"))
    df = daily.join(latest, "ts_code", "left")
    scale = safe.safe_div(F.col("adj_factor"), F.col("__latest"))
    out = {f"{c}_qfq": F.round(F.col(c) * scale, 4) for c in ("open", "high", "low", "close")}
    return df.withColumns(out | {"pct_chg": safe.safe_div(F.col("close") - F.col("pre_close"), F.col("pre_close")) * 100}).drop("__latest")


def fundamental_events(reports: DataFrame, disclosures: DataFrame) -> DataFrame:
    """One row per (symbol, period, announcement) with its public date.

    The public date is the actual disclosure date, else the announcement.
    """
    actual = disclosures.groupBy("ts_code", "end_date").agg(F.max("actual_date").alias("actual_date"))
    df = reports.join(actual, ["ts_code", "end_date"], "left").withColumn("pit_date", F.coalesce("actual_date", "ann_date"))
    order = Window.partitionBy("ts_code", "end_date", "pit_date").orderBy(F.col("ann_date").desc_nulls_last(), F.col("update_flag").desc_nulls_last())
    return df.where(F.col("pit_date").isNotNull()).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def pit_intervals(events: DataFrame) -> DataFrame:
    """Latest period known from each public date until the day before the next one."""
    order = Window.partitionBy("ts_code", "pit_date").orderBy(F.col("end_date").desc_nulls_last(), F.col("ann_date").desc_nulls_last())
    newest = events.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
    return lead_intervals(newest.withColumnRenamed("pit_date", "valid_from"), "ts_code", "valid_from", "valid_to")


def industry_intervals(members: DataFrame, last_date: Column) -> DataFrame:
    """Open memberships run to ``last_date``; one row per (symbol, start)."""
    df = members.select("ts_code", "industry", F.col("in_date").alias("valid_from"), F.coalesce("out_date", last_date).alias("valid_to"))
    order = Window.partitionBy("ts_code", "valid_from").orderBy(F.col("valid_to").desc_nulls_last(), "industry")
    return df.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def weight_intervals(weights: DataFrame, last_date: Column) -> DataFrame:
    """Each snapshot holds until the day before the index's next snapshot date.

    Snapshot dates are few (one row per index and date).
    """
    dates = lead_intervals(weights.select("index_code", F.col("trade_date").alias("valid_from")).distinct(),
                           "index_code", "valid_from", "valid_to", last_date)
    return weights.withColumnRenamed("trade_date", "valid_from").join(dates, ["index_code", "valid_from"])


def overlapping(intervals: DataFrame, key: str) -> DataFrame:
    """Intervals that start before the key's previous one ended (should be empty)."""
    w = Window.partitionBy(key).orderBy("valid_from")
    return intervals.withColumn("__prev", F.lag("valid_to").over(w)).where(F.col("valid_from") <= F.col("__prev")).drop("__prev")


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def coverage(daily: DataFrame, date: str = "trade_date", key: str = "ts_code") -> DataFrame:
    """Rows, first and last date per symbol, and whether it traded on the last date."""
    stats = daily.groupBy(key).agg(F.count("*").alias("bar_count"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    newest = daily.agg(F.max(date).alias("__newest"))
    return stats.crossJoin(F.broadcast(newest)).withColumn("is_active", F.col("last_date") == F.col("__newest")).drop("__newest")  # one row


def threshold_universe(stats: DataFrame, min_bars: int) -> DataFrame:
    """Symbols with enough bars that still trade."""
    return stats.where((F.col("bar_count") >= min_bars) & F.col("is_active"))


def dynamic_universe(daily: DataFrame, date: str = "trade_date", key: str = "ts_code") -> DataFrame:
    """Holding intervals of consecutive traded days on the observed calendar."""
    return islands(daily, calendar(daily, date), key, date)


def research_panel(daily: DataFrame, basic: DataFrame, limits: DataFrame, stock: DataFrame, stats: DataFrame,
                   fundamentals: DataFrame, industry: DataFrame, index_weights: dict[str, DataFrame], min_bars: int = 1000) -> DataFrame:
    """Daily bars with valuation, limits, listing data, point-in-time fundamentals,
    industry and index membership, and derived state flags.

    Equi joins first; interval joins are bucketed by year.
    """
    df = (daily.join(basic, ["ts_code", "trade_date"], "left").join(limits, ["ts_code", "trade_date"], "left")
          .join(stock, "ts_code", "left").join(stats.select("ts_code", "bar_count"), "ts_code", "left"))
    df = interval_join(df, prefixed(fundamentals, "fi_", ["valid_from", "valid_to"]), "ts_code", "trade_date",
                       "valid_from", "valid_to", "left", right_on="fi_ts_code").drop("valid_from", "valid_to")
    ind = industry.select(F.col("ts_code").alias("i_code"), "industry", "valid_from", "valid_to")
    df = interval_join(df, ind, "ts_code", "trade_date", "valid_from", "valid_to", "left", right_on="i_code").drop("valid_from", "valid_to")
    for name, weights in index_weights.items():
        side = weights.select(F.col("ts_code").alias("w_code"), F.col("weight").alias(f"{name}_weight"), "valid_from", "valid_to")
        df = interval_join(df, side, "ts_code", "trade_date", "valid_from", "valid_to", "left", right_on="w_code").drop("valid_from", "valid_to")
        df = df.withColumn(f"is_{name}", F.col(f"{name}_weight").isNotNull())
    df = limit_flags(df, "close")
    return df.withColumns({
        "vwap": safe.safe_div(F.col("amount"), F.col("volume")),
        "has_valid_bar": F.coalesce((F.col("close") > 0) & (F.col("volume") > 0), F.lit(False)),
        "is_list_life_valid": F.coalesce(
            (F.col("trade_date") >= F.col("list_date")) & (F.col("delist_date").isNull() | (F.col("trade_date") <= F.col("delist_date"))), F.lit(False)),
        "has_enough_bars": F.coalesce(F.col("bar_count") >= min_bars, F.lit(False)),
        "year": F.year("trade_date"),
    })


def report_periods(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Quarter ends inside the range."""
    quarters = spark.sql(
        f"SELECT explode(sequence(trunc(date'{start}', 'QUARTER'), date'{end}', interval 3 months)) AS q")
    ends = quarters.select(F.last_day(F.add_months("q", 2)).alias("end_date"))
    return ends.where(F.col("end_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def open_days(cal: DataFrame, start: str, end: str) -> DataFrame:
    return cal.where((F.col("is_open") == 1) & F.col("cal_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("cal_date")


def require_tables(found: list[str], needed: list[str]) -> None:
    missing = sorted(set(needed) - set(found))
    if missing:
        raise ValueError(f"missing source tables: {', '.join(missing)}")


def date_bounds(daily: DataFrame, start: str | None = None, end: str | None = None, date: str = "trade_date") -> DataFrame:
    """Requested bounds, else the data's own (one row)."""
    lo = F.min(date) if start is None else F.max(F.lit(start).cast("date"))
    hi = F.max(date) if end is None else F.max(F.lit(end).cast("date"))
    return daily.agg(lo.alias("start"), hi.alias("end"))
