"""Intraday studies on minute bars joined to events.

Minute bars are keyed (vt_symbol, date, time); a symbol-day holds a bounded number
of bars, so per-day windows stay small while symbols spread over their days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import safe
from barloom.operators.events import bucket
from barloom.plans.intervals import covering, islands, subtract_intervals
from barloom.plans.quantiles import exact_quantiles

WINDOWS = {"m5": 1, "m15": 3, "m30": 6, "m60": 12}  # bars of five minutes


def ret(price: Column, base: Column) -> Column:
    return safe.safe_div(price, base) - 1


def day_bars(events: DataFrame, minutes: DataFrame) -> DataFrame:
    """Event x entry-day bar with the bar's number and the day's first open."""
    day = Window.partitionBy("event_id").orderBy("time")
    rows = events.join(minutes.withColumnRenamed("date", "entry_date"), ["vt_symbol", "entry_date"])
    return rows.withColumns({"bar": F.row_number().over(day), "price_open": F.first("open").over(day)})


def scaled_levels(df: DataFrame) -> DataFrame:
    """Signal levels in minute prices: ratio of the first minute open to the daily open."""
    ratio = F.when(F.col("entry_open") > 0, F.col("price_open") / F.col("entry_open"))
    return df.withColumns({"price_ratio": ratio, "level_high": F.col("signal_high") * F.coalesce(ratio, F.lit(1.0)),
                           "level_low": F.col("signal_low") * F.coalesce(ratio, F.lit(1.0))})


def first_hit(level: Column) -> Column:
    """Aggregate: first time the high reaches a level."""
    return F.min_by("minute_hhmm", F.when(F.col("high") >= level, F.col("bar")))


def minute_features(events: DataFrame, minutes: DataFrame, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """Entry-day path and first-n-bar features; events without bars keep a row."""
    rows = scaled_levels(day_bars(events, minutes))
    o = F.max("price_open")
    aggs = [
        F.count("*").alias("minute_bars"), F.min_by("minute_hhmm", "bar").alias("first_time"), F.max_by("minute_hhmm", "bar").alias("last_time"),
        o.alias("first_open"), F.max("price_ratio").alias("price_ratio"), ret(F.max_by("close", "bar"), o).alias("day_return"),
        ret(F.max("high"), o).alias("day_mfe"), ret(F.min("low"), o).alias("day_mae"),
    ]
    for level in (0.03, 0.05):
        tag = f"tp{int(round(level * 100))}"
        line = F.col("price_open") * (1 + level)
        aggs += [F.coalesce(F.max(F.col("high") >= line), F.lit(False)).alias(f"{tag}_hit"), first_hit(line).alias(f"{tag}_time")]
    for name, n in windows.items():
        inside = F.col("bar") <= n
        only = lambda c: F.when(inside, F.col(c))
        top, bottom, last = F.max(only("high")), F.min(only("low")), F.max_by("close", F.when(inside, F.col("bar")))
        aggs += [
            ret(last, o).alias(f"{name}_return"), ret(top, o).alias(f"{name}_mfe"), ret(bottom, o).alias(f"{name}_mae"), ret(top, bottom).alias(f"{name}_range"),
            F.try_divide(F.sum(only("volume")), F.sum("volume")).alias(f"{name}_volume_share"),
            F.try_divide(F.sum(only("amount")), F.sum("amount")).alias(f"{name}_amount_share"),
            F.coalesce(top >= F.max("level_high"), F.lit(False)).alias(f"{name}_break_high"),
            F.coalesce(bottom >= F.max("level_low"), F.lit(False)).alias(f"{name}_hold_low"),
            F.coalesce(last >= F.max("level_high"), F.lit(False)).alias(f"{name}_close_above_high"),
        ]
    found = rows.groupBy("event_id").agg(*aggs)
    return events.join(found, "event_id", "left").withColumn("has_minutes", F.col("minute_bars").isNotNull())


def quintiles(df: DataFrame, name: str, parts: int = 5) -> DataFrame:
    """Quantile bucket 1..n of a column; null unless it has enough distinct values."""
    qs = exact_quantiles(df, [name], [i / parts for i in range(1, parts)])[name]
    enough = df.select(name).where(F.col(name).isNotNull()).distinct().limit(parts).count() >= parts  # a look at whether there are that many
    if not enough:
        return df.withColumn(f"{name}_q", F.lit(None).cast("int"))
    place = F.size(F.filter(F.array(*[F.lit(q) for q in qs]), lambda q: q < F.col(name))) + 1
    return df.withColumn(f"{name}_q", F.when(F.col(name).isNotNull(), place))


def fixed_buckets(df: DataFrame, name: str, edges: list[float], labels: list[str]) -> DataFrame:
    return df.withColumn(f"{name}_bucket", bucket(F.col(name), edges, labels, right_closed=True))


# ----------------------------------------------------------- confirmation rules
def event_days(events: DataFrame, minutes: DataFrame, horizon: int) -> DataFrame:
    """Minute rows from the entry day through ``horizon`` later trading days of the symbol.

    Days are numbered per symbol on the (symbol, date) table, then met by equality.
    """
    dates = minutes.select("vt_symbol", "date").distinct().withColumn("day_no", F.dense_rank().over(Window.partitionBy("vt_symbol").orderBy("date")))
    start = dates.withColumnsRenamed({"date": "entry_date", "day_no": "first_day"})
    asked = events.join(start, ["vt_symbol", "entry_date"]).withColumn("day_offset", F.explode(F.sequence(F.lit(0), F.lit(horizon))))
    asked = asked.withColumn("day_no", F.col("first_day") + F.col("day_offset")).join(dates, ["vt_symbol", "day_no"])
    rows = asked.join(minutes, ["vt_symbol", "date"])
    order = Window.partitionBy("event_id").orderBy("date", "time")
    return rows.withColumn("bar", F.row_number().over(order)).withColumn("price_open", F.first("open").over(order))


def day_stats(path: DataFrame, specs: DataFrame, bars: str) -> DataFrame:
    """Per event and rule: statistics of the first n entry-day bars (specs: rule, n, limits)."""
    early = path.where("day_offset = 0").crossJoin(F.broadcast(specs)).where(F.col("bar") <= F.col(bars))  # a few rules
    o = F.max("price_open")
    return early.groupBy("event_id", "rule").agg(
        F.count("*").alias("seen"), ret(F.max_by("close", "bar"), o).alias("close_return"), ret(F.max("high"), o).alias("mfe"),
        ret(F.min("low"), o).alias("mae"), F.max_by("minute_hhmm", "bar").alias("confirm_time"))


def delayed_entries(events: DataFrame, minutes: DataFrame, specs: DataFrame, horizon: int, levels=(0.03, 0.05), fee: float = 0.0) -> DataFrame:
    """Enter at the open after n confirming bars that meet the rule; then path metrics.

    ``specs``: rule, confirm_bars, min_close_return, max_close_return, min_mae, min_mfe (null: no limit).
    """
    path = event_days(events, minutes, horizon)
    size = path.where("day_offset = 0").groupBy("event_id").agg(F.count("*").alias("day_bars"))
    stats = day_stats(path, specs, "confirm_bars").join(F.broadcast(specs), "rule").join(size, "event_id")
    limit = lambda c, ok: F.col(c).isNull() | F.coalesce(ok, F.lit(False))
    passed = stats.where(
        (F.col("seen") == F.col("confirm_bars")) & (F.col("day_bars") > F.col("confirm_bars"))
        & limit("min_close_return", F.col("close_return") > F.col("min_close_return")) & limit("max_close_return", F.col("close_return") <= F.col("max_close_return"))
        & limit("min_mae", F.col("mae") > F.col("min_mae")) & limit("min_mfe", F.col("mfe") >= F.col("min_mfe")))
    entry = passed.select("event_id", "rule", (F.col("confirm_bars") + 1).alias("entry_bar"), "confirm_time")
    rows = entry.join(path, "event_id").where(F.col("bar") >= F.col("entry_bar"))
    return path_metrics(rows, ["event_id", "rule"], levels, fee)


def path_metrics(rows: DataFrame, keys: list[str], levels=(0.03, 0.05), fee: float = 0.0) -> DataFrame:
    """Fixed return, MFE, MAE, target hits and offsets of each path from its first bar's open."""
    first = rows.groupBy(*keys).agg(F.min_by("open", "bar").alias("entry_price"), F.min("bar").alias("first_bar"))
    rows = rows.join(first, keys)
    p = F.max("entry_price")
    fixed = ret(F.max_by("close", "bar"), p) - fee
    aggs = [p.alias("price"), F.count("*").alias("path_bars"), fixed.alias("fixed_return"), ret(F.max("high"), p).alias("mfe"), ret(F.min("low"), p).alias("mae")]
    for level in levels:
        tag = f"tp{int(round(level * 100))}"
        offset = F.min(F.when(F.col("high") >= F.col("entry_price") * (1 + level), F.col("bar") - F.col("first_bar")))
        aggs += [offset.isNotNull().alias(f"{tag}_hit"), offset.alias(f"{tag}_offset"),
                 F.when(offset.isNotNull(), F.lit(level - fee)).otherwise(fixed).alias(f"{tag}_plan_return")]
    return rows.groupBy(*keys).agg(*aggs)


def fail_exits(events: DataFrame, minutes: DataFrame, specs: DataFrame, horizon: int, level: float = 0.03, fee: float = 0.0) -> DataFrame:
    """Leave at the next day's open when an early rule fires, else hold for the target.

    ``specs``: rule, check_bars, max_close_return, max_mae, min_mfe (null: not checked), mode any/all.
    """
    path = event_days(events, minutes, horizon)
    stats = day_stats(path, specs, "check_bars").join(F.broadcast(specs), "rule")
    checks = [F.when(F.col(limit).isNotNull(), test.cast("int")) for limit, test in (
        ("max_close_return", F.col("close_return") <= F.col("max_close_return")), ("max_mae", F.col("mae") <= F.col("max_mae")), ("min_mfe", F.col("mfe") < F.col("min_mfe")))]
    hits = sum((F.coalesce(c, F.lit(0)) for c in checks), F.lit(0))
    asked = sum((c.isNotNull().cast("int") for c in checks), F.lit(0))
    fired = (F.col("seen") == F.col("check_bars")) & (asked > 0) & F.when(F.col("mode") == "all", hits == asked).otherwise(hits > 0)
    later = F.col("day_offset") > 0
    p = F.max("price_open")
    plan = path.groupBy("event_id").agg(
        p.alias("entry_price"), F.min_by("open", F.when(later, F.col("bar"))).alias("next_open"),
        F.coalesce(F.max(F.when(later, F.col("high") >= F.col("price_open") * (1 + level))), F.lit(False)).alias("tp_hit"),
        (ret(F.max_by("close", F.when(later, F.col("bar"))), p) - fee).alias("timeout_return"),
        ret(F.max("high"), p).alias("full_mfe"), ret(F.min("low"), p).alias("full_mae"))
    plan = plan.where(F.col("next_open").isNotNull())
    hold = F.when(F.col("tp_hit"), F.lit(level - fee)).otherwise(F.col("timeout_return"))
    return stats.withColumn("fired", fired).select("event_id", "rule", "fired", "close_return").join(plan, "event_id").withColumn(
        "policy_return", F.when(F.col("fired"), ret(F.col("next_open"), F.col("entry_price")) - fee).otherwise(hold))


def policy_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    r = F.col(value)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.avg((r > 0).cast("double")).alias("win_rate"))


# --------------------------------------------------------------------- sampling
def match_keys(events: DataFrame) -> DataFrame:
    score = bucket(F.col("pre_l1_score"), [20, 40, 60, 80], ["0_20", "21_40", "41_60", "61_80", "81_100"], right_closed=True)
    return events.withColumn("match_key", F.concat_ws("|", F.date_format("entry_date", "yyyy-MM-dd"), "pre_l1_type", score))


def matched_negatives(events: DataFrame, ratio: int, seed: int = 7) -> DataFrame:
    """Positives plus min(pool, ratio * positives) negatives of the same stratum.

    The seeded draw is a hash order, so it does not depend on partitions. A stratum
    larger than one task is pruned before the shuffle by the per-stratum limit.
    """
    df = match_keys(events).withColumn("positive", F.coalesce("tomorrow_l1", F.lit(False)))
    want = df.where("positive").groupBy("match_key").agg((F.count("*") * ratio).alias("__want"))
    draw = Window.partitionBy("match_key").orderBy(F.xxhash64(F.lit(seed), "event_id"), "event_id")
    pool = df.where("not positive").join(want, "match_key").withColumn("__n", F.row_number().over(draw)).where(F.col("__n") <= F.col("__want"))
    both = df.where("positive").withColumn("sample_label", F.lit("positive")).unionByName(pool.drop("__n", "__want").withColumn("sample_label", F.lit("negative")))
    return both.drop("positive")


def required_dates(events: DataFrame, days: DataFrame, ahead: int) -> DataFrame:
    """(vt_symbol, trade_date) needed for each event: entry date plus n trading days."""
    at = days.select(F.col("trade_date").alias("entry_date"), "day_index")
    spread = events.select("vt_symbol", "entry_date").distinct().join(at, "entry_date").select(
        "vt_symbol", F.explode(F.sequence(F.col("day_index"), F.col("day_index") + ahead)).alias("day_index"))
    return spread.distinct().join(days, "day_index").select("vt_symbol", "trade_date")


def fetch_ranges(needed: DataFrame, days: DataFrame) -> DataFrame:
    """Contiguous ranges on the trading calendar."""
    return islands(needed, days, "vt_symbol", "trade_date", start="start_date", end="end_date")


def plan_lookup(events: DataFrame, plan: DataFrame, date: str = "entry_date") -> DataFrame:
    """Events with the columns of the earliest range of their symbol's fetch plan that holds their date (none: nulls).

    ``plan`` (vt_symbol, start_date, end_date, ...) may hold overlapping ranges.
    """
    return covering(events, plan, "vt_symbol", date, "start_date", "end_date")


def negative_fetch_plan(cohort: DataFrame, days: DataFrame, ahead: int, fetched: DataFrame | None = None) -> DataFrame:
    """Ranges of trading days that the sampled negatives of ``cohort`` need and ``fetched`` ranges do not hold yet."""
    ranges = fetch_ranges(required_dates(cohort.where("sample_label = 'negative'"), days, ahead), days)
    ranges = ranges.select("vt_symbol", "start_date", "end_date")
    return ranges if fetched is None else subtract_intervals(ranges, fetched, days, "vt_symbol", "trade_date", "start_date", "end_date")
