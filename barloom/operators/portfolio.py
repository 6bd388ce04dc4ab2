"""Portfolio research: rebalancing, turnover, returns, statistics, exposure, PnL."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import safe
from barloom.functions.expr import close, col, running, shift
from barloom.functions.maths import floor_to
from barloom.factors.composites import price_flow_3
from barloom.operators.eligibility import panel_masks
from barloom.operators.evaluate import compounded, segment_column, sharpe
from barloom.plans.intervals import calendar, ordinals
from barloom.plans.panel import Panel
from barloom.session import durable

TIME = "trade_date"


@dataclass(frozen=True)
class PortfolioConfig:
    top_n: int = 50
    rebalance_days: int = 20
    entry_lag: int = 1
    fee_bps: float = 10.0
    score: str = "combo_price_flow_3"
    annual_days: float = 243.0


def strategy_panel(panel: DataFrame, config: PortfolioConfig, segments: dict[str, tuple[str, str]], member: str | None = None, new_listing_days: int = 120,
                   min_turnover: float = 50_000_000, min_circ_mv: float = 100_000, windows: tuple[int, int, int] = (120, 20, 20)) -> DataFrame:
    """Rows of a research panel inside the segments' span (and ``member``), with masks, base factors and their combined rank.

    ``panel`` has trade_date, vt_symbol, name, list_date, is_limit_up, is_limit_down,
    has_valid_bar, is_list_life_valid, close, volume, turnover, circ_mv and more. The
    filters come first, so lags and ranks see the rows that stay.
    """
    first, last = min(a for a, _ in segments.values()), max(b for _, b in segments.values())
    rows = panel.where(F.col(TIME).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    if member is not None:
        rows = rows.where(F.coalesce(F.col(member), F.lit(False)))
    scored = Panel(rows, time=TIME).with_columns(price_flow_3(*windows) | {
        "daily_return": close / shift(close, 1) - 1.0,
        "forward_holding_return": shift(close, -(config.rebalance_days + config.entry_lag)) / shift(close, -config.entry_lag) - 1.0})
    return panel_masks(scored, config.entry_lag, new_listing_days, min_turnover, min_circ_mv)


def backtest_frame(panel: DataFrame, config: PortfolioConfig, segments: dict[str, tuple[str, str]], **rules) -> DataFrame:
    """The frame that ``backtest`` and ``backtest_grid`` take, from a research panel (rules: see ``strategy_panel``)."""
    return strategy_panel(panel, config, segments, **rules).select(TIME, "vt_symbol", "daily_return", "signal_eligible", "benchmark_eligible", config.score)


def exposure_frame(panel: DataFrame, config: PortfolioConfig, segments: dict[str, tuple[str, str]], **rules) -> DataFrame:
    """The frame of the exposure diagnostics: all columns of ``strategy_panel`` but the daily return."""
    return strategy_panel(panel, config, segments, **rules).drop("daily_return")


def rebalance_calendar(days: DataFrame, config: PortfolioConfig) -> DataFrame:
    """rebalance_id, signal_date and the effective window as calendar positions and dates.

    ``days`` is a calendar: one row per trading date, so one ordered task is small.
    """
    k, lag = config.rebalance_days, config.entry_lag
    order = Window.orderBy("day_index")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max("day_index").over(whole)
    rows = days.select(
        "day_index", TIME, F.least(F.col("day_index") + k + lag, last).alias("end_index"),
        F.lead(TIME, lag + 1).over(order).alias("effective_start"),
        F.coalesce(F.lead(TIME, k + lag).over(order), F.max(TIME).over(whole)).alias("effective_end"))
    rows = rows.where((F.col("day_index") % k == 0) & (F.col("end_index") >= F.col("day_index") + lag + 1))
    return rows.select(
        (F.col("day_index") / k).cast("long").alias("rebalance_id"), F.col(TIME).alias("signal_date"), "effective_start", "effective_end",
        (F.col("day_index") + lag + 1).alias("start_index"), "end_index")


def active_days(days: DataFrame, rebalances: DataFrame) -> DataFrame:
    """(trade_date, rebalance_id) of every effective day."""
    spread = rebalances.select("rebalance_id", F.explode(F.sequence("start_index", "end_index")).alias("day_index"))
    return spread.join(days, "day_index").select(TIME, "rebalance_id")


def _equal_weight(rows: DataFrame, count: str, keys: tuple[str, ...] = ()) -> DataFrame:
    sizes = rows.groupBy(*keys, "rebalance_id").agg(F.count("*").alias(count))
    return rows.join(sizes, [*keys, "rebalance_id"]).withColumn("weight", 1.0 / F.col(count))


def target_positions(frame: DataFrame, rebalances: DataFrame, config: PortfolioConfig) -> DataFrame:
    """Top-N eligible symbols by score per rebalance, equal weight.

    The rank filter is pruned before the shuffle (window group limit), so a large
    date sends at most N rows per task.
    """
    keys = rebalances.select("rebalance_id", "signal_date", "effective_start", "effective_end")
    score = F.col(config.score)
    rows = frame.where(F.col("signal_eligible") & score.isNotNull() & ~F.isnan(score)).join(
        keys, frame[TIME] == keys["signal_date"])
    order = Window.partitionBy("rebalance_id").orderBy(score.desc(), "vt_symbol")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_n)
    return _equal_weight(top.select("rebalance_id", "effective_start", "effective_end", "vt_symbol", "rank"), "selected_count")


def benchmark_positions(frame: DataFrame, rebalances: DataFrame) -> DataFrame:
    keys = rebalances.select("rebalance_id", "signal_date", "effective_start", "effective_end")
    rows = frame.where(F.col("benchmark_eligible")).join(keys, frame[TIME] == keys["signal_date"])
    return _equal_weight(rows.select("rebalance_id", "effective_start", "effective_end", "vt_symbol"), "benchmark_count")


def turnover_costs(positions: DataFrame, fee_rate: float | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sum of |weight change| against the previous non-empty rebalance, and its cost, per book of ``keys``.

    Each position is counted once as a buy on its own rebalance and once as a sale
    on the next one present; grouping cancels the part that is kept. The first entry
    is charged, the final exit is not. Positions are written once and read from there.
    """
    # positions are top-N or one rebalance's benchmark per period: far smaller than the panel
    positions = durable(positions.select(*keys, "rebalance_id", "vt_symbol", "weight", "effective_start"))
    order = Window.partitionBy(*keys).orderBy("rebalance_id") if keys else Window.orderBy("rebalance_id")
    present = positions.groupBy(*keys, "rebalance_id").agg(F.min("effective_start").alias(TIME), F.count("*").alias("holding_count")).withColumn(
        "ordinal", F.row_number().over(order).cast("long"))  # one row a rebalance
    placed = positions.join(present.select(*keys, "rebalance_id", "ordinal"), [*keys, "rebalance_id"])
    legs = placed.select(*keys, "vt_symbol", F.explode(F.array(
        F.struct(F.col("ordinal").alias("ordinal"), F.col("weight").alias("w")),
        F.struct((F.col("ordinal") + 1).alias("ordinal"), (-F.col("weight")).alias("w")))).alias("leg")).select(*keys, "vt_symbol", "leg.*")
    change = legs.groupBy(*keys, "ordinal", "vt_symbol").agg(F.sum("w").alias("w"))
    total = change.groupBy(*keys, "ordinal").agg(F.sum(F.abs("w")).alias("turnover"))
    return total.join(present, [*keys, "ordinal"]).select(
        *keys, TIME, "rebalance_id", "turnover", (F.col("turnover") * fee_rate).alias("cost"), "holding_count")


def position_returns(returns: DataFrame, positions: DataFrame, days: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    held = positions.select(*keys, "rebalance_id", "vt_symbol", "weight").join(days, [*keys, "rebalance_id"])
    return returns.join(held, [TIME, "vt_symbol"]).groupBy(*keys, TIME).agg(F.sum(F.col("daily_return") * F.col("weight")).alias(name))


def backtest(frame: DataFrame, config: PortfolioConfig) -> DataFrame:
    """Daily gross, net, benchmark and excess returns of a top-N book.

    ``frame``: trade_date, vt_symbol, daily_return, signal_eligible,
    benchmark_eligible and the score column.
    """
    return backtest_grid(frame, [config]).drop("config")


def backtest_grid(frame: DataFrame, configs: list[PortfolioConfig]) -> DataFrame:
    """``backtest`` of several configurations, numbered in ``config``, on the same frame.

    The configurations are an axis of the calendar: one shared calendar, symbols
    ranked once per signal date, books and returns keyed by configuration.
    """
    if not configs:
        raise ValueError("no configuration")
    if any((c.entry_lag, c.score) != (configs[0].entry_lag, configs[0].score) for c in configs):
        raise ValueError("configurations of one grid must share the panel settings")
    key, score = ("config",), F.col(configs[0].score)
    per_config = lambda of: F.element_at(F.array(*[F.lit(of(c)) for c in configs]), F.col("config") + 1)
    frame = durable(frame.select(TIME, "vt_symbol", "daily_return", "signal_eligible", "benchmark_eligible", configs[0].score))
    days = durable(calendar(frame, TIME))
    plans = [rebalance_calendar(days, c).withColumn("config", F.lit(i)) for i, c in enumerate(configs)]
    plan = durable(functools.reduce(DataFrame.unionByName, plans))  # one row a rebalance
    dates = plan.select("config", "rebalance_id", "signal_date", "effective_start", "effective_end")
    signals = frame.join(plan.select(F.col("signal_date").alias(TIME)).distinct(), TIME)
    order = Window.partitionBy(TIME).orderBy(score.desc(), "vt_symbol")
    top = signals.where(F.col("signal_eligible") & score.isNotNull() & ~F.isnan(score)).withColumn("rank", F.row_number().over(order))
    top = top.where(F.col("rank") <= max(c.top_n for c in configs)).select(F.col(TIME).alias("signal_date"), "vt_symbol", "rank").join(dates, "signal_date")
    book = durable(_equal_weight(top.where(F.col("rank") <= per_config(lambda c: c.top_n)), "selected_count", key))
    even_book = signals.where("benchmark_eligible").select(F.col(TIME).alias("signal_date"), "vt_symbol").join(dates, "signal_date")
    bench = durable(_equal_weight(even_book, "benchmark_count", key))
    active = plan.select("config", "rebalance_id", F.explode(F.sequence("start_index", "end_index")).alias("day_index")).join(days, "day_index").drop("day_index")
    returns = frame.select(TIME, "vt_symbol", "daily_return").where(F.col("daily_return").isNotNull())
    gross = position_returns(returns, book, active, "gross_return", key)
    matched = position_returns(returns, bench, active, "benchmark_gross_return", key)
    even = frame.where(F.col("benchmark_eligible") & F.col("daily_return").isNotNull()).groupBy(TIME).agg(
        F.avg("daily_return").alias("daily_equal_weight_benchmark_return"))
    fee = per_config(lambda c: c.fee_bps / 10_000.0)
    cost = turnover_costs(book, fee, key).drop("rebalance_id")
    bench_cost = turnover_costs(bench, fee, key).select(
        "config", TIME, F.col("turnover").alias("benchmark_turnover"), F.col("cost").alias("benchmark_cost"),
        F.col("holding_count").alias("benchmark_holding_count"))
    both = ["config", TIME]
    rows = gross.join(matched, both, "left").join(even, TIME, "left").join(cost, both, "left").join(bench_cost, both, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("turnover", "cost", "benchmark_turnover", "benchmark_cost")}
    so_far = Window.partitionBy("config").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    held = {c: F.last(c, ignorenulls=True).over(so_far) for c in ("holding_count", "benchmark_holding_count")}
    rows = rows.withColumns(zero | held)
    rows = rows.withColumns({"net_return": F.col("gross_return") - F.col("cost"),
                             "benchmark_return": F.col("benchmark_gross_return") - F.col("benchmark_cost")})
    return rows.withColumns({
        "gross_excess_return": F.col("gross_return") - F.col("benchmark_gross_return"),
        "net_excess_return": F.col("net_return") - F.col("benchmark_return"),
        "daily_equal_weight_net_excess_return": F.col("net_return") - F.col("daily_equal_weight_benchmark_return"),
        "top_n": per_config(lambda c: c.top_n), "rebalance_days": per_config(lambda c: c.rebalance_days)})


RETURNS = {"gross": "gross_return", "net": "net_return", "benchmark": "benchmark_return", "net_excess": "net_excess_return"}


def with_drawdown(daily: DataFrame, ret: str, keys: list[str], name: str, time: str = TIME) -> DataFrame:
    """Equity over its running peak - 1, from the first return of each key.

    A product (not exp of a log sum) keeps a -100 % return. One row per date and key.
    """
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    df = daily.withColumn("__eq", F.product(1.0 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))
    return df.withColumn(name, safe.safe_div(F.col("__eq"), F.max("__eq").over(w)) - 1).drop("__eq")


def summarize(daily: DataFrame, segments: dict[str, tuple[str, str]] | None, annual_days: float = 243.0,
              returns: dict[str, str] = RETURNS, keys: tuple[str, ...] = ("top_n", "rebalance_days")) -> DataFrame:
    """Total, annual, Sharpe, drawdown per return column, turnover and cost, by
    segment (or by calendar year when ``segments`` is None)."""
    names = F.array(F.year(TIME).cast("string")) if segments is None else segment_column(segments, TIME)
    df = daily.withColumn("segment", F.explode(names))
    group = [*keys, "segment"]
    for p, c in returns.items():
        df = with_drawdown(df, c, group, f"__dd_{p}")
    aggs = [F.count("*").alias("days"), F.avg("holding_count").alias("avg_holding_count"),
            F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))).alias("avg_rebalance_turnover"),
            (F.sum("turnover") * annual_days / F.count("*")).alias("annual_turnover"),
            (F.sum("cost") * annual_days / F.count("*")).alias("annual_cost")]
    for p, c in returns.items():
        x = F.coalesce(F.col(c), F.lit(0.0))
        aggs += [compounded(x).alias(f"{p}_total_return"), sharpe(x, annual_days).alias(f"{p}_sharpe"),
                 F.min(f"__dd_{p}").alias(f"{p}_max_drawdown")]
    out = df.groupBy(*group).agg(*aggs)
    annual = {f"{p}_annual_return": F.when(F.col(f"{p}_total_return") > -1, F.pow(
        1 + F.col(f"{p}_total_return"), F.lit(annual_days) / F.col("days")) - 1).otherwise(F.lit(safe.NAN)) for p in returns}
    return out.withColumns(annual)


# ------------------------------------------------------------------ exposure
def forward_holding_return(frame: DataFrame, hold: int, lag: int) -> DataFrame:
    return Panel(frame, time=TIME).with_columns(
        {"forward_holding_return": shift(close, -(hold + lag)) / shift(close, -lag) - 1.0})


def selected_and_benchmark(frame: DataFrame, config: PortfolioConfig) -> tuple[DataFrame, DataFrame]:
    """Top-N and benchmark rows on every k-th date with a known forward return."""
    frame = durable(frame)  # read for the calendar and for both sets
    days = calendar(frame, TIME).where(F.col("day_index") % config.rebalance_days == 0).select(TIME)
    rows = frame.join(days, TIME, "left_semi").where(F.col("forward_holding_return").isNotNull())
    score = F.col(config.score)
    order = Window.partitionBy(TIME).orderBy(score.desc(), "vt_symbol")
    top = rows.where(F.col("signal_eligible") & score.isNotNull() & ~F.isnan(score)).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= config.top_n)
    return top, rows.where(F.col("benchmark_eligible"))


MEDIANS = ("circ_mv", "turnover", "turnover_rate", "pb")


def forward_advantage(selected: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per date: mean forward returns, median exposures and their ratios."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(TIME).agg(
            F.avg("forward_holding_return").alias(f"{p}_forward_return"), F.count("*").alias(f"{p}_count"),
            *[F.median(c).alias(f"{p}_median_{c}") for c in MEDIANS])

    both = side(selected, "selected").join(side(benchmark, "benchmark"), TIME)
    ratios = {f"median_{c}_ratio": safe.safe_div(F.col(f"selected_median_{c}"), F.col(f"benchmark_median_{c}")) for c in MEDIANS}
    return both.withColumns(ratios | {
        "forward_excess_return": F.col("selected_forward_return") - F.col("benchmark_forward_return")})


def t_stat(x: Column) -> Column:
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= 2) & (sd > 0), F.avg(x) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.count(x))).otherwise(F.lit(safe.NAN))


def exposure_summary(daily: DataFrame, segments: dict[str, tuple[str, str]]) -> DataFrame:
    x = F.col("forward_excess_return")
    return daily.withColumn("segment", F.explode(segment_column(segments, TIME))).groupBy("segment").agg(
        F.count("*").alias("rebalance_count"), F.avg("selected_count").alias("selected_count_mean"),
        F.avg("benchmark_count").alias("benchmark_count_mean"), F.avg("selected_forward_return").alias("selected_forward_return_mean"),
        F.avg("benchmark_forward_return").alias("benchmark_forward_return_mean"), F.avg(x).alias("forward_excess_return_mean"),
        F.avg((x > 0).cast("double")).alias("forward_excess_win_rate"), t_stat(safe.nan_to_null(x)).alias("forward_excess_t_stat"),
        *[F.median(f"median_{c}_ratio").alias(f"median_{c}_ratio") for c in MEDIANS])


def category_weights(df: DataFrame, category: str, name: str) -> DataFrame:
    """Share of each category among the date's rows."""
    rows = df.groupBy(TIME, F.coalesce(F.col(category), F.lit("UNKNOWN")).alias(category)).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(TIME))  # one row per category
    return rows.select(TIME, category, (F.col("n") / total).alias(name))


def category_overweight(selected: DataFrame, benchmark: DataFrame, category: str) -> DataFrame:
    both = category_weights(selected, category, "selected_weight").join(
        category_weights(benchmark, category, "benchmark_weight"), [TIME, category], "full")
    both = both.na.fill(0.0, ["selected_weight", "benchmark_weight"])
    return both.groupBy(category).agg(
        F.avg("selected_weight").alias("selected_weight"), F.avg("benchmark_weight").alias("benchmark_weight"),
        F.avg(F.col("selected_weight") - F.col("benchmark_weight")).alias("overweight"))


def index_exposure(selected: DataFrame, benchmark: DataFrame, flags: list[str]) -> DataFrame:
    """Mean membership share against the benchmark for each flag column."""
    share = lambda df, p: df.groupBy(TIME).agg(
        *[F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")).alias(f"{p}{c}") for c in flags])
    both = share(selected, "s_").join(share(benchmark, "b_"), TIME)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("index"), F.col(f"s_{c}").alias("s"), F.col(f"b_{c}").alias("b")) for c in flags]))
    return both.select(rows.alias("r")).select("r.*").groupBy("index").agg(
        F.avg("s").alias("selected_weight"), F.avg("b").alias("benchmark_weight"), F.avg(F.col("s") - F.col("b")).alias("overweight"))


def exposure_diagnostics(frame: DataFrame, config: PortfolioConfig, segments: dict[str, tuple[str, str]],
                         categories: list[str], flags: list[str]) -> dict[str, DataFrame]:
    selected, benchmark = selected_and_benchmark(frame, config)
    daily = forward_advantage(selected, benchmark)
    return {"daily": daily, "summary": exposure_summary(daily, segments),
            **{f"{c}_overweight": category_overweight(selected, benchmark, c) for c in categories},
            "index_exposure": index_exposure(selected, benchmark, flags)}


# ----------------------------------------------------------------------- PnL
def daily_pnl(bars: DataFrame, trades: DataFrame, contracts: DataFrame, time: str = "date") -> DataFrame:
    """Mark to market per contract and day.

    ``bars``: date, vt_symbol, close; ``trades``: date, vt_symbol, direction
    ('long'/'short'), volume, price; ``contracts``: size and rates per symbol.
    Positions are carried by a running sum, which the panel evaluator can split.
    """
    sign = F.when(F.col("direction") == "long", F.col("volume")).otherwise(-F.col("volume"))
    rate = F.when(F.col("direction") == "long", F.col("long_rate")).otherwise(F.col("short_rate"))
    value = F.col("volume") * F.col("price") * F.col("size")
    done = trades.join(contracts.select("vt_symbol", "long_rate", "short_rate", "size"), "vt_symbol").groupBy("vt_symbol", time).agg(
        F.sum(sign).alias("pos_change"), F.sum(sign * F.col("price")).alias("signed_value"), F.sum(value).alias("turnover"),
        F.sum(value * rate).alias("commission"), F.count("*").alias("trade_count"))
    rows = bars.select(time, "vt_symbol", "close").join(done, ["vt_symbol", time], "left").na.fill(0, [
        "pos_change", "signed_value", "turnover", "commission", "trade_count"])
    walked = Panel(rows, time=time).with_columns(
        {"end_pos": running("sum", col("pos_change")), "pre_close": shift(close, 1)})
    walked = walked.join(contracts.select("vt_symbol", "size"), "vt_symbol").withColumns({
        "start_pos": F.col("end_pos") - F.col("pos_change"), "pre_close": F.coalesce("pre_close", F.lit(0.0))})
    walked = walked.withColumns({
        "holding_pnl": F.col("start_pos") * (F.col("close") - F.col("pre_close")) * F.col("size"),
        "trading_pnl": (F.col("pos_change") * F.col("close") - F.col("signed_value")) * F.col("size")})
    walked = walked.withColumn("total_pnl", F.col("holding_pnl") + F.col("trading_pnl"))
    return walked.withColumn("net_pnl", F.col("total_pnl") - F.col("commission")).drop("signed_value", "size", "pos_change")


def portfolio_pnl(contract_days: DataFrame, time: str = "date") -> DataFrame:
    names = ("trade_count", "turnover", "commission", "trading_pnl", "holding_pnl", "total_pnl", "net_pnl")
    return contract_days.groupBy(time).agg(*[F.sum(c).alias(c) for c in names])


def balance_curve(daily: DataFrame, capital: float, time: str = "date") -> DataFrame:
    """Balance, return, high-water mark and drawdown (one row per day)."""
    w = Window.orderBy(time)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    df = daily.withColumn("balance", F.sum("net_pnl").over(so_far) + capital)
    before = F.lag("balance").over(w)
    return df.withColumns({
        "return": F.coalesce(safe.safe_div(F.col("balance"), before) - 1, F.lit(0.0)), "highlevel": F.max("balance").over(so_far),
    }).withColumns({"drawdown": F.col("balance") - F.col("highlevel"),
                    "ddpercent": (safe.safe_div(F.col("balance"), F.col("highlevel")) - 1) * 100})


def statistics(curve: DataFrame, capital: float, annual_days: float = 240.0, risk_free: float = 0.0, time: str = "date") -> DataFrame:
    """One row of performance statistics; no row figures once the balance is not positive."""
    # the peak before the deepest drawdown: the day that set its high-water mark, first one on ties
    low = F.struct("drawdown", time)
    end = curve.agg(F.min(low).alias("m")).select(F.col("m.drawdown").alias("__dd"), F.col(f"m.{time}").alias("__end"))
    peak = curve.crossJoin(F.broadcast(end)).where(F.col(time) <= F.col("__end")).agg(  # one row
        F.min_by(time, F.struct(-F.col("balance"), F.col(time))).alias("__start"), F.max("__end").alias("__end"))
    c = F.count("*")
    out = curve.agg(
        F.min(time).alias("start_date"), F.max(time).alias("end_date"), c.alias("total_days"),
        F.sum((F.col("net_pnl") > 0).cast("int")).alias("profit_days"), F.sum((F.col("net_pnl") < 0).cast("int")).alias("loss_days"),
        F.max_by("balance", time).alias("end_balance"), F.min("drawdown").alias("max_drawdown"), F.min("ddpercent").alias("max_ddpercent"),
        F.sum("net_pnl").alias("total_net_pnl"), F.sum("commission").alias("total_commission"), F.sum("turnover").alias("total_turnover"),
        F.sum("trade_count").alias("total_trade_count"), (F.avg("return") * 100).alias("daily_return"),
        (F.stddev_samp("return") * 100).alias("return_std"), F.min("balance").alias("__low"))
    out = out.crossJoin(F.broadcast(peak)).where(F.col("__low") > 0)  # one row
    n, root = F.col("total_days"), F.sqrt(F.lit(float(annual_days)))
    out = out.withColumns({
        "max_drawdown_duration": F.datediff(F.col("__end").cast("date"), F.col("__start").cast("date")),
        "daily_net_pnl": F.col("total_net_pnl") / n, "daily_commission": F.col("total_commission") / n,
        "daily_turnover": F.col("total_turnover") / n, "daily_trade_count": F.col("total_trade_count") / n,
        "total_return": (F.col("end_balance") / capital - 1) * 100})
    return out.withColumns({
        "annual_return": F.col("total_return") / n * annual_days,
        "sharpe_ratio": F.when(F.col("return_std") > 0, (F.col("daily_return") - risk_free / root) / F.nullif(
            F.col("return_std"), F.lit(0.0)) * root).otherwise(0.0),
        "return_drawdown_ratio": F.when(F.col("max_ddpercent") != 0, -F.col("total_return") / F.nullif(
            F.col("max_ddpercent"), F.lit(0.0))).otherwise(0.0)}).drop("__low", "__start", "__end")


def benchmark_curves(curve: DataFrame, benchmark: DataFrame, capital: float, time: str = "date") -> DataFrame:
    """Cumulative strategy, cost, benchmark and excess returns with drawdowns."""
    so_far = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = curve.join(benchmark.select(time, F.col("close").alias("__b")), time, "left")
    df = df.withColumns({
        "cumulative_return": F.col("balance") / capital - 1, "cumulative_cost": F.sum("commission").over(so_far) / capital,
        "benchmark_return": F.col("__b") / F.first("__b", ignorenulls=True).over(whole) - 1})
    df = df.withColumn("excess_return", F.col("cumulative_return") - F.col("benchmark_return"))
    df = df.withColumn("excess_return_with_cost", F.col("excess_return") + F.col("cumulative_cost"))
    return df.withColumns({
        "drawdown_return": F.col("cumulative_return") - F.max("cumulative_return").over(so_far),
        "excess_drawdown": F.col("excess_return") - F.max("excess_return").over(so_far)}).drop("__b")


def fill_missing_bars(bars: DataFrame, time: str = "datetime") -> DataFrame:
    """A flat bar at the last close for every calendar date a symbol has no bar.

    The grid is symbols x dates from each symbol's first bar on.
    """
    days = bars.select(time).distinct()
    first = bars.groupBy("vt_symbol").agg(F.min(time).alias("__start"))
    spans = first.crossJoin(F.broadcast(days.agg(F.max(time).alias("__end"))))  # one row
    cells = ordinals(spans, days, time, "__start", "__end")
    grid = cells.select("vt_symbol", F.explode(F.sequence("__first", "__last")).alias("day_index")).join(calendar(days, time), "day_index").select("vt_symbol", time)
    rows = grid.join(bars, ["vt_symbol", time], "left")
    filled = Panel(rows, time=time).with_columns({"__last": running("last", close)})
    price = {c: F.coalesce(F.col(c), F.col("__last")) for c in ("open", "high", "low", "close")}
    flow = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("volume", "turnover") if c in bars.columns}
    return filled.withColumns(price | flow).drop("__last")


def top_k_drop_n(signal: DataFrame, holdings: DataFrame, k: int, n_drop: int, time: str = "datetime") -> DataFrame:
    """Daily buy and sell sets: sell the n lowest-ranked holdings, buy into the freed slots.

    ``holdings``: the symbols held before each date. Path-dependent cash is not modelled.
    """
    best = Window.partitionBy(time).orderBy(F.col("signal").desc(), "vt_symbol")
    worst = Window.partitionBy(time).orderBy(F.col("signal").asc_nulls_first(), F.col("vt_symbol").desc())
    held = holdings.join(signal.select(time, "vt_symbol", "signal"), [time, "vt_symbol"], "left")
    sells = held.withColumn("r", F.row_number().over(worst)).where(F.col("r") <= n_drop).select(time, "vt_symbol", F.lit("sell").alias("side"))
    size = holdings.groupBy(time).agg(F.count("*").alias("held"))
    fresh = signal.join(holdings, [time, "vt_symbol"], "left_anti").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    slots = fresh.join(size, time, "left").where(
        F.col("r") <= k - F.coalesce("held", F.lit(0)) + F.least(F.lit(n_drop), F.coalesce("held", F.lit(0))))
    return sells.unionByName(slots.select(time, "vt_symbol", F.lit("buy").alias("side")))


# fixed values: defaults of absent optional signal columns
SIGNAL_DEFAULTS = {"entry_signal": 0.0, "exit_signal": 0.0, "position_scale": 1.0, "portfolio_scale": 1.0, "stop_price": 0.0, "max_hold_days": 0}


def signal_defaults(df: DataFrame) -> DataFrame:
    out = {}
    for name, default in SIGNAL_DEFAULTS.items():
        kind = "int" if name == "max_hold_days" else "double"
        out[name] = F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in df.columns else F.lit(default).cast(kind)
    return df.withColumns(out)


def soft_entry_score(df: DataFrame, weight: float, time: str = "datetime") -> DataFrame:
    """signal + weight * min-max-normalised entry score of the date."""
    from barloom.functions.cs import cs_max, cs_min
    e = col("entry_signal")
    span = Panel(df, time=time).with_columns({"__lo": cs_min(e), "__hi": cs_max(e)})
    part = F.when(F.col("__hi") > F.col("__lo"), (F.col("entry_signal") - F.col("__lo")) / F.nullif(
        F.col("__hi") - F.col("__lo"), F.lit(0.0))).otherwise(0.0)
    return span.withColumn("entry_score", F.col("signal") + weight * part).drop("__lo", "__hi")


def scaled_targets(df: DataFrame, capital: float, cash_ratio: float = 0.95, lot: float = 100.0, time: str = "datetime") -> DataFrame:
    """Lot-floored volumes with cash shared by position scale."""
    from barloom.functions.cs import cs_sum
    share = Panel(df, time=time).with_columns({"__total": cs_sum(col("position_scale"))})
    value = capital * cash_ratio * F.col("portfolio_scale") * F.col("position_scale") / F.nullif(F.col("__total"), F.lit(0.0))
    return share.withColumn("target_volume", floor_to(value / F.col("close"), lot)).drop("__total")


def exit_reasons(positions: DataFrame, signal: DataFrame, bars: DataFrame, keep_k: int, time: str = "datetime") -> DataFrame:
    """First reason to leave each held position: flag, stop, age, rank."""
    rank = Window.partitionBy(time).orderBy(F.col("signal").desc(), "vt_symbol")
    ranked = signal_defaults(signal).withColumn("__rank", F.row_number().over(rank))
    rows = positions.join(ranked.select(time, "vt_symbol", "__rank", *SIGNAL_DEFAULTS), [time, "vt_symbol"], "left").join(
        bars.select(time, "vt_symbol", "close"), [time, "vt_symbol"], "left")
    reason = (
        F.when(F.col("exit_signal") > 0, "exit_signal")
        .when((F.col("stop_price") > 0) & (F.col("close") <= F.col("stop_price")), "stop_price")
        .when((F.col("max_hold_days") > 0) & (F.col("hold_days") >= F.col("max_hold_days")), "max_hold")
        .when(F.col("__rank").isNull() | (F.col("__rank") > keep_k), "rank"))
    return rows.withColumn("exit_reason", reason).where(F.col("exit_reason").isNotNull()).select(time, "vt_symbol", "exit_reason")


def parameter_grid(spark: SparkSession, ranges: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Every combination of (start, end, step) ranges; the grid is the feature here."""
    out = None
    for name, (start, end, step) in ranges.items():
        n = int(round((end - start) / step)) if step else 0
        axis = spark.range(n + 1).select((F.col("id") * step + start).alias(name))
        out = axis if out is None else out.crossJoin(axis)
    return out


def slot_portfolio(trades: DataFrame, days: DataFrame, hold: int, capacity: float, annual_days: float = 244.0) -> tuple[DataFrame, DataFrame]:
    """Spread each trade over ``hold`` days at its per-day rate and divide by capacity.

    ``trades``: day_index (entry), ret. Returns the full-calendar curve and its statistics.
    """
    per_day = F.pow(1.0 + F.col("ret"), F.lit(1.0 / hold)) - 1.0
    spread = trades.select(F.explode(F.sequence(F.col("day_index"), F.col("day_index") + hold - 1)).alias("day_index"), per_day.alias("x"))
    daily = spread.groupBy("day_index").agg((F.sum("x") / capacity).alias("ret"), (F.count("*") / capacity).alias("exposure"))
    curve = days.join(daily, "day_index", "left").na.fill(0.0, ["ret", "exposure"])
    curve = with_drawdown(curve.withColumn("book", F.lit("all")), "ret", ["book"], "drawdown", "day_index")
    years = F.count("*") / F.lit(float(annual_days))
    stats = curve.agg(
        (F.pow(F.product(1.0 + F.col("ret")), 1.0 / years) - 1).alias("cagr"), sharpe(F.col("ret"), annual_days).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg("exposure").alias("avg_exposure"), F.count("*").alias("days"))
    return curve.drop("book"), stats


def without_top_contributors(trades: DataFrame, k: int) -> DataFrame:
    """Trades without the k symbols that contributed most."""
    top = trades.groupBy("vt_symbol").agg(F.sum("ret").alias("s")).orderBy(F.col("s").desc(), "vt_symbol").limit(k)
    return trades.join(top.select("vt_symbol"), "vt_symbol", "left_anti")


def worst_year(curve: DataFrame, annual_days: float = 244.0) -> DataFrame:
    return curve.groupBy(F.year(TIME).alias("year")).agg(sharpe(F.col("ret"), annual_days).alias("sharpe"), compounded(F.col("ret")).alias("total"))


def holding_value(positions: DataFrame, bars: DataFrame, contracts: DataFrame, time: str = "datetime") -> DataFrame:
    """Sum of last close x position x contract size per date."""
    rows = positions.join(bars.select(time, "vt_symbol", "close"), [time, "vt_symbol"]).join(contracts.select("vt_symbol", "size"), "vt_symbol")
    return rows.groupBy(time).agg(F.sum(F.col("close") * F.col("pos") * F.col("size")).alias("holding_value"))


def signal_at(signal: DataFrame, times: DataFrame, time: str = "datetime") -> DataFrame:
    """Signal rows whose time is one of the current bars."""
    return signal.join(times.select(time).distinct(), time, "left_semi")


def net_return(entry: Column, exit_: Column, open_rate: float, close_rate: float) -> Column:
    """Return after a fee on each side; NaN without a positive entry."""
    return F.when(entry > 0, safe.safe_div(exit_ * (1 - close_rate), entry * (1 + open_rate)) - 1).otherwise(F.lit(safe.NAN))


def calendar_metrics(daily: DataFrame, days: DataFrame, ret: str, annual_days: float = 244.0, time: str = TIME) -> DataFrame:
    """Annual return and Sharpe on the full calendar, idle days at zero."""
    full = days.select(time).join(daily.select(time, F.col(ret).alias("x")), time, "left").na.fill(0.0, ["x"])
    n = F.count("*")
    return full.agg(compounded(F.col("x")).alias("total_return"), (F.pow(F.product(1.0 + F.col("x")), F.lit(annual_days) / n) - 1).alias("annual_return"),
                    sharpe(F.col("x"), annual_days).alias("sharpe"), n.alias("days"))
