"""Factor evaluation: rank IC, spreads, correlation, composites, quantile backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import safe
from barloom.functions.cs import cs_count, cs_pct, cs_rank
from barloom.functions.expr import Expr, close, col, shift
from barloom.plans.intervals import calendar
from barloom.plans.gram import correlations
from barloom.plans.panel import Panel

Segments = dict[str, tuple[str, str]]


def forward_return(horizon: int, entry_lag: int = 1, price: Expr = close) -> Expr:
    """Return from the close ``entry_lag`` bars ahead over ``horizon`` bars."""
    if horizon <= 0 or entry_lag < 0:
        raise ValueError("horizon must be positive and entry_lag non-negative")
    return shift(price, -(entry_lag + horizon)) / shift(price, -entry_lag) - 1.0


def corr_agg(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NaN without variance (never raises)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return safe.safe_div(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def segment_column(segments: Segments, time: str = "datetime") -> Column:
    """Names of the (possibly overlapping) segments a row belongs to, as an array."""
    names = [F.when(F.col(time).between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")), F.lit(n))
             for n, (a, b) in segments.items()]
    return F.array_compact(F.array(*names))


def observations(df: DataFrame, factors: list[str], labels: list[str], eligible: str | None = None) -> DataFrame:
    """(datetime, vt_symbol, factor_name, label_name, factor, label) without missing values."""
    if eligible is not None:
        df = df.where(F.coalesce(F.col(eligible), F.lit(False)))
    clean = lambda c: safe.nan_to_null(F.col(c).cast("double"))
    fs = F.explode(F.array(*[F.struct(F.lit(f).alias("factor_name"), clean(f).alias("factor")) for f in factors]))
    ls = F.explode(F.array(*[F.struct(F.lit(x).alias("label_name"), clean(x).alias("label")) for x in labels]))
    rows = df.select("datetime", "vt_symbol", *{*factors, *labels}).select("*", fs.alias("f"))
    rows = rows.where(F.col("f.factor").isNotNull()).select("datetime", "vt_symbol", "f.*", *labels)
    rows = rows.select("datetime", "vt_symbol", "factor_name", "factor", ls.alias("l"))
    return rows.where(F.col("l.label").isNotNull()).select("datetime", "vt_symbol", "factor_name", "factor", "l.*")


def ranked(obs: DataFrame, min_universe: int = 1, **panel) -> DataFrame:
    """Average ranks of factor and label per (date, factor, label) cell.

    A cell with one shared value may be large: the panel evaluator splits it.
    """
    cells = obs.withColumn("cell", F.struct("datetime", "factor_name", "label_name"))
    out = Panel(cells, time="cell", **panel).with_columns({
        "factor_rank": cs_rank(col("factor")), "label_rank": cs_rank(col("label")), "sample_count": cs_count(col("factor")),
    })
    return out.where(F.col("sample_count") >= min_universe).select(
        "datetime", "vt_symbol", "factor_name", "label_name", "factor", "label", "factor_rank", "label_rank", "sample_count",
        (F.col("factor_rank") / F.col("sample_count")).alias("factor_pct"))


def daily_scores(rows: DataFrame, quantile: float = 0.2) -> DataFrame:
    """Per date: rank IC, top-minus-bottom spread and sample count."""
    top = F.avg(F.when(F.col("factor_pct") >= 1.0 - quantile, F.col("label")))
    bottom = F.avg(F.when(F.col("factor_pct") <= quantile, F.col("label")))
    return rows.groupBy("datetime", "factor_name", "label_name").agg(
        corr_agg(F.col("factor_rank"), F.col("label_rank")).alias("ic"), (top - bottom).alias("spread"),
        F.max("sample_count").alias("sample_count"))


def _mean(c: str) -> Column: return F.coalesce(F.avg(safe.nan_to_null(F.col(c))), F.lit(safe.NAN))


def _ir(c: str) -> Column:
    x = safe.nan_to_null(F.col(c))
    sd = F.stddev_samp(x)
    return F.when(sd > 0, F.avg(x) / F.nullif(sd, F.lit(0.0))).otherwise(F.lit(safe.NAN))


def summary(daily: DataFrame, segments: Segments, keys: tuple[str, ...] = ("factor_name", "label_name")) -> DataFrame:
    """IC mean, ICIR, days, positive rate, samples, spread per segment.

    Segments without data still give a row: 0 days and NaN metrics.
    """
    spark = daily.sparkSession
    names = spark.createDataFrame([(n,) for n in segments], "segment string")
    got = daily.withColumn("segment", F.explode(segment_column(segments))).groupBy(*keys, "segment").agg(
        _mean("ic").alias("ic"), _ir("ic").alias("icir"), F.count(safe.nan_to_null(F.col("ic"))).alias("days"),
        F.coalesce(F.avg((safe.nan_to_null(F.col("ic")) > 0).cast("double")), F.lit(safe.NAN)).alias("positive_rate"),
        F.avg("sample_count").alias("samples_mean"), _mean("spread").alias("spread"), _ir("spread").alias("spread_ir"))
    grid = daily.select(*keys).distinct().crossJoin(F.broadcast(names))  # a handful of segment names
    fill = {c: F.coalesce(F.col(c), F.lit(safe.NAN)) for c in ("ic", "icir", "positive_rate", "samples_mean", "spread", "spread_ir")}
    return grid.join(got, [*keys, "segment"], "left").withColumns(fill).withColumn("days", F.coalesce("days", F.lit(0)))


def score_grid(df: DataFrame, factors: list[str], labels: list[str], segments: Segments, min_universe: int = 1,
               quantile: float = 0.2, eligible: str | None = None) -> DataFrame:
    """Every factor x horizon x segment from one pass over the panel."""
    return summary(daily_scores(ranked(observations(df, factors, labels, eligible), min_universe), quantile), segments)


def sign_flags(scores: DataFrame, first: str = "train", second: str = "valid", third: str = "test") -> DataFrame:
    """One row per factor and label with each segment's IC and sign agreement."""
    ic = lambda s: F.max(F.when(F.col("segment") == s, F.col("ic")))
    wide = scores.groupBy("factor_name", "label_name").agg(*[ic(s).alias(f"{s}_ic") for s in (first, second, third)])
    agree = lambda a, b: (F.signum(F.col(f"{a}_ic")) == F.signum(F.col(f"{b}_ic"))) & (F.col(f"{a}_ic") != 0)
    return wide.withColumns({"valid_consistent": agree(first, second), "test_consistent": agree(first, third),
                             "all_consistent": agree(first, second) & agree(first, third)})


def report(scores: DataFrame, segment: str = "test", top: int | None = None) -> DataFrame:
    """Rows of a segment by |IC|, undefined last."""
    order = F.when(F.isnan("ic"), F.lit(-1.0)).otherwise(F.abs("ic")).desc()
    rows = scores.where(F.col("segment") == segment).orderBy(order, "factor_name", "label_name")
    return rows if top is None else rows.limit(top)


def yearly(daily: DataFrame) -> DataFrame:
    """IC and spread per factor, label and calendar year."""
    return daily.withColumn("year", F.year("datetime")).groupBy("factor_name", "label_name", "year").agg(
        _mean("ic").alias("ic"), _ir("ic").alias("icir"), F.count(safe.nan_to_null(F.col("ic"))).alias("days"),
        _mean("spread").alias("spread"))


def rank_correlation(df: DataFrame, factors: list[str], **panel) -> DataFrame:
    """Pooled correlation of per-date percentile ranks for every factor pair.

    Rows must have every factor (ranks are taken before that filter). The pairs come
    from one matrix of cross-products, so any number of factors is one pass.
    """
    clean = df.select("datetime", "vt_symbol", *[safe.nan_to_null(F.col(f).cast("double")).alias(f) for f in factors])
    pct = Panel(clean, **panel).select({f: cs_pct(col(f)) for f in factors})
    return correlations(pct, factors, shift=0.5)  # ranks lie around one half


def composite(df: DataFrame, weights: dict[str, float], **panel) -> DataFrame:
    """Weighted sum of per-date percentile ranks on rows that have every factor."""
    clean = df.select("datetime", "vt_symbol", *[safe.nan_to_null(F.col(f).cast("double")).alias(f) for f in weights])
    ranks = Panel(clean, **panel).select({f: cs_pct(col(f)) for f in weights}).na.drop(subset=list(weights))
    total = sum((F.col(f) * w for f, w in weights.items()), F.lit(0.0))
    return ranks.select("datetime", "vt_symbol", total.alias("factor"))


def rebalance_dates(df: DataFrame, every: int, time: str = "datetime") -> DataFrame:
    """Every k-th distinct date."""
    return calendar(df, time, "__i").where(F.col("__i") % every == 0).select(time)


def quantile_backtest(df: DataFrame, hold: int = 1, quantile: float = 0.2, fee: float = 0.0005,
                      winsor: float | None = None, long_only: bool = False) -> DataFrame:
    """Per rebalance date: gross, turnover and net of an equal-weight quantile book.

    ``df`` has datetime, vt_symbol, close, factor. Long-only weighs the top leg
    against the whole universe.
    """
    whole = Panel(df.select("datetime", "vt_symbol", "close", "factor"))
    checked = whole.measured(["vt_symbol", "datetime"])  # groups only lose rows from here on
    rows = whole.with_columns({"fwd": shift(close, -hold) / close - 1.0}, keep=["factor"])
    rows = rows.withColumn("factor", safe.nan_to_null(F.col("factor"))).na.drop(subset=["factor", "fwd"])
    if winsor:
        rows = rows.withColumn("fwd", F.greatest(F.least("fwd", F.lit(winsor)), F.lit(-winsor)))
    if hold > 1:
        rows = rows.join(rebalance_dates(rows, hold), "datetime", "left_semi")
    rows = Panel(rows, oversized=checked).with_columns({"pct": cs_pct(col("factor"))}, keep=["fwd"])
    long, short = F.col("pct") >= 1 - quantile, F.col("pct") <= quantile
    sizes = rows.groupBy("datetime").agg(
        F.sum(long.cast("int")).alias("n_long"), F.sum((short & ~long).cast("int")).alias("n_short"), F.count("*").alias("n"))
    rows = rows.join(sizes, "datetime")
    if long_only:
        weight = F.when(long, F.try_divide(F.lit(1.0), F.col("n_long"))).otherwise(0.0) - 1.0 / F.col("n")
    else:
        weight = F.when(long, F.try_divide(F.lit(1.0), F.col("n_long"))).when(
            short, -F.try_divide(F.lit(1.0), F.col("n_short"))).otherwise(0.0)
    held = Panel(rows.withColumn("w", weight), oversized=checked).with_columns({"before": shift(col("w"), 1)}, keep=["w", "fwd"])
    return held.groupBy("datetime").agg(
        F.sum(F.col("w") * F.col("fwd")).alias("gross"),
        F.sum(F.abs(F.col("w") - F.coalesce("before", F.lit(0.0)))).alias("turnover"),
    ).withColumn("net", F.col("gross") - fee * F.col("turnover"))


def sharpe(x: Column, periods: float) -> Column:
    sd = F.stddev_samp(x)
    return F.when(sd > 0, F.avg(x) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(float(periods)))).otherwise(F.lit(safe.NAN))


def compounded(x: Column) -> Column:
    return F.product(1.0 + x) - 1.0


def backtest_summary(book: DataFrame, periods: float) -> DataFrame:
    """Sharpe before and after fees, compounded and annual net, average turnover."""
    return book.agg(
        sharpe(F.col("gross"), periods).alias("gross_sharpe"), sharpe(F.col("net"), periods).alias("net_sharpe"),
        compounded(F.col("net")).alias("net_total"), (F.avg("net") * periods).alias("ann_net"),
        F.avg("turnover").alias("avg_turnover"))


def quantile_returns(df: DataFrame, quantiles: int = 10, horizon: int = 1) -> DataFrame:
    """Mean forward return per date and factor quantile (no pivot)."""
    whole = Panel(df.select("datetime", "vt_symbol", "close", "factor"))
    checked = whole.measured(["vt_symbol", "datetime"])  # groups only lose rows from here on
    rows = whole.with_columns({"fwd": shift(close, -horizon) / close - 1.0}, keep=["factor"])
    rows = rows.withColumn("factor", safe.nan_to_null(F.col("factor"))).na.drop(subset=["factor", "fwd"])
    placed = Panel(rows, oversized=checked).with_columns({"pct": cs_pct(col("factor"))}, keep=["fwd"])
    # same quantile edges for equal values; ceil(pct * q) is 1..q
    bucket = F.greatest(F.lit(1), F.ceil(F.round(F.col("pct") * quantiles, 9))).cast("int")
    return placed.groupBy("datetime", bucket.alias("quantile")).agg(F.avg("fwd").alias("mean_return"), F.count("*").alias("n"))


def event_score_ic(df: DataFrame, scores: list[str], returns: list[str], date: str = "signal_date", min_rows: int = 3) -> DataFrame:
    """Daily Spearman of each score with each return, and its mean, median and positive rate.

    Days need at least three rows and two distinct values on both sides.
    """
    obs = observations(df.withColumnRenamed(date, "datetime"), scores, returns)
    rows = ranked(obs)
    daily = rows.groupBy("datetime", "factor_name", "label_name").agg(
        corr_agg(F.col("factor_rank"), F.col("label_rank")).alias("ic"), F.count("*").alias("n"),
        (F.min("factor") < F.max("factor")).alias("fv"), (F.min("label") < F.max("label")).alias("lv"))
    daily = daily.where((F.col("n") >= min_rows) & F.col("fv") & F.col("lv"))
    return daily.groupBy("factor_name", "label_name").agg(
        F.avg("ic").alias("ic_mean"), F.median("ic").alias("ic_median"), F.count("*").alias("days"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"))


def pooled_spearman(df: DataFrame, score: str, ret: str, **panel) -> DataFrame:
    """Spearman over all events at once."""
    rows = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull()).select(
        F.col("event_id").cast("string").alias("event_id"), F.lit(0).alias("all"), F.col(score).alias("s"), F.col(ret).alias("r"))
    ranks = Panel(rows, symbol="event_id", time="all", **panel).select({"a": cs_rank(col("s")), "b": cs_rank(col("r"))})
    return ranks.agg(corr_agg(F.col("a"), F.col("b")).alias("spearman"), F.count("*").alias("n"))
