"""Event studies: pools, day filters, ranked selection, scores, buckets, collectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import safe
from barloom.functions.cs import cs_count, cs_rank
from barloom.functions.expr import apply, bar_index, col, roll, shift
from barloom.operators.evaluate import compounded
from barloom.plans.panel import Panel
from barloom.plans.statescan import state_scan

# fixed values: type names, their labels, and the column that refines each with its default
BUY_POINTS = {"L1": ("start_type", "unknown_start_type"), "L2": ("l2_confirm_type", "confirm_raw"), "L3": ("l3_filter", "raw")}


def buy_point_columns(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Label and subtype of each buy point; unknown types keep their text as label."""
    if "buy_point_type" not in df.columns:
        raise ValueError("snapshot lacks buy_point_type")
    kind = F.trim(F.coalesce("buy_point_type", F.lit("")))
    label, subtype = kind, F.lit("unknown_buy_point_type")
    for value, text in labels.items():
        label = F.when(kind == value, F.lit(text)).otherwise(label)
    for value, (source, default) in BUY_POINTS.items():
        text = F.trim(F.coalesce(source, F.lit(""))) if source in df.columns else F.lit("")
        subtype = F.when(kind == value, F.when(text == "", F.lit(default)).otherwise(text)).otherwise(subtype)
    return df.withColumns({"buy_point_label": label, "buy_point_subtype": subtype})


def signal_pool(df: DataFrame, kind: str, flags: dict[str, bool]) -> DataFrame:
    """Rows of one type whose validity flags hold (a missing flag takes its default)."""
    ok: Column = F.col("buy_point_type") == kind
    for name, default in flags.items():
        ok &= F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    return df.where(ok)


def day_statistics(pool: DataFrame, score: str, threshold: float, date: str = "signal_date") -> DataFrame:
    return pool.groupBy(date).agg(
        F.count("*").alias("signal_count"), F.countDistinct("vt_symbol").alias("symbol_count"),
        F.avg(score).alias("score_mean"), F.max(score).alias("score_max"),
    ).withColumn("day_pass", F.coalesce(F.col("score_mean") >= threshold, F.lit(False)))


def day_filter(pool: DataFrame, score: str, threshold: float, date: str = "signal_date") -> DataFrame:
    """Pool rows with their day's statistics; days under the threshold are dropped."""
    return pool.join(day_statistics(pool, score, threshold, date).where("day_pass"), date)


def resolve_signal_date(pool: DataFrame, score: str, threshold: float, date: str = "signal_date") -> DataFrame:
    """Latest date that passes (one row)."""
    return day_statistics(pool, score, threshold, date).agg(F.max(F.when(F.col("day_pass"), F.col(date))).alias(date))


def _by_score(scores: list[str], date: str) -> "Window":
    return Window.partitionBy(date).orderBy(*[F.col(s).desc_nulls_last() for s in scores], "vt_symbol")


def rank_pool(pool: DataFrame, scores: list[str], name: str = "signal_close_rank", date: str = "signal_date") -> DataFrame:
    """Per-day position by several descending keys, then symbol."""
    return pool.withColumn(name, F.row_number().over(_by_score(scores, date)))


def top_executable(ranked: DataFrame, k: int, rank: str = "signal_close_rank", date: str = "signal_date") -> DataFrame:
    """First k executable rows by rank (the limit is pruned before the shuffle)."""
    w = Window.partitionBy(date).orderBy(rank)
    return ranked.where(F.col("open_executable")).withColumn("next_open_execution_rank", F.row_number().over(w)).where(
        F.col("next_open_execution_rank") <= k)


def industry_capped(ranked: DataFrame, k: int, cap: float, rank: str = "signal_close_rank", date: str = "signal_date") -> DataFrame:
    """Top k with at most ceil(k * cap) per industry: same picks as taking rows greedily."""
    limit = int(np.ceil(k * cap))
    rows = ranked.withColumn("__i", F.row_number().over(Window.partitionBy(date, "industry").orderBy(rank))).where(F.col("__i") <= limit)
    picked = rows.withColumn("pick", F.row_number().over(Window.partitionBy(date).orderBy(rank)))
    return picked.where(F.col("pick") <= k).drop("__i")


def plan_return(df: DataFrame, hit: str, target_net: str, timeout: str, name: str = "plan_return") -> DataFrame:
    return df.withColumn(name, F.when(F.coalesce(F.col(hit), F.lit(False)), F.col(target_net)).otherwise(F.col(timeout)))


def equal_weight_daily(df: DataFrame, ret: str, date: str = "signal_date", keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys, date).agg(F.avg(ret).alias("daily_return"), F.count("*").alias("trades"))


def daily_summary(daily: DataFrame, date: str = "signal_date", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, quantiles, hit rate, drawdown and compounded return of daily returns."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    df = daily.withColumn("__e", F.product(1.0 + F.coalesce("daily_return", F.lit(0.0))).over(w))
    df = df.withColumn("__dd", F.try_divide(F.col("__e"), F.max("__e").over(w)) - 1)
    return df.groupBy(*keys).agg(
        F.count("*").alias("days"), F.avg("daily_return").alias("mean"), F.percentile("daily_return", 0.1).alias("p10"),
        F.median("daily_return").alias("median"), F.avg((F.col("daily_return") > 0).cast("double")).alias("win_rate"),
        F.min("__dd").alias("max_drawdown"), compounded(F.col("daily_return")).alias("compounded"))


# ------------------------------------------------------------------------ scores
def pct_rank_by_day(df: DataFrame, names: list[str], prefix: str, ascending: bool = True, date: str = "signal_date") -> DataFrame:
    """Average rank over the non-null count, missing 0.5, clipped to 0..1."""
    exprs = {}
    for n in names:
        x = col(n) * (1.0 if ascending else -1.0)
        exprs[f"{prefix}{n}"] = cs_rank(x) / cs_count(x)
    out = Panel(df, symbol="event_id", time=date).with_columns(exprs)
    return out.withColumns({c: fill_score(F.col(c)) for c in exprs})


def fill_score(c: Column) -> Column:
    c = safe.nan_to_null(c.cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.5))))


# fixed values: components, weights and switches of the experimental scores
RANKED_SOURCES = {
    "start_score": "start_score", "bar_range_pct": "bar_range", "real_body_pct": "real_body", "turnover_rate": "turnover",
    "close_vs_ema20": "close_vs_ema20", "close_vs_ema60": "close_vs_ema60", "ema20_vs_ema60": "ema20_vs_ema60", "plus_di": "plus_di",
    "macd_hist": "macd_hist", "vol_ratio": "vol_ratio", "close_position": "close_position", "rsi": "rsi", "circ_mv": "size",
}
DIRECT_SOURCES = {
    "factor_core4_pct": "core4", "factor_pvcorr60_pct": "pvcorr60", "factor_broad_top5_pct": "broad_top5", "factor_antitrix14_pct": "antitrix14",
    "candidate_pool_score": "candidate_pool", "short_tp_score_v1": "short_tp", "industry_rs_bucket_score": "industry",
    "market_breadth_bucket_score": "breadth", "vol_quality_bucket_score": "vol_quality",
}
START_TYPES = {"panic_reversal": 1.0, "both": 0.85, "exhaustion_start": 0.6}
MEANS = {
    "thrust": ("bar_range", "real_body", "turnover", "close_vs_ema20", "plus_di", "vol_ratio", "close_position"),
    "trend_repair": ("close_vs_ema20", "close_vs_ema60", "ema20_vs_ema60", "plus_di", "macd_hist", "rsi"),
    "factor_safety": ("core4", "pvcorr60", "broad_top5", "antitrix14", "size"),
    "context": ("industry", "breadth", "vol_quality"), "start_quality": ("start_score", "start_type"),
}
WEIGHTED = {
    "l1_rank_score_eod_v1": {"thrust": 0.34, "start_quality": 0.22, "factor_safety": 0.20, "context": 0.14, "short_tp": 0.10},
    "l1_rank_score_balanced_v1": {"core4": 0.35, "short_tp": 0.30, "thrust": 0.20, "context": 0.15},
    "l1_rank_score_short_focus_v1": {"short_tp": 0.45, "thrust": 0.25, "core4": 0.20, "context": 0.10},
    "l1_rank_score_context_safe_v1": {"factor_safety": 0.35, "context": 0.25, "start_quality": 0.20, "vol_quality": 0.20},
    "l1_rank_score_thrust_v1": {"thrust": 0.58, "trend_repair": 0.22, "start_quality": 0.20},
}


def score_candidates(df: DataFrame, date: str = "signal_date") -> DataFrame:
    """Component scores and the weighted, blended and conditional rank scores.

    Absent source columns count as missing. Needs event_id, start_type, start_grade.
    """
    needed = [*RANKED_SOURCES, *DIRECT_SOURCES, "rank_score_core4_short70_30", "rank_score_short_tp_v1", "market_stage_bucket_score"]
    df = df.withColumns({c: (F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")) for c in dict.fromkeys(needed)})
    df = pct_rank_by_day(df, list(RANKED_SOURCES), "__r_", date=date)
    parts = {f"cmp_{t}": F.col(f"__r_{s}") for s, t in RANKED_SOURCES.items()}
    parts |= {f"cmp_{t}": fill_score(F.col(s)) for s, t in DIRECT_SOURCES.items()}
    start = F.lit(0.5)
    for name, value in START_TYPES.items():
        start = F.when(F.col("start_type") == name, F.lit(value)).otherwise(start)
    df = df.withColumns(parts | {"cmp_start_type": start}).drop(*[f"__r_{s}" for s in RANKED_SOURCES])
    df = df.withColumns({f"cmp_{n}": safe.skipnull_mean(*[F.col(f"cmp_{p}") for p in ps]) for n, ps in MEANS.items()})
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    df = df.withColumns({n: clip(sum((F.col(f"cmp_{p}") * w for p, w in ws.items()), F.lit(0.0))) for n, ws in WEIGHTED.items()})
    core, pool = fill_score(F.col("rank_score_core4_short70_30")), F.col("cmp_candidate_pool")
    short, context = fill_score(F.col("rank_score_short_tp_v1")), F.col("l1_rank_score_context_safe_v1")
    blends = {f"blend_core4_candidate_{a}_{100 - a}": clip(core * (a / 100) + pool * (1 - a / 100)) for a in (80, 70, 60)}
    blends |= {f"blend_core4_pvcorrpct_{a}_{100 - a}": clip(core * (a / 100) + F.col("cmp_pvcorr60") * (1 - a / 100)) for a in (80, 70)}
    switch = lambda cond, a, b: F.when(F.coalesce(cond, F.lit(False)), a).otherwise(b)
    kind, industry = F.col("start_type"), F.col("industry_rs_bucket_score")
    return df.withColumns(blends | {
        "cond_panic_core4_else_candidate": switch(kind == "panic_reversal", core, pool),
        "cond_panic_candidate_else_core4": switch(kind == "panic_reversal", pool, core),
        "cond_both_core4_else_short": switch(kind == "both", core, short),
        "cond_grade_a_core4_else_short": switch(F.col("start_grade") == "A", core, short),
        "cond_weak_market_context_else_core4": switch(F.col("market_stage_bucket_score") <= 2, context, core),
        "cond_weak_volume_candidate_else_core4": switch(F.col("vol_quality_bucket_score") <= 2, pool, core),
        "cond_strong_industry_core4_else_candidate": switch(industry >= 4, core, pool),
    })


def selection_grid(df: DataFrame, scores: list[str], ks: list[int], date: str = "signal_date") -> DataFrame:
    """Rows picked by every score and every k: one unpivot, one rank, k as a filter."""
    long = df.withColumn("s", F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).cast("double").alias("score")) for s in scores])))
    long = long.select("*", "s.score_name", "s.score").drop("s", *scores)
    w = Window.partitionBy("score_name", date).orderBy(F.col("score").desc_nulls_last(), "vt_symbol")
    top = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(ks))
    return top.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("top_k"))


def daily_by_rule(picked: DataFrame, days: DataFrame, returns: list[str], keys: list[str], date: str = "signal_date") -> DataFrame:
    """Mean return per key, exit rule and day on all candidate days; idle days zero."""
    long = picked.select(*keys, date, F.explode(F.array(*[F.struct(F.lit(c).alias("exit_rule"), F.col(c).alias("r")) for c in returns])).alias("x"))
    daily = long.groupBy(*keys, "x.exit_rule", date).agg(F.avg("x.r").alias("daily_return"))
    grid = daily.select(*keys, "exit_rule").distinct().crossJoin(days.select(date).distinct())  # settings x calendar
    return grid.join(daily, [*keys, "exit_rule", date], "left").na.fill(0.0, ["daily_return"])


def grouped_summary(df: DataFrame, keys: list[str], ret: str) -> DataFrame:
    r = F.col(ret)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((r != 0).cast("double")).alias("trade_day_rate"), F.avg(r).alias("mean"), F.median(r).alias("median"),
        F.percentile(r, 0.1).alias("p10"), F.percentile(r, 0.25).alias("p25"), F.avg((r > 0).cast("double")).alias("win_rate"))


# ----------------------------------------------------------------------- buckets
def bucket(value: Column, edges: list[float], labels: list[str], right_closed: bool = False, missing: str = "unknown") -> Column:
    """Fixed-edge bucket; ``labels`` has one entry more than ``edges``."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(value <= edge if right_closed else value < edge, F.lit(label)).otherwise(out)
    return F.when(safe.finite(value).isNull(), F.lit(missing)).otherwise(out)


# fixed values: bucket edges and names
GAP_EDGES = [-0.03, -0.01, 0.01, 0.03, 0.05]
GAP_LABELS = ["low_open_lt_-3", "small_low_-3_-1", "flat_-1_+1", "small_high_+1_+3", "high_open_+3_+5", "chase_gt_+5"]
PASSING = ("strong_open_break_high", "normal_open_above_close", "small_low_hold_structure")


def open_confirm_fields(df: DataFrame) -> DataFrame:
    """Entry-open buckets; the later rule wins where several hold."""
    o = F.col("entry_open")
    rel = lambda c: safe.safe_div(o, F.col(c)) - 1
    df = df.withColumns({f"open_vs_{c}": rel(c) for c in ("signal_close", "signal_high", "signal_low")})
    g = F.col("open_vs_signal_close")
    yes = lambda c: F.coalesce(c, F.lit(False))
    ok, above_high = yes(F.col("open_executable")), yes(o > F.col("signal_high"))
    rules = [  # last match first
        (ok & (g >= 0.03) & (g < 0.05) & ~above_high, "high_open_watch"),
        (ok & (o >= F.col("signal_low")) & (g >= -0.03) & (g < 0), "small_low_hold_structure"),
        (ok & (o > F.col("signal_close")) & (g >= 0) & (g < 0.03) & ~above_high, "normal_open_above_close"),
        (ok & above_high & (g < 0.05), "strong_open_break_high"),
        (yes(g < -0.03) | yes(o < F.col("signal_low")), "fail_low_or_break_structure"),
        (yes(F.col("entry_limit_up")) | yes(g >= 0.05), "reject_chase_or_limit"),
    ]
    name = F.lit("other_open")
    for cond, label in reversed(rules):
        name = F.when(yes(cond), F.lit(label)).otherwise(name)
    df = df.withColumns({"open_gap_bucket": bucket(g, GAP_EDGES, GAP_LABELS), "open_confirm_bucket": name})
    return df.withColumn("open_confirm_pass", F.col("open_confirm_bucket").isin(*PASSING))


def named_segments(df: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """One row per (event, segment it belongs to); segments may overlap."""
    return df.withColumn("segment", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in segments.items()]))))


def bucket_summary(df: DataFrame, buckets: list[str], hits: list[str], values: list[str]) -> DataFrame:
    """Rates and means per value of every bucket column, from one unpivot."""
    long = df.withColumn("b", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket_name"), F.col(b).cast("string").alias("bucket_value")) for b in buckets])))
    return long.groupBy("b.bucket_name", "b.bucket_value").agg(
        F.count("*").alias("n"), *[F.avg(F.coalesce(F.col(h), F.lit(False)).cast("double")).alias(f"{h}_rate") for h in hits],
        *[F.avg(v).alias(f"{v}_mean") for v in values], *[F.median(v).alias(f"{v}_median") for v in values])


def daily_top_k_summary(df: DataFrame, score: str, ks: list[int], ret: str, date: str = "signal_date") -> DataFrame:
    """Per k: days, mean and compounded return of the daily top-k."""
    picked = selection_grid(df.select(date, "vt_symbol", score, ret), [score], ks, date)
    return daily_summary(equal_weight_daily(picked, ret, date, ("top_k",)), date, ("top_k",))


def day_quality(mean: Column, edges: list[float], labels: list[str]) -> Column:
    return bucket(mean, edges, labels)


def tags(rules: dict[str, Column]) -> Column:
    """Comma-joined names of the conditions that hold."""
    return F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in rules.items()])


# -------------------------------------------------------------------- collectors
def _was_before(recent): return F.coalesce(recent, F.lit(0))


def jumps(bars: np.ndarray, last: float, cooldown: float) -> np.ndarray:
    """Positions taken by the rule 'more than ``cooldown`` after the last one taken' over ascending ``bars``.

    Each position points at the next one that could follow it; the chain from the
    first is laid out by pointer doubling, in a logarithmic number of array steps.
    """
    n = len(bars)
    after = np.append(np.searchsorted(bars, bars + cooldown, side="right"), n)
    tables = [after]
    for _ in range(max(1, n).bit_length()):
        tables.append(tables[-1][tables[-1]])
    chain = np.searchsorted(bars, [last + cooldown], side="right")
    for table in reversed(tables):  # after the table of 2^k steps, the chain holds every 2^k-th place
        chain = np.concatenate([chain, table[chain]])
    chain = np.unique(chain)
    return chain[chain < n]


def pre_start_events(panel: Panel, exhaust_window: int = 10, cooldown: int = 5) -> DataFrame:
    """Near-start events: component flags, exhaustion memory, cooldown, clipped score.

    The panel carries 0/1 columns exhaust_raw, start_raw, strict, false_break_repair,
    panic_pre (which may already use the memory through ``recent_exhaustion``) and
    near_price_break, momentum_pre, rsi_repairing, false_break_low, strong_close,
    vol_not_climax, anti_chase. An event needs a component and more than ``cooldown``
    bars since the last event of its symbol.
    """
    names = ("strict", "false_break_repair", "panic_pre")
    df = panel.with_columns({"recent": recent_exhaustion(exhaust_window), "bar": bar_index() * 1.0})
    any_now = F.greatest(F.col("exhaust_raw"), F.col("recent"))
    parts = sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0))
    df = df.withColumns({"component_count": parts, "candidate": (parts > 0).cast("double"), "exhausted": any_now})

    def kernel(state, pdf):
        bar, wanted = pdf["bar"].to_numpy(float), pdf["candidate"].to_numpy(float) != 0
        at, kept = np.flatnonzero(wanted), np.zeros(len(pdf))
        chosen = jumps(bar[at], state[0], cooldown)
        kept[at[chosen]] = 1.0
        return np.array([bar[at[chosen[-1]]] if len(chosen) else state[0]]), {"kept": kept}

    flagged = state_scan(Panel(df, panel.symbol, panel.time, panel.max_group_rows), kernel, (-1e18,), ["kept"])
    on = lambda c, yes, no=0: F.when(F.col(c) == 1, yes).otherwise(no)
    score = (
        on("exhausted", 20) + on("near_price_break", 16) + on("momentum_pre", 14) + on("rsi_repairing", 12) + on("false_break_low", 10)
        + on("strong_close", 8) + on("vol_not_climax", 8, -12) + on("anti_chase", 6, -8) + F.when(F.col("component_count") >= 2, 6).otherwise(0))
    kind = F.concat_ws("+", *[F.when(F.col(n) == 1, F.lit(n)) for n in names])
    return flagged.where(F.col("kept") == 1).select(
        panel.symbol, panel.time, kind.alias("pre_type"), "component_count", F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("pre_score"))


def recent_exhaustion(window: int):
    """1 where any of the previous ``window`` bars was exhausted."""
    return apply(_was_before, roll("max", col("exhaust_raw"), lo=-window, hi=-1))


def followed_by(panel: Panel, flag: str, days: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per bar: does the flag occur within the next n bars?"""
    exprs = {f"within_{n}": apply(_was_before, roll("max", col(flag), lo=1, hi=n)) for n in days}
    return panel.with_columns(exprs)


def earnings_drift(panel: DataFrame, k: int, time: str = "trade_date") -> DataFrame:
    """Rows where the announcement date changes and is public; next row is the entry.

    Top k by growth per day.
    """
    exprs = {"__before": shift(col("ann_date"), 1), "entry_date": shift(col(time), -1), "entry_open": shift(col("open"), -1)}
    df = Panel(panel, time=time).with_columns(exprs)
    news = F.col("__before").isNotNull() & (F.col("ann_date") != F.col("__before")) & (F.col("ann_date") <= F.col(time)) & F.col("entry_open").isNotNull()
    w = Window.partitionBy(time).orderBy(F.col("growth").desc_nulls_last(), "vt_symbol")
    return df.where(news).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("__before")


def replace_day(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("signal_date", "buy_point_type")) -> DataFrame:
    """Drop the old rows of the new rows' (date, type) and append, aligning columns."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def window_start(days: DataFrame, bars: int, date: str = "trade_date") -> DataFrame:
    """The n-th latest trading date (one row; ``days`` is a calendar)."""
    w = Window.orderBy(F.col(date).desc())
    return days.select(date).distinct().withColumn("__n", F.row_number().over(w)).where(F.col("__n") == bars).select(date)


def signal_day_join(events: DataFrame, panel: DataFrame, flags: dict[str, bool], new_days: int = 60, date: str = "signal_date") -> DataFrame:
    """Attach the signal day's panel row: listing age, new-stock flag, boolean defaults."""
    df = events.join(panel, ["vt_symbol", date], "left")
    age = F.datediff(F.col(date).cast("date"), F.col("list_date").cast("date"))
    out = {"listing_age_days": age, "is_new_stock": F.coalesce(age < new_days, F.lit(False))}
    return df.withColumns(out | {c: F.coalesce(F.col(c), F.lit(d)) for c, d in flags.items()})


def overlay(df: DataFrame, quotes: DataFrame, columns: list[str], key: str = "vt_symbol", newest: str = "quote_time") -> DataFrame:
    """Overwrite columns with the latest quote of the symbol, where there is one."""
    latest = quotes.groupBy(key).agg(F.max_by(F.struct(*columns), newest).alias("__q"))
    joined = df.join(latest, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__q.{c}"), F.col(c)) for c in columns}).drop("__q")


def attach_industry(df: DataFrame, names: DataFrame) -> DataFrame:
    return df.join(names.select("vt_symbol", "industry"), "vt_symbol", "left").withColumn("industry", F.coalesce("industry", F.lit("UNKNOWN")))


def symbol_shards(symbols: DataFrame, shards: int) -> DataFrame:
    """Ordinal of the symbol mod the shard count (one row per symbol)."""
    w = Window.orderBy("vt_symbol")
    return symbols.select("vt_symbol").distinct().withColumn("shard", F.pmod(F.row_number().over(w) - 1, F.lit(shards)))


def event_calendar(events: DataFrame, columns: list[str], name: str = "trade_date") -> DataFrame:
    """Distinct union of date columns with their ordinal."""
    from barloom.plans.intervals import calendar
    return calendar(events.select(F.explode(F.array(*[F.col(c).cast("date") for c in columns])).alias(name)), name)


def attach_index(df: DataFrame, days: DataFrame, date: str, name: str) -> DataFrame:
    return df.join(days.select(F.col("trade_date").alias(date), F.col("day_index").alias(name)), date)
