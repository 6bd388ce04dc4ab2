"""Event paths and exit rules: every (event, bar offset) once, rules as aggregates.

Bars get their position inside the symbol; an event asks for its positions by
block, so bars and events meet in an equi join on (symbol, block of positions) and no
task sees a whole symbol. What follows groups by (symbol, block, event) and needs no
shuffle of its own. Path windows hold one event's few bars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import safe
from barloom.functions.expr import Expr, apply, bar_index, close, col, high, low, per_symbol, shift
from barloom.functions.ta import ewm
from barloom.operators.portfolio import net_return
from barloom.plans.panel import Panel
from barloom.session import durable


BLK = "__blk"
#: One event's path, clustered as the join leaves it.
PATH = ["vt_symbol", BLK, "event_id"]


def indexed(bars: DataFrame, time: str = "datetime", exprs: dict[str, Expr] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Bars with their position, the next bar's open and the symbol's last position.

    ``exprs`` are more columns of the same pass over the bars, ``keep`` the bar columns that stay.
    """
    keep = [c for c in (bars.columns if keep is None else keep) if c not in (time, "vt_symbol")]
    df = Panel(bars, time=time).with_columns(
        (exprs or {}) | {"idx": bar_index(), "__next": shift(col("open"), -1), "__rows": per_symbol("count", 1)}, keep=keep)
    # events meet these rows twice (location, path): materialise once
    return durable(df.withColumns({"last_idx": F.col("__rows") - 1, "next_open": F.coalesce("__next", "open")}).drop("__next", "__rows"))


def _paths(events: DataFrame, bars: DataFrame, steps: int, first: int = 0) -> DataFrame:
    """``event_paths``, clustered by symbol and block.

    An event is in the block of its first position. A bar is in its own block and, if a path
    of the block before may reach it, in that one: every pair meets once, and neither side is
    moved once per step.
    """
    span = steps - first
    block = lambda position: F.floor(position / F.lit(max(16, 4 * (span + 1))))
    shared = [c for c in events.columns if c in bars.columns and c != "vt_symbol"]
    asked = events.drop(*shared).withColumn(BLK, block(F.col("entry_idx") + first))
    near = bars.withColumn(BLK, F.explode(F.sequence(block(F.col("idx") - span), block(F.col("idx")))))
    step = (F.col("idx") - F.col("entry_idx")).cast("int")
    return asked.join(near, ["vt_symbol", BLK]).withColumn("step", step).where(F.col("step").between(first, steps))


def event_paths(events: DataFrame, bars: DataFrame, steps: int, first: int = 0) -> DataFrame:
    """One row per event and bar ``first..steps`` after its entry position.

    ``events``: event_id, vt_symbol, entry_idx, ...; ``bars``: output of ``indexed``.
    """
    return _paths(events, bars, steps, first).drop(BLK)


def _with_entry_open(path: DataFrame) -> DataFrame:
    """The open of the entry bar on every row; paths without that bar go."""
    so_far = Window.partitionBy(*PATH).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return path.withColumns({"entry_open": F.first("open").over(so_far), "__from": F.first("step").over(so_far)}).where("__from = 0").drop("__from")


def locate(events: DataFrame, bars: DataFrame, date: str = "signal_date", lag: int = 1, time: str = "datetime") -> DataFrame:
    """Add entry_idx: the position ``lag`` bars after the event's date."""
    at = bars.select("vt_symbol", F.col(time).alias(date), (F.col("idx") + lag).alias("entry_idx"), "last_idx")
    return events.join(at, ["vt_symbol", date])


# --------------------------------------------------------------- forward labels
_BARS = ["vt_symbol", "idx", "open", "high", "low", "close"]


def forward_labels(events: DataFrame, bars: DataFrame, fixed=(1, 3, 5), horizons=(1, 3, 5), levels=(0.03, 0.05),
                   open_rate: float = 0.0, close_rate: float = 0.0) -> DataFrame:
    """Next-open entry: fixed returns, MFE/MAE, target hits and days by horizon, completeness.

    ``events`` carry event_id, vt_symbol, entry_idx, last_idx.
    """
    top = max(*fixed, *horizons, 5)
    path = _with_entry_open(_paths(events.select("event_id", "vt_symbol", "entry_idx"), bars.select(*_BARS, "last_idx"), top))
    at = lambda c, k: F.max(F.when(F.col("step") == k, F.col(c)))
    o = F.max("entry_open")
    full = lambda h: F.max("entry_idx") + h <= F.max("last_idx")
    aggs = [o.alias("entry_open"), net_return(o, at("close", 0), open_rate, close_rate).alias("fixed_0d_net_return")]
    for h in fixed:
        aggs += [full(h).alias(f"has_full_{h}d"),
                 F.when(full(h), net_return(o, at("close", h), open_rate, close_rate)).alias(f"fixed_{h}d_net_return")]
    for h in horizons:
        inside = F.col("step") <= h
        aggs += [full(h).alias(f"has_path_{h}d"),
                 F.when(full(h), safe.safe_div(F.max(F.when(inside, F.col("high"))), o) - 1).alias(f"mfe_{h}d"),
                 F.when(full(h), safe.safe_div(F.min(F.when(inside, F.col("low"))), o) - 1).alias(f"mae_{h}d")]
        for level in levels:
            tag = int(round(level * 100))
            hit = F.min(F.when(inside & (F.col("high") >= F.col("entry_open") * (1 + level)), F.col("step")))
            aggs += [(full(h) & hit.isNotNull()).alias(f"tp{tag}_hit_{h}d"), F.when(full(h), hit).alias(f"days_to_tp{tag}_{h}d")]
    timeout = net_return(o, F.max_by("close", F.when(F.col("step") <= 5, F.col("step"))), open_rate, close_rate)
    aggs.append(timeout.alias("timeout_5d_net_return"))
    for level in levels:
        tag = int(round(level * 100))
        hit = F.min(F.when(F.col("step").between(1, 5) & (F.col("high") >= F.col("entry_open") * (1 + level)), F.col("step")))
        aggs += [hit.isNotNull().alias(f"plan_tp{tag}_hit"), F.when(hit.isNotNull(), net_return(o, o * (1 + level), open_rate, close_rate))
                 .otherwise(timeout).alias(f"tp{tag}_plan_net_return_5d")]
    return path.groupBy(*PATH).agg(*aggs).drop("vt_symbol", BLK)


def breakout_labels(events: DataFrame, bars: DataFrame, levels=(0.03, 0.05), horizon: int = 3, open_rate: float = 0.0,
                    close_rate: float = 0.0) -> DataFrame:
    """Break-out entries: target against a close below the signal high or a low stop,
    the latter with the stop or the target first on the same bar.

    ``events``: event_id, vt_symbol, entry_idx, signal_high. Long form, one row per rule.
    """
    path = _with_entry_open(_paths(events.select("event_id", "vt_symbol", "entry_idx", "signal_high"), bars.select(*_BARS), horizon))
    stop = F.col("signal_high") * 0.995
    rules = {}
    for level in levels:
        tag = int(round(level * 100))
        target = F.col("entry_open") * (1 + level)
        win = (F.col("high") >= target, target, F.lit(f"tp{tag}"))
        fade = (F.col("close") < F.col("signal_high"), F.col("close"), F.lit("close_below_signal_high"))
        cut = (F.col("low") <= stop, stop, F.lit("low_break_signal_high"))
        rules |= {f"close_fail_tp{tag}": (win, fade), f"low_fail_stop_first_tp{tag}": (cut, win), f"low_fail_tp_first_tp{tag}": (win, cut)}
    last = F.max(F.struct("step", F.col("close").alias("price"), F.lit("timeout").alias("reason")))
    aggs = []
    for name, (a, b) in rules.items():
        hit = F.when(a[0], F.struct("step", a[1].alias("price"), a[2].alias("reason"))).when(
            b[0], F.struct("step", b[1].alias("price"), b[2].alias("reason")))
        aggs.append(F.coalesce(F.min(hit), last).alias(name))
    wide = path.groupBy(*PATH).agg(F.max("entry_open").alias("entry_open"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("x")) for n in rules]))
    return wide.select("event_id", "entry_open", rows.alias("r")).select(
        "event_id", F.col("r.rule").alias("rule"), F.col("r.x.reason").alias("exit_reason"), F.col("r.x.step").alias("exit_day"),
        net_return(F.col("entry_open"), F.col("r.x.price"), open_rate, close_rate).alias("net_return"))


# ------------------------------------------------------------------- exit rules
@dataclass(frozen=True)
class ExitRule:
    """One exit policy. ``kind``: fixed, target, limit_up, protect, confirm3."""

    name: str
    kind: str
    max_bars: int
    target: float | None = None
    stop: str | None = None  # event column with a stop price
    min_exit_bars: int = 1
    trigger: float = 0.03
    trail_atr: float = 2.5
    floor: float = 0.002


def _end(price: Column, reason: str, at: Column) -> Column:
    """An exit seen on this bar, made on it or on the next."""
    at = at.cast("int")
    return F.struct(F.col("step").alias("step"), at.alias("exit_step"), price.alias("price"), F.lit(reason).alias("reason"),
                    F.when(at == F.col("step"), F.col("__here")).otherwise(F.col("__after")).alias("state"))


def _rule_hit(rule: ExitRule) -> Column:
    """Struct (step, exit_step, price, reason, state at the exit) where a bar ends the trade, else null."""
    step, last = F.col("step"), F.least(F.lit(rule.max_bars), F.col("avail"))
    entry = F.col("entry_price")
    here = lambda cond, price, reason, at=None: F.when(cond, _end(price, reason, step if at is None else at))
    inside = step <= last
    after = F.least(step + 1, F.col("avail"))
    target = entry * (1 + rule.target) if rule.target is not None else None
    if rule.kind == "target":
        live = inside & (step >= F.least(F.lit(rule.min_exit_bars), last))
        hits = [] if rule.stop is None else [here(live & (F.col("low") <= F.col(rule.stop)), F.col(rule.stop), "stop_priority")]
        return F.coalesce(*hits, here(live & (F.col("high") >= target), target, "target_hit"))
    if rule.kind == "limit_up":
        hits = [] if target is None else [here(inside & (step >= rule.min_exit_bars) & (F.col("high") >= target), target, "target_hit")]
        capped = F.least(step + 1, last)
        price = F.when(step + 1 <= last, F.col("next_open")).otherwise(F.col("open"))
        return F.coalesce(*hits, here(inside & F.col("is_limit_up") & (step < F.col("avail")), price, "limit_up_next_open", capped))
    live = inside & (step >= 1)
    reason = "wide_stop" if rule.kind == "confirm3" else "disaster_stop"
    hits = [] if rule.stop is None else [here(live & (F.col("low") <= F.col(rule.stop)), F.col(rule.stop), reason)]
    hits.append(here(live & (F.col("high") >= target), target, "target_hit"))
    trail = F.coalesce(safe.finite(F.col("run_high1") - F.col("atr") * rule.trail_atr), entry * (1 + rule.floor))
    guard = F.greatest(entry * (1 + rule.floor), trail)
    armed = F.col("run_high1") >= entry * (1 + rule.trigger)
    hits.append(here(live & armed & (F.col("close") < guard), F.col("next_open"), "profit_protect", after))
    if rule.kind == "confirm3":
        hits.append(here(live & (step >= 3) & ~F.col("confirmed_so_far"), F.col("next_open"), "unconfirmed_3d_exit", after))
    return F.coalesce(*hits)


def simulate_exits(events: DataFrame, bars: DataFrame, rules: list[ExitRule], open_rate: float = 0.0, close_rate: float = 0.0,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """Every event under every rule: exit bar, reason, returns, MFE/MAE and limit states.

    ``events``: event_id, vt_symbol, entry_idx, entry_price (null: entry open), signal_high and
    any stop columns; ``bars``: ``indexed`` bars with is_limit_up, is_limit_down, and ema_fast,
    ema_mid, rsi, atr for the protecting rules. Bars are joined once for all rules.
    ``carry`` names event columns that the result keeps.
    """
    top = max(r.max_bars for r in rules) + 1
    path = _with_entry_open(_paths(events, bars, top))
    given = safe.finite(F.col("entry_price"))
    path = path.withColumns({
        "entry_price": F.when(given > 0, given).otherwise(F.col("entry_open")), "avail": F.col("last_idx") - F.col("entry_idx")})
    # an event's path is at most top + 1 rows
    along = Window.partitionBy(*PATH).orderBy("step")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    later = F.col("step") >= 1
    confirm = later & ((F.col("close") > F.col("signal_high")) | ((F.col("close") > F.col("ema_fast")) & (F.col("rsi") >= 50.0)) | (F.col("close") > F.col("ema_mid")))
    path = path.withColumns({
        "run_high": F.max("high").over(so_far), "run_low": F.min("low").over(so_far),
        "run_high1": F.greatest(F.col("entry_price"), F.max(F.when(later, F.col("high"))).over(so_far)),
        "limit_up_seen": F.max(F.col("is_limit_up").cast("int")).over(so_far) == 1,
        "limit_down_seen": F.max(F.col("is_limit_down").cast("int")).over(so_far) == 1,
        "confirmed_so_far": F.coalesce(F.max(confirm.cast("int")).over(so_far) == 1, F.lit(False)),
    }).withColumn("__here", F.struct("run_high", "run_low", "limit_up_seen", "limit_down_seen"))
    path = path.withColumn("__after", F.lead("__here").over(along))  # an exit is made on its bar or the next
    outcome = []
    for r in rules:
        last = F.least(F.lit(r.max_bars), F.col("avail"))
        if r.kind == "fixed":
            found = F.min(F.when(F.col("step") == r.max_bars, _end(F.col("close"), f"fixed_{r.max_bars}d_close", F.col("step"))))
        else:
            ending = F.min(F.when(F.col("step") == last, _end(F.col("close"), "timeout", F.col("step"))))
            found = F.when(F.max("avail") > 0, F.coalesce(F.min(_rule_hit(r)), ending))
        outcome.append(found.alias(r.name))
    wide = path.groupBy(*PATH).agg(F.max("entry_price").alias("entry_price"), *[F.max(c).alias(c) for c in carry], *outcome)
    rows = F.explode(F.array(*[F.struct(F.lit(r.name).alias("exit_rule"), F.col(r.name).alias("x")) for r in rules]))
    out = wide.select("event_id", *carry, "entry_price", rows.alias("r")).where(F.col("r.x.state").isNotNull()).select(
        "event_id", *carry, "entry_price", F.col("r.exit_rule").alias("exit_rule"), F.col("r.x.exit_step").alias("step"),
        F.col("r.x.price").alias("exit_price"), F.col("r.x.reason").alias("exit_reason"), "r.x.state.*")
    return out.select(
        "event_id", *carry, "exit_rule", "exit_reason", F.col("step").alias("holding_bars"), "entry_price", "exit_price",
        (safe.safe_div(F.col("exit_price"), F.col("entry_price")) - 1).alias("gross_return"),
        net_return(F.col("entry_price"), F.col("exit_price"), open_rate, close_rate).alias("net_return"),
        (safe.safe_div(F.col("run_high"), F.col("entry_price")) - 1).alias("mfe"),
        (safe.safe_div(F.col("run_low"), F.col("entry_price")) - 1).alias("mae"),
        "limit_up_seen", "limit_down_seen", (F.col("exit_reason") == "target_hit").alias("target_hit"),
        F.col("exit_reason").isin("stop_priority", "disaster_stop", "wide_stop").alias("stop_hit"))


def exit_summary(exits: DataFrame) -> DataFrame:
    """Per rule: count, mean, quantiles, hit rates, holding time."""
    return exits.groupBy("exit_rule").agg(
        F.count("*").alias("trades"), F.avg("net_return").alias("mean_return"), F.percentile("net_return", 0.1).alias("p10"),
        F.median("net_return").alias("median_return"), F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"),
        F.avg(F.col("target_hit").cast("double")).alias("target_rate"), F.avg("holding_bars").alias("avg_bars"))


def reason_shares(exits: DataFrame) -> DataFrame:
    rows = exits.groupBy("exit_rule", "exit_reason").agg(F.count("*").alias("n"), F.avg("net_return").alias("mean_return"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("exit_rule")))


def zero_filled_curve(exits: DataFrame, days: DataFrame, date: str = "signal_date") -> DataFrame:
    """Daily mean return per rule on the whole calendar, idle days at zero, compounded."""
    daily = exits.groupBy("exit_rule", date).agg(F.avg("net_return").alias("ret"))
    grid = exits.select("exit_rule").distinct().crossJoin(days.select(date))  # rules x calendar
    full = grid.join(daily, ["exit_rule", date], "left").na.fill(0.0, ["ret"])
    w = Window.partitionBy("exit_rule").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("equity", F.product(1.0 + F.col("ret")).over(w))


def path_indicators(fast: int = 20, mid: int = 60, n: int = 14) -> dict[str, Expr]:
    """Exponential means of the close, RSI and ATR that adaptive exits read, seeded with their first value.

    Gains, losses and true ranges are smoothed with 1/n; a value shows after as many
    bars as its window. The first bar has no gain, and its true range is its own span.
    """
    step, before = close - shift(close, 1), shift(close, 1)
    wilder = lambda x: ewm(x, 1.0 / n, n)
    return {"ema_fast": ewm(close, 2.0 / (fast + 1), fast), "ema_mid": ewm(close, 2.0 / (mid + 1), mid),
            "rsi": apply(_strength, wilder(apply(_gain, step)), wilder(apply(_gain, -step))), "atr": wilder(apply(_true_range, high, low, before))}


def _gain(step): return F.when(step > 0, step).when(step <= 0, F.lit(0.0))
def _strength(up, down): return 100.0 - safe.safe_div(F.lit(100.0), 1.0 + safe.safe_div(up, down))
def _true_range(h, l, before): return F.greatest(h - l, F.abs(h - before), F.abs(l - before))
