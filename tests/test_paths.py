"""Event paths meet their bars once and are never moved again."""

from pyspark.sql import functions as F

from barloom.operators import paths
from tests.conftest import same


def all_events(b):
    return b.select(F.concat_ws("|", "vt_symbol", "idx").alias("event_id"), "vt_symbol", F.col("datetime").alias("signal_date"),
                    F.col("high").alias("signal_high"), (F.col("low") * 0.95).alias("stop"), F.lit(None).cast("double").alias("entry_price"))


def test_paths_across_blocks_and_ends(bars):
    b = paths.indexed(bars)
    e = paths.locate(all_events(b), b).select("event_id", "vt_symbol", "entry_idx")
    for first, steps in ((0, 6), (-3, 2), (1, 40)):
        got = paths.event_paths(e, b, steps, first).select("event_id", "step", "close")
        want = e.alias("e").join(b.alias("b"), (F.col("e.vt_symbol") == F.col("b.vt_symbol")) & (F.col("idx") - F.col("entry_idx")).between(first, steps)).select(
            "event_id", (F.col("idx") - F.col("entry_idx")).cast("int").alias("step"), "close")
        same(got, want)


def test_exits_need_no_shuffle_by_event(bars):
    b = paths.indexed(bars.withColumns({"is_limit_up": F.col("close") > 60, "is_limit_down": F.lit(False)} | {c: F.col("close") for c in ("ema_fast", "ema_mid", "rsi", "atr")}))
    e = paths.locate(all_events(b), b)
    rules = [paths.ExitRule("fixed", "fixed", 2), paths.ExitRule("target", "target", 4, 0.02, "stop"), paths.ExitRule("limit", "limit_up", 4, 0.5)]
    exits = paths.simulate_exits(e, b, rules, carry=("signal_date",))
    labels = paths.forward_labels(e, b, (1,), (1,), (0.05,))
    broken = paths.breakout_labels(e, b)
    for df in (exits, labels, broken):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(event_id" not in plan
    fixed = exits.where("exit_rule = 'fixed'").select("event_id", "signal_date", "exit_price", "mfe")
    at = lambda k, c: F.max(F.when(F.col("step") == k, F.col(c)))
    path = paths.event_paths(e.select("event_id", "vt_symbol", "signal_date", "entry_idx"), b, 2)
    want = path.groupBy("event_id", "signal_date").agg(at(2, "close").alias("exit_price"), (F.max("high") / at(0, "open") - 1).alias("mfe")).where("exit_price is not null")
    same(fixed, want)
