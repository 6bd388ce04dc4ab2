"""Ticks to bars, in batch and as Structured Streaming.

Batch: cumulative counters become non-negative differences with ``lag`` over the
panel evaluator (which splits a hot symbol), then windows are plain aggregates.
Stream: the difference needs one previous tick per symbol, kept as state with its
time (one row a symbol, kept for good); windows use a watermark. Policy: a
tick older than one already taken of its symbol is dropped, a counter that goes
down counts as zero, and a minute's first tick sets no extreme but its price.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions.expr import bar_index, col, shift
from barloom.plans.panel import Panel

TICK_STEPS = "vt_symbol string, datetime timestamp, last_price double, volume_step double, turnover_step double, high_hint double, low_hint double, open_interest double"
TICK_STATE = "datetime timestamp, volume double, turnover double, high_price double, low_price double"


def tick_steps(ticks: DataFrame) -> DataFrame:
    """Priced ticks with volume and turnover steps and newly set day extremes."""
    df = Panel(ticks.where(F.coalesce(F.col("last_price"), F.lit(0.0)) != 0)).with_columns({
        "__v": shift(col("volume"), 1), "__t": shift(col("turnover"), 1), "__h": shift(col("high_price"), 1), "__l": shift(col("low_price"), 1)})
    step = lambda now, before: F.when(F.col(before).isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col(now) - F.col(before)))
    return df.withColumns({
        "volume_step": step("volume", "__v"), "turnover_step": step("turnover", "__t"),
        "high_hint": F.when(F.col("high_price") > F.col("__h"), F.col("high_price")),
        "low_hint": F.when(F.col("low_price") < F.col("__l"), F.col("low_price")),
    }).drop("__v", "__t", "__h", "__l")


def minute_bars(ticks: DataFrame) -> DataFrame:
    """One-minute bars from ticks (datetime, last_price, cumulative volume/turnover, day high/low)."""
    df = tick_steps(ticks).withColumn("minute", F.date_trunc("minute", "datetime"))
    first = F.min("datetime").over(Window.partitionBy("vt_symbol", "minute"))  # ticks of one minute
    opening = F.col("datetime") == first
    df = df.withColumns({"high_hint": F.when(~opening, F.col("high_hint")), "low_hint": F.when(~opening, F.col("low_hint"))})
    return df.groupBy("vt_symbol", "minute").agg(
        F.min_by("last_price", "datetime").alias("open"), F.greatest(F.max("last_price"), F.max("high_hint")).alias("high"),
        F.least(F.min("last_price"), F.min("low_hint")).alias("low"), F.max_by("last_price", "datetime").alias("close"),
        F.sum("volume_step").alias("volume"), F.sum("turnover_step").alias("turnover"), *_last_interest(df),
    ).withColumnRenamed("minute", "datetime")


def _last_interest(df: DataFrame) -> list[Column]:
    """Open interest is that of the last tick or bar, where the input has it."""
    return [F.max_by("open_interest", "datetime").alias("open_interest")] if "open_interest" in df.columns else []


def open_bars(bars: DataFrame) -> DataFrame:
    """The bar each symbol is still in: its last one, to be flushed when a feed ends."""
    last = bars.groupBy("vt_symbol").agg(F.max("datetime").alias("datetime"))
    return bars.join(last, ["vt_symbol", "datetime"], "left_semi")


def merge_bars(bars: DataFrame, bucket: Column, name: str = "datetime") -> DataFrame:
    """Combine bars of one bucket: first open, extremes, last close, summed flows."""
    return bars.withColumn("__bucket", bucket).groupBy("vt_symbol", "__bucket").agg(
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"), *_last_interest(bars),
    ).withColumnRenamed("__bucket", name)


def window_bars(bars: DataFrame, minutes: int) -> DataFrame:
    """n-minute bars (n divides 60): tumbling windows aligned to the hour."""
    return merge_bars(bars, F.window("datetime", f"{minutes} minutes")["start"])


def boundary_bars(bars: DataFrame, minutes: int) -> DataFrame:
    """n-minute bars that close only on a bar whose minute + 1 is a multiple of n;
    if that bar is missing, the bar runs on to the next boundary."""
    from barloom.functions.expr import running
    closes = bars.withColumn("__c", ((F.minute("datetime") + 1) % minutes == 0).cast("int"))
    counted = Panel(closes).with_columns({"__n": running("sum", col("__c"))})
    part = F.col("__n") - F.col("__c")
    merged = merge_bars(counted.withColumn("__p", part), F.struct("__p", F.lit(0).alias("z")), "__key")
    starts = counted.withColumn("__p", part).groupBy("vt_symbol", "__p").agg(
        F.min("datetime").alias("datetime"), F.max("__c").alias("closed"))
    out = merged.withColumn("__p", F.col("__key.__p")).drop("__key").join(starts, ["vt_symbol", "__p"])
    return out.where("closed = 1").drop("__p", "closed")


def hour_bars(bars: DataFrame) -> DataFrame:
    return merge_bars(bars, F.date_trunc("hour", "datetime"))


def n_hour_bars(hours: DataFrame, n: int) -> DataFrame:
    """Groups of n completed hours, counted per symbol rather than by the clock."""
    numbered = Panel(hours).with_columns({"__i": bar_index()}).withColumn("__g", F.floor(F.col("__i") / n))
    merged = merge_bars(numbered, F.col("__g"), "group_no")
    span = numbered.groupBy("vt_symbol", F.col("__g").alias("group_no")).agg(F.min("datetime").alias("datetime"), F.count("*").alias("hours"))
    return merged.join(span, ["vt_symbol", "group_no"]).where(F.col("hours") == n).drop("group_no", "hours")


def session_bars(bars: DataFrame, daily_end: str = "15:00:00") -> DataFrame:
    """Daily bars whose session ends at ``daily_end``; later bars belong to the next day."""
    late = F.date_format("datetime", "HH:mm:ss") > daily_end
    day = F.when(late, F.date_add(F.to_date("datetime"), 1)).otherwise(F.to_date("datetime"))
    return merge_bars(bars, day, "trade_date")


# ------------------------------------------------------------------- streaming
def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Steps of one symbol against its previous tick; the tick is the state."""
    last = state.get if state.exists else None
    frame = pd.concat(list(batches)).sort_values("datetime", kind="stable")
    frame = frame[frame["last_price"].fillna(0.0) != 0.0]
    if last is not None:
        frame = frame[frame["datetime"] >= pd.Timestamp(last[0])]
    if frame.empty:
        return
    cols = ["datetime", "volume", "turnover", "high_price", "low_price"]
    before = frame[cols].shift(1)
    if last is not None:
        before.iloc[0] = [pd.Timestamp(last[0]), *last[1:]]
    inside = frame["datetime"].dt.floor("min") == pd.to_datetime(before["datetime"]).dt.floor("min")
    out = pd.DataFrame({
        "vt_symbol": key[0], "datetime": frame["datetime"], "last_price": frame["last_price"],
        "volume_step": (frame["volume"] - before["volume"].astype(float)).clip(lower=0.0).fillna(0.0),
        "turnover_step": (frame["turnover"] - before["turnover"].astype(float)).clip(lower=0.0).fillna(0.0),
        "high_hint": frame["high_price"].where((frame["high_price"] > before["high_price"].astype(float)) & inside),
        "low_hint": frame["low_price"].where((frame["low_price"] < before["low_price"].astype(float)) & inside),
        "open_interest": frame["open_interest"] if "open_interest" in frame else None,
    })
    end = frame[cols].iloc[-1]
    state.update((end["datetime"].to_pydatetime(), *(float(v) for v in end.iloc[1:])))
    yield out


def stream_minute_bars(ticks: DataFrame, lateness: str = "2 minutes") -> DataFrame:
    """Streaming minute bars: state for the counters, then a watermarked window.

    ``ticks.datetime`` must be a timestamp. Append mode emits a bar once its minute
    is older than the watermark; update mode shows the current bar as well.
    """
    steps = ticks.groupBy("vt_symbol").applyInPandasWithState(
        _carry, TICK_STEPS, TICK_STATE, "append", GroupStateTimeout.NoTimeout)
    bars = steps.withWatermark("datetime", lateness).groupBy("vt_symbol", F.window("datetime", "1 minute")).agg(
        F.min_by("last_price", "datetime").alias("open"), F.greatest(F.max("last_price"), F.max("high_hint")).alias("high"),
        F.least(F.min("last_price"), F.min("low_hint")).alias("low"), F.max_by("last_price", "datetime").alias("close"),
        F.sum("volume_step").alias("volume"), F.sum("turnover_step").alias("turnover"), F.max_by("open_interest", "datetime").alias("open_interest"))
    if "open_interest" not in ticks.columns:
        bars = bars.drop("open_interest")
    return bars.select("vt_symbol", F.col("window.start").alias("datetime"), *(c for c in bars.columns if c not in ("vt_symbol", "window")))


def stream_window_bars(bars: DataFrame, minutes: int, lateness: str = "2 minutes") -> DataFrame:
    """n-minute bars from a stream of minute bars."""
    out = bars.withWatermark("datetime", lateness).groupBy("vt_symbol", F.window("datetime", f"{minutes} minutes")).agg(
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"))
    return out.select("vt_symbol", F.col("window.start").alias("datetime"), "open", "high", "low", "close", "volume", "turnover")


def record(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Append a stream to Parquet; ``every`` sets a timer, else all available data is taken."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
