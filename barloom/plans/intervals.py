"""Interval joins, calendars and gaps-and-islands as plain DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, on: str, time: str, start: str, end: str,
                  how: str = "inner", right_on: str | None = None) -> DataFrame:
    """Rows of ``left`` with the ``right`` intervals (inclusive ends) that hold them.

    Both sides get a year bucket, so the join is an equi join on (key, year) plus a
    range check: a hot key spreads over its years and no cross product is built.
    Overlapping intervals give one row each. A null end is open.
    """
    right_on = right_on or on
    years = left.agg(F.min(F.year(time)).alias("__y0"), F.max(F.year(time)).alias("__y1"))
    first = F.greatest(F.year(start), F.col("__y0"))
    last = F.least(F.coalesce(F.year(end), F.col("__y1")), F.col("__y1"))
    spread = (
        right.crossJoin(F.broadcast(years))  # one row: the span of the left side
        .where(first <= last)
        .withColumn("__bucket", F.explode(F.sequence(first, last)))
        .drop("__y0", "__y1")
        .withColumnRenamed(right_on, "__key").withColumnRenamed(start, "__from").withColumnRenamed(end, "__to")
    )
    rows = left.withColumn("__year", F.year(time))
    match = (
        (F.col(on) == F.col("__key")) & (F.col("__year") == F.col("__bucket"))
        & (F.col(time) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(time) <= F.col("__to")))
    )
    joined = rows.join(spread, match, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__year")
    return joined.drop("__year", "__key", "__bucket").withColumnsRenamed({"__from": start, "__to": end})


def calendar(df: DataFrame, time: str, index: str = "day_index") -> DataFrame:
    """Distinct dates with a zero-based ordinal. One row per date, so one ordered task is small."""
    return df.select(time).where(F.col(time).isNotNull()).distinct().withColumn(
        index, (F.row_number().over(Window.orderBy(time)) - 1).cast("long")
    )


def islands(points: DataFrame, days: DataFrame, key: str, time: str, index: str = "day_index",
            start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Merge points that are neighbours on the calendar ``days`` into intervals.

    (key, date) is unique, so a key's window holds at most one calendar.
    """
    placed = points.select(key, time).distinct().join(days.select(time, index), time)
    run = F.col(index) - F.row_number().over(Window.partitionBy(key).orderBy(index))
    return placed.withColumn("__run", run).groupBy(key, "__run").agg(
        F.min(time).alias(start), F.max(time).alias(end), F.count("*").alias("interval_days")
    ).drop("__run")


def expand(intervals: DataFrame, days: DataFrame | None, key: str, time: str = "trade_date",
           start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """One row per (key, day) inside each interval; calendar days when ``days`` is None."""
    if days is None:
        return intervals.select(key, F.explode(F.sequence(start, end)).alias(time)).distinct()
    spans = ordinals(intervals, days, time, start, end)
    spread = spans.select(key, F.explode(F.sequence("__first", "__last")).alias("day_index"))
    return spread.join(calendar(days, time), "day_index").select(key, time).distinct()


def ordinals(intervals: DataFrame, days: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Intervals that hold a calendar day, with the ordinals of their first and last one.

    Every distinct date of either side is one row of one ordered pass, and the
    intervals meet it by equality on their two ends.
    """
    marks = days.select(F.col(time).alias("__d"), F.lit(1).alias("__n")).where("__d IS NOT NULL").distinct().unionByName(
        intervals.select(F.explode(F.array(start, end)).alias("__d"), F.lit(0).alias("__n")).where("__d IS NOT NULL").distinct())
    dates = marks.groupBy("__d").agg(F.max("__n").alias("__n"))  # one row a date
    upto = dates.select("__d", "__n", F.sum("__n").over(Window.orderBy("__d")).alias("__upto"))
    first = upto.select(F.col("__d").alias(start), (F.col("__upto") - F.col("__n")).alias("__first"))
    last = upto.select(F.col("__d").alias(end), (F.col("__upto") - 1).alias("__last"))
    return intervals.join(first, start).join(last, end).where("__first <= __last")


def covering(points: DataFrame, ranges: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """``points`` with the columns of the earliest-starting range of their key that holds their time (none: nulls).

    Among ranges sorted by start only those whose end is beyond all earlier ends can
    be first to hold a point, and only past those ends: so cut, they do not overlap,
    and a point meets one at most. The cut ranges bound their own year buckets, so
    the points are read once and a hot key spreads over its years.
    """
    rest = [c for c in ranges.columns if c not in (key, start, end)]
    before = Window.partitionBy(key).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = ranges.where(F.col(start) <= F.col(end)).withColumn("__reach", F.max(end).over(before))
    leaders = known.where(F.col("__reach").isNull() | (F.col(end) > F.col("__reach"))).select(
        F.col(key).alias("__key"), F.col("__reach"), F.explode(F.sequence(F.year(F.greatest(start, F.coalesce("__reach", start))), F.year(end))).alias("__bucket"),
        *[F.col(c).alias(c if c in rest else f"__{c}") for c in (start, end, *rest)])
    rows = points.withColumn("__year", F.year(time))
    hit = ((F.col(key) == F.col("__key")) & (F.col("__year") == F.col("__bucket")) & F.col(time).between(F.col(f"__{start}"), F.col(f"__{end}"))
           & (F.col("__reach").isNull() | (F.col(time) > F.col("__reach"))))
    return rows.join(leaders, hit, "left").select(*points.columns, F.col(f"__{start}").alias(start), F.col(f"__{end}").alias(end), *rest)


def subtract_intervals(wanted: DataFrame, taken: DataFrame, days: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """Maximal runs of calendar days that ``wanted`` intervals hold and ``taken`` ones do not.

    A sweep of +1 and -1 bounds per key with running sums: between two bounds the
    state does not change, so no interval is expanded into its days.
    """
    def bounds(df: DataFrame, kind: int) -> DataFrame:
        spans = ordinals(df.select(key, start, end), days, time, start, end)
        return spans.select(key, F.explode(F.array(
            F.struct(F.col("__first").alias("at"), F.lit(1).alias("step")), F.struct((F.col("__last") + 1).alias("at"), F.lit(-1).alias("step")))).alias("b")).select(
                key, "b.at", *[(F.col("b.step") if k == kind else F.lit(0)).alias(n) for k, n in enumerate(("want", "have"))])

    order = Window.partitionBy(key).orderBy("at")
    steps = bounds(wanted, 0).unionByName(bounds(taken, 1)).groupBy(key, "at").agg(F.sum("want").alias("want"), F.sum("have").alias("have"))
    state = steps.select(key, "at", ((F.sum("want").over(order) > 0) & (F.sum("have").over(order) == 0)).alias("on"))
    # rows that keep the state do not start or end a run
    turns = state.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).where(F.col("on") != F.col("was"))
    runs = turns.withColumn("until", F.lead("at").over(order)).where("on").select(key, "at", (F.col("until") - 1).alias("upto"))
    cal = calendar(days, time)
    return runs.join(cal.select(F.col("day_index").alias("at"), F.col(time).alias(start)), "at").join(
        cal.select(F.col("day_index").alias("upto"), F.col(time).alias(end)), "upto").select(key, start, end)


def lead_intervals(df: DataFrame, key: str, start: str, end: str, last: Column | None = None) -> DataFrame:
    """Close each row one day before the key's next start; ``last`` ends the open row."""
    following = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    closed = F.date_sub(following, 1)
    return df.withColumn(end, closed if last is None else F.coalesce(closed, last))
