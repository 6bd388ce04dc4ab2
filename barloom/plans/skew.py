"""Group-size checks and the exact split of groups too large for one task.

A symbol or a date may hold a large share of the panel. Before a plan puts a
whole group in one task, ``oversized`` bounds the largest group; past the bound
the callers in ``barloom.plans.panel`` switch to block-wise plans built here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import durable

# A group of this many rows is the most one task is asked to hold.
MAX_GROUP_ROWS = 2_000_000
# Inputs whose plan statistics stay under this many bytes need no measuring.
SMALL_INPUT_BYTES = 256 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """Size of ``df`` in Catalyst's statistics, or None where unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # Spark Connect has no JVM handle: measure instead
        return None


def oversized(df: DataFrame, keys: list[str], limit: int | None = None) -> dict[str, bool]:
    """For each key column: does any of its groups exceed the row limit?"""
    bound = MAX_GROUP_ROWS if limit is None else limit
    if limit is None:
        size = estimated_bytes(df)
        if size is not None and size <= SMALL_INPUT_BYTES:
            return {k: False for k in keys}
    # one pass over the rows for all keys
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.xxhash64(k).alias("hash")) for k in keys]))
    sizes = df.select(value.alias("g")).groupBy("g").count().groupBy("g.key").agg(F.max("count").alias("top"))
    tops = {row["key"]: row["top"] for row in sizes.collect()}
    return {k: tops.get(k, 0) > bound for k in keys}


def with_row_index(df: DataFrame, symbol: str, time: str, block: int, name: str) -> DataFrame:
    """Add each row's zero-based position inside its symbol without one task per symbol.

    Time is cut into equal chunks (deterministic from the measured range), rows are
    numbered inside (symbol, chunk), and chunk counts give the offsets.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    span = df.groupBy(symbol).agg(
        F.min(micros).alias("__lo"), F.max(micros).alias("__hi"), F.count("*").alias("__n")
    )
    span = durable(span)
    chunks = F.ceil(F.col("__n") / F.lit(float(block))) * 4
    width = F.greatest(F.lit(1), F.ceil((F.col("__hi") - F.col("__lo") + 1) / chunks)).cast("long")
    cut = df.join(span.select(symbol, "__lo", width.alias("__w")), symbol).withColumn(
        "__chunk", F.floor((micros - F.col("__lo")) / F.col("__w"))
    ).drop("__lo", "__w")
    before = Window.partitionBy(symbol).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(symbol, "__chunk").count().select(
        symbol, "__chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__off")
    )
    inside = Window.partitionBy(symbol, "__chunk").orderBy(time)
    return (
        cut.join(offsets, [symbol, "__chunk"])
        .withColumn(name, (F.col("__off") + F.row_number().over(inside) - 1).cast("long"))
        .drop("__chunk", "__off")
    )


def value_counts(df: DataFrame, group: str, value: str, block: int) -> DataFrame:
    """(group, value, count, rows before the value) without one task per group.

    Equal values are merged first, so a value shared by many rows is one row here.
    Approximate quantiles only choose cut points; the counts are exact.
    """
    distinct = durable(
        df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__cnt"))
    )
    sizes = distinct.groupBy(group).agg(F.count("*").alias("__d"))
    parts = max(1, -(-(sizes.agg(F.max("__d")).first()[0] or 1) // max(1, block // 4)))
    qs = [i / parts for i in range(1, parts)]
    if qs:
        cuts = durable(
            distinct.groupBy(group).agg(F.percentile_approx(value, qs, 20 * parts).alias("__cuts"))
        )
        bucketed = distinct.join(cuts, group).withColumn(
            "__bucket", F.size(F.filter("__cuts", lambda c: c < F.col(value)))
        ).drop("__cuts")
    else:
        bucketed = distinct.withColumn("__bucket", F.lit(0))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(group, "__bucket").agg(F.sum("__cnt").alias("__s")).select(
        group, "__bucket", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off")
    )
    inside = Window.partitionBy(group, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return bucketed.join(offsets, [group, "__bucket"]).select(
        group, value, "__cnt",
        (F.col("__off") + F.coalesce(F.sum("__cnt").over(inside), F.lit(0))).alias("__before"),
    )
