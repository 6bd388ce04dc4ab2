"""Latest-state tables, position ledgers and enrichment, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import Expr, apply, col, running
from barloom.plans.panel import Panel

# fixed values: order states that are still working
ACTIVE = ("submitting", "nottraded", "parttraded")


def latest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Last event per key. On a stream this runs in update mode."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), time).alias("__row")).select(*keys, "__row.*")


def active_orders(orders: DataFrame, key: str = "orderid", time: str = "datetime") -> DataFrame:
    return latest(orders, [key], time).where(F.col("status").isin(*ACTIVE))


def enrich(stream: DataFrame, contracts: DataFrame, key: str = "vt_symbol") -> DataFrame:
    """Stream-static left join with contract data; Spark broadcasts it if it is small."""
    return stream.join(contracts, key, "left")


def _excess(total, low): return total - F.least(F.lit(0.0), low)
def _only_clamped(flag, total): return F.when(flag == 1, total)


def _reflected(step: Expr, clamps: Expr) -> Expr:
    """Running sum that is lifted back to zero on clamping rows.

    y = S - min(0, lowest S so far on clamping rows): two running aggregates.
    """
    total = running("sum", step)
    return apply(_excess, total, running("min", apply(_only_clamped, clamps, total)))


def position_ledger(trades: DataFrame, time: str = "datetime") -> DataFrame:
    """Long and short positions after each trade, split into today's and older volume.

    ``trades``: vt_symbol, datetime (unique per symbol), direction long/short, offset
    open/close/closetoday/closeyesterday, volume, old_first (exchanges whose plain
    close takes older volume). A plain close takes today's volume first and the rest
    from older volume. Everything is running sums and minima, which can be split.
    """
    d, o, v = F.col("direction"), F.col("offset"), F.col("volume")
    old_first = F.coalesce(F.col("old_first"), F.lit(False))
    plain = (o == "close") & ~old_first
    out: dict[str, Column] = {}
    for side, opens, closes in (("long", "long", "short"), ("short", "short", "long")):
        opening, closing = (d == opens) & (o == "open"), d == closes
        today = F.when(opening, v).when(closing & ((o == "closetoday") | plain), -v).otherwise(0.0)
        total = F.when(opening, v).when(closing & (o != "open"), -v).otherwise(0.0)
        out |= {f"__{side}_td": today, f"__{side}_all": total, f"__{side}_clamp": (closing & plain).cast("int")}
    df = Panel(trades.withColumns(out), time=time).with_columns({
        f"{side}_td": _reflected(col(f"__{side}_td"), col(f"__{side}_clamp")) for side in ("long", "short")
    } | {f"{side}_pos": running("sum", col(f"__{side}_all")) for side in ("long", "short")})
    df = df.withColumns({f"{side}_yd": F.col(f"{side}_pos") - F.col(f"{side}_td") for side in ("long", "short")})
    return df.drop(*out)


def frozen_volume(orders: DataFrame, positions: DataFrame) -> DataFrame:
    """Volume locked by active closing orders per symbol and side, capped at the position.

    ``positions``: vt_symbol, long_td, long_yd, short_td, short_yd. Buying closes
    shorts, selling closes longs; a plain close takes today's volume, then older.
    """
    live = active_orders(orders).where(F.col("offset") != "open").withColumn("left", F.col("volume") - F.col("traded"))
    take = lambda d, o: F.coalesce(F.sum(F.when((F.col("direction") == d) & (F.col("offset") == o), F.col("left"))), F.lit(0.0))
    sums = live.groupBy("vt_symbol").agg(*[
        take(d, o).alias(f"__{side}_{o}") for side, d in (("long", "short"), ("short", "long")) for o in ("closetoday", "closeyesterday", "close")])
    df = positions.join(sums, "vt_symbol", "left").na.fill(0.0)
    out = {}
    for side in ("long", "short"):
        asked = F.col(f"__{side}_closetoday") + F.col(f"__{side}_close")
        # only the part of plain closes that today's volume cannot serve moves to older volume
        spill = F.least(F.col(f"__{side}_close"), F.greatest(F.lit(0.0), asked - F.col(f"{side}_td")))
        out[f"{side}_td_frozen"] = F.least(asked - spill, F.col(f"{side}_td"))
        out[f"{side}_yd_frozen"] = F.least(F.col(f"__{side}_closeyesterday") + spill, F.col(f"{side}_yd"))
    df = df.withColumns(out)
    return df.select("vt_symbol", *out, *[(F.col(f"{s}_td_frozen") + F.col(f"{s}_yd_frozen")).alias(f"{s}_pos_frozen") for s in ("long", "short")])
