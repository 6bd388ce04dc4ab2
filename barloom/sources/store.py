"""Partitioned Parquet store for bars, universes, signals, datasets and contracts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import safe
from barloom.plans.intervals import calendar, expand, islands
from barloom.session import durable

BAR_KEYS = ("interval", "vt_symbol", "datetime")


def newest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: one row per key, the new row where both have it (partial aggregation first)."""
    both = old.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__gen")]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__gen").alias("__row"))
    return best.select(*keys, "__row.*").select(*[c for c in both.columns if c != "__gen"])


def _of_symbols(df: DataFrame, symbols: list[str] | DataFrame | None) -> DataFrame:
    """Rows of the given symbols (None: all)."""
    if isinstance(symbols, DataFrame):
        return df.join(symbols.select("vt_symbol").distinct(), "vt_symbol", "left_semi")
    return df if symbols is None else df.where(F.col("vt_symbol").isin(*symbols))


@dataclass(frozen=True)
class PanelStore:
    """Tables under one root; every write replaces only the partitions it touches."""

    spark: SparkSession
    root: str

    # ------------------------------------------------------------------ basics
    def path(self, kind: str, name: str = "") -> str:
        return f"{self.root}/{kind}/{name}".rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, kind: str, name: str = "") -> bool:
        fs, p = self._fs(self.path(kind, name))
        return fs.exists(p)

    def read(self, kind: str, name: str = "") -> DataFrame:
        return self.spark.read.parquet(self.path(kind, name))

    def names(self, kind: str) -> list[str]:
        if not self.exists(kind):
            return []
        fs, p = self._fs(self.path(kind))
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def remove(self, kind: str, name: str) -> bool:
        if not self.exists(kind, name):
            return False
        fs, p = self._fs(self.path(kind, name))
        return bool(fs.delete(p, True))

    def _replace_partitions(self, df: DataFrame, path: str, parts: list[str], sort: list[str]) -> None:
        # rebalanced by size: a large partition gets as many writer tasks as its bytes need
        (df.hint("rebalance", *parts).sortWithinPartitions(*parts, *sort).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))

    # -------------------------------------------------------------------- bars
    def save_bars(self, bars: DataFrame, interval: str, kind: str = "bars") -> None:
        """Merge bars into the store; a bar with an existing key replaces it."""
        new = bars.withColumns({"interval": F.lit(interval), "year": F.year("datetime")})
        new = new.dropDuplicates(["vt_symbol", "datetime"])
        if self.exists(kind):
            touched = new.select("interval", "year").distinct()
            old = self.read(kind).join(touched, ["interval", "year"], "left_semi")
            new = newest_wins(old, new, [*BAR_KEYS, "year"])
        self._replace_partitions(durable(new), self.path(kind), ["interval", "year"], ["vt_symbol", "datetime"])

    def load_bars(self, interval: str, start=None, end=None, symbols: list[str] | DataFrame | None = None,
                  kind: str = "bars") -> DataFrame:
        """Range scan; interval and year prune partitions, the rest reaches Parquet."""
        df = self.read(kind).where(F.col("interval") == interval)
        df = within(df, "datetime", start, end)
        if start is not None:
            df = df.where(F.col("year") >= F.year(F.lit(str(start)).cast("timestamp_ntz")))
        if end is not None:
            df = df.where(F.col("year") <= F.year(F.lit(str(end)).cast("timestamp_ntz")))
        return _of_symbols(df, symbols).drop("interval", "year")

    def load_bar_panel(self, interval: str, start: str, end: str, extended_days: int = 0,
                       symbols: list[str] | DataFrame | None = None) -> DataFrame:
        """Bars of a widened range with vwap, prices scaled by the first loaded close,
        and suspended bars (all-zero prices and volumes) as NaN."""
        s = F.lit(start).cast("timestamp_ntz") - F.expr(f"interval {extended_days} days")
        e = F.lit(end).cast("timestamp_ntz") + F.expr(f"interval {extended_days // 10} days")
        df = self.read("bars").where((F.col("interval") == interval) & (F.col("year") >= F.year(s)) & (F.col("year") <= F.year(e))
                                     & (F.col("datetime") >= s) & (F.col("datetime") <= e))
        return scaled_panel(_of_symbols(df, symbols).drop("interval", "year"))

    def delete_bars(self, interval: str, symbols: list[str], kind: str = "bars") -> None:
        """Rewrite only the partitions that hold the symbols."""
        old = self.read(kind)
        gone = (F.col("interval") == interval) & F.col("vt_symbol").isin(*symbols)
        touched = old.where(gone).select("interval", "year").distinct()
        rest = durable(old.join(touched, ["interval", "year"], "left_semi").where(~gone))
        empty = durable(touched.join(rest.select("interval", "year").distinct(), ["interval", "year"], "left_anti"))
        self._replace_partitions(rest, self.path(kind), ["interval", "year"], ["vt_symbol", "datetime"])
        for row in empty.collect():  # partitions, not rows: at most intervals x years
            self.remove(kind, f"interval={row['interval']}/year={row['year']}")

    def overview(self, kind: str = "bars") -> DataFrame:
        """Row count, first and last time of every stored series."""
        return self.read(kind).groupBy("vt_symbol", "interval").agg(
            F.count("*").alias("count"), F.min("datetime").alias("start"), F.max("datetime").alias("end"))

    # ---------------------------------------------------------------- universes
    def save_members(self, index: str, members: DataFrame) -> None:
        """Replace the given trade dates of a point universe; only their years are read and rewritten."""
        path = self.path("universe", index)
        rows = members.select("trade_date", "vt_symbol").distinct().withColumn("year", F.year("trade_date"))
        if self.exists("universe", index):
            old = self.read("universe", index).join(rows.select("year").distinct(), "year", "left_semi")
            rows = old.join(rows.select("trade_date").distinct(), "trade_date", "left_anti").unionByName(rows)
        self._replace_partitions(durable(rows), path, ["year"], ["trade_date", "vt_symbol"])

    def save_member_intervals(self, index: str, intervals: DataFrame) -> None:
        intervals.write.mode("overwrite").parquet(self.path("universe", index))

    def save_calendar(self, dates: DataFrame) -> None:
        dates.select("trade_date").distinct().write.mode("overwrite").parquet(self.path("calendar"))

    def trading_dates(self, start=None, end=None) -> DataFrame | None:
        return within(self.read("calendar"), "trade_date", start, end) if self.exists("calendar") else None

    def member_intervals(self, index: str, start=None, end=None) -> DataFrame:
        """(vt_symbol, valid_from, valid_to), clipped; points are merged on their calendar."""
        df = self.read("universe", index)
        if "valid_from" not in df.columns:
            days = self.trading_dates()
            days = calendar(df if days is None else days, "trade_date")
            df = islands(within(df, "trade_date", start, end), days, "vt_symbol", "trade_date")
        return clip(df, start, end)

    def members_by_date(self, index: str, start=None, end=None) -> DataFrame:
        """(trade_date, vt_symbol) membership, from points or intervals."""
        df = self.read("universe", index)
        if "valid_from" in df.columns:
            return expand(clip(df, start, end), self.trading_dates(start, end), "vt_symbol")
        return within(df, "trade_date", start, end).select("trade_date", "vt_symbol")

    def symbol_lists(self, index: str, start=None, end=None) -> DataFrame:
        """trade_date -> sorted symbol array."""
        return self.members_by_date(index, start, end).groupBy("trade_date").agg(
            F.sort_array(F.collect_set("vt_symbol")).alias("symbols"))

    def symbols(self, index: str, start=None, end=None) -> DataFrame:
        """Distinct symbols active at any time in the range."""
        return self.member_intervals(index, start, end).select("vt_symbol").distinct()

    def load_member_bars(self, index: str, interval: str, start: str, end: str, extended_days: int = 0) -> DataFrame:
        """Bars of every symbol that is in the universe at any time in the range."""
        return self.load_bar_panel(interval, start, end, extended_days, self.symbols(index, start, end))

    # -------------------------------------------------- signals, datasets, contracts
    def save_table(self, kind: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(kind, name))

    def load_table(self, kind: str, name: str) -> DataFrame | None:
        return self.read(kind, name) if self.exists(kind, name) else None

    def save_signal(self, name: str, df: DataFrame) -> None: self.save_table("signal", name, df)
    def load_signal(self, name: str) -> DataFrame | None: return self.load_table("signal", name)
    def remove_signal(self, name: str) -> bool: return self.remove("signal", name)
    def list_signals(self) -> list[str]: return self.names("signal")

    def save_dataset(self, name: str, df: DataFrame, meta: dict) -> None:
        self.save_table("dataset", f"{name}/data", df)
        text = self.spark.createDataFrame([(json.dumps(meta),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(self.path("dataset", f"{name}/meta"))

    def load_dataset(self, name: str) -> tuple[DataFrame, dict] | None:
        if not self.exists("dataset", name):
            return None
        meta = json.loads(self.spark.read.text(self.path("dataset", f"{name}/meta")).first()["value"])
        return self.read("dataset", f"{name}/data"), meta

    def remove_dataset(self, name: str) -> bool: return self.remove("dataset", name)
    def list_datasets(self) -> list[str]: return self.names("dataset")

    def save_model(self, name: str, model) -> None:
        model.write().overwrite().save(self.path("model", name))

    def load_model(self, name: str, kind):
        return kind.load(self.path("model", name)) if self.exists("model", name) else None

    def remove_model(self, name: str) -> bool: return self.remove("model", name)
    def list_models(self) -> list[str]: return self.names("model")

    def add_contract(self, vt_symbol: str, long_rate: float, short_rate: float, size: float, pricetick: float) -> None:
        row = self.spark.createDataFrame(
            [(vt_symbol, float(long_rate), float(short_rate), float(size), float(pricetick))],
            "vt_symbol string, long_rate double, short_rate double, size double, pricetick double")
        old = self.contracts()
        merged = row if old is None else newest_wins(old, row, ["vt_symbol"])
        durable(merged).coalesce(1).write.mode("overwrite").parquet(self.path("contract"))

    def contracts(self) -> DataFrame | None:
        return self.read("contract") if self.exists("contract") else None


def within(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive range filter; either end may be open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(str(end)).cast("timestamp_ntz"))
    return df


def clip(intervals: DataFrame, start=None, end=None) -> DataFrame:
    """Intervals that touch the range, cut to it."""
    lo, hi = F.col("valid_from").cast("date"), F.col("valid_to").cast("date")
    if start is not None:
        lo = F.greatest(lo, F.lit(str(start)[:10]).cast("date"))
    if end is not None:
        hi = F.least(hi, F.lit(str(end)[:10]).cast("date"))
    return intervals.select("vt_symbol", lo.alias("valid_from"), hi.alias("valid_to")).where(F.col("valid_from") <= F.col("valid_to"))


PRICES = ("open", "high", "low", "close")


def scaled_panel(df: DataFrame) -> DataFrame:
    """vwap from turnover/volume; OHLC over the symbol's first close; suspensions to NaN.

    The first close comes from a per-symbol aggregate joined back, so no task holds
    a whole symbol. Suspension is judged on OHLCV (vwap of an empty bar is NaN).
    """
    first = df.groupBy("vt_symbol").agg(F.min_by("close", "datetime").alias("__first"))
    measures = [c for c in ("open", "high", "low", "close", "volume", "turnover", "open_interest") if c in df.columns]
    df = df.join(first, "vt_symbol").withColumn("vwap", safe.safe_div(F.col("turnover"), F.col("volume")))
    empty: Column = sum((F.coalesce(F.abs(F.col(c)), F.lit(0.0)) for c in measures), F.lit(0.0)) == 0
    out = {p: safe.safe_div(F.col(p), F.col("__first")) for p in PRICES}
    df = df.withColumn("__empty", empty).withColumns(out).drop("__first")
    masked = {c: F.when(F.col("__empty"), F.lit(safe.NAN)).otherwise(F.col(c)) for c in [*measures, "vwap"]}
    return df.withColumns(masked).drop("__empty")


def price_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Lowest low, highest high and largest volume of a time range (one row)."""
    return within(df, "datetime", start, end).agg(
        F.min("low").alias("min_price"), F.max("high").alias("max_price"), F.max("volume").alias("max_volume"))
