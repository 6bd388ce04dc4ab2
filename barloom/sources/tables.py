"""External signals, source-table normalisation, partition replacement and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.symbols import parse_time, to_vt_symbol
from barloom.session import durable

# fixed values: accepted column names, in order of preference
TIME_NAMES = ("datetime", "date", "trade_date")
SYMBOL_NAMES = ("vt_symbol", "symbol", "ts_code", "code")
SIGNAL_NAMES = ("signal", "score", "confidence", "rank_score")


def pick_column(columns: list[str], explicit: str | None, names: tuple[str, ...], role: str) -> str:
    if explicit is not None:
        if explicit not in columns:
            raise ValueError(f"no column {explicit!r} for {role}")
        return explicit
    for name in names:
        if name in columns:
            return name
    raise ValueError(f"no {role} column among {names}")


def load_external_signal(spark: SparkSession, path: str) -> DataFrame:
    """CSV (all text, so leading zeros survive) or Parquet, by suffix."""
    if path.lower().endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=False)
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported signal file: {path}")


def normalize_external_signal(df: DataFrame, time: str | None = None, symbol: str | None = None,
                              signal: str | None = None, extra: list[str] | None = None) -> DataFrame:
    """(datetime, vt_symbol, signal, extras); the highest signal of a key is kept."""
    t = pick_column(df.columns, time, TIME_NAMES, "datetime")
    s = pick_column(df.columns, symbol, SYMBOL_NAMES, "symbol")
    v = pick_column(df.columns, signal, SIGNAL_NAMES, "signal")
    extra = extra or []
    missing = [c for c in extra if c not in df.columns]
    if missing:
        raise ValueError(f"extra columns not found: {missing}")
    kind = df.schema[t].dataType
    stamp = F.col(t).cast("timestamp_ntz") if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else parse_time(F.col(t))
    rows = df.select(
        stamp.alias("datetime"), to_vt_symbol(F.col(s)).alias("vt_symbol"),
        F.col(v).try_cast("double").alias("signal"), *extra,
    ).dropna(subset=["datetime", "vt_symbol", "signal"])
    best = rows.groupBy("datetime", "vt_symbol").agg(
        F.max_by(F.struct("signal", *extra), "signal").alias("__best"))
    return best.select("datetime", "vt_symbol", "__best.*")


def normalize_source(df: DataFrame, dates: list[str], texts: list[str], stamp=None) -> DataFrame:
    """Dates by name, text by name, numbers where every non-null value parses.

    The parse test is one aggregate over the data, not a pass per column.
    """
    rest = [c for c in df.columns if c not in dates and c not in texts]
    checks = [F.bool_and(F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()).alias(c) for c in rest]
    numeric = df.agg(*checks).first().asDict() if checks else {}
    out = {c: parse_time(F.col(c)).cast("date") for c in dates if c in df.columns}
    out |= {c: F.col(c).cast("string") for c in texts if c in df.columns}
    out |= {c: F.col(c).try_cast("double") for c in rest if numeric.get(c) is not False}
    return df.withColumns(out).withColumn("synced_at", F.current_timestamp() if stamp is None else F.lit(stamp))


def merge_schema(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both frames with all columns; a column whose types differ becomes double."""
    types = {f.name: f.dataType for f in old.schema} | {}
    for f in new.schema:
        if f.name in types and types[f.name] != f.dataType:
            types[f.name] = T.DoubleType()
        types.setdefault(f.name, f.dataType)
    cast = lambda df: df.select(*[
        (F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in types.items()])
    return cast(old), cast(new)


def replace_rows(old: DataFrame, new: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete the rows whose key columns are in ``keys``, then append ``new``.

    An empty ``new`` still deletes. Columns may be added or widened.
    """
    kept = old.join(keys.distinct(), keys.columns, "left_anti")
    a, b = merge_schema(kept, new)
    return a.unionByName(b)


def replace_partition(spark: SparkSession, path: str, new: DataFrame, partition: str) -> None:
    """Overwrite only the partitions present in ``new``.

    Rows are rebalanced by size: a hot partition is written by as many tasks as its
    bytes need, small ones by one each (adaptive execution splits by the advisory size).
    """
    (new.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def mark_status(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Append ledger rows (task, key, status, synced_at, ...)."""
    return ledger.unionByName(entries, allowMissingColumns=True)


def latest_status(ledger: DataFrame, keys: list[str]) -> DataFrame:
    return ledger.groupBy(*keys).agg(F.max_by("status", "synced_at").alias("status"), F.max("synced_at").alias("synced_at"))


def missing_work(wanted: DataFrame, ledger: DataFrame, keys: list[str], ok: str = "ok") -> DataFrame:
    """Wanted keys whose latest status is not ok."""
    done = latest_status(ledger, keys).where(F.col("status") == ok)
    return wanted.join(done, keys, "left_anti")


def merge_parts(parts: list[DataFrame], keys: list[str], order: list[str], date: str | None = None) -> DataFrame:
    """Union part outputs, normalise the date, keep the first part's row per key.

    Sorting is left to the sink; ``order`` gives a range-partitioned result.
    """
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    rows = tagged[0]
    for p in tagged[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    if date is not None:
        rows = rows.withColumn(date, F.to_date(date))
    rest = [c for c in rows.columns if c not in (*keys, "__part")]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "__part").alias("__row"))
    return first.select(*keys, "__row.*").orderBy(*order)


def event_key(df: DataFrame) -> list[str]:
    """event_id where present, else the composite key."""
    return ["event_id"] if "event_id" in df.columns else ["vt_symbol", "signal_date", "start_type"]


def manifest(df: DataFrame, date: str = "trade_date") -> DataFrame:
    """Row, symbol and range statistics of a written table (one row)."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct("vt_symbol").alias("symbols"),
                  F.min(date).alias("first"), F.max(date).alias("last"))


def write_panel(df: DataFrame, path: str, date: str = "trade_date") -> DataFrame:
    """Write a panel partitioned by year and return its manifest."""
    rows = durable(df.withColumn("year", F.year(date)))
    (rows.repartition("year", F.pmod(F.hash("vt_symbol"), F.lit(16))).sortWithinPartitions("vt_symbol", date)
     .write.mode("overwrite").partitionBy("year").parquet(path))
    return manifest(rows, date)


def scan_panel(spark: SparkSession, path: str, columns: list[str], start=None, end=None,
               member: str | None = None, date: str = "trade_date") -> DataFrame:
    """Column- and range-pruned scan; ``member`` keeps rows whose flag is true."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where(F.col(date) >= F.lit(str(start)).cast(df.schema[date].dataType)).where(F.col("year") >= int(str(start)[:4]))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(str(end)).cast(df.schema[date].dataType)).where(F.col("year") <= int(str(end)[:4]))
    if member is not None:
        df = df.where(F.coalesce(F.col(member), F.lit(False)))
    return df.select(*columns)


def load_numeric_panel(spark: SparkSession, path: str, start=None, end=None, min_close: float | None = None) -> DataFrame:
    """Parquet panel with numbers as double, date range and a close floor."""
    df = spark.read.parquet(path)
    numeric = (T.IntegerType, T.LongType, T.ShortType, T.FloatType, T.DecimalType)
    df = df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema if isinstance(f.dataType, numeric)})
    from barloom.sources.store import within
    df = within(df, "datetime", start, end)
    return df if min_close is None else df.where(F.col("close") >= min_close)


def export_frame(df: DataFrame, path: str) -> None:
    """CSV or Parquet by suffix."""
    if path.endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").parquet(path)


def read_minutes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Minute-bar CSV parts as typed rows with date and hhmm."""
    raw = spark.read.csv(paths, header=True, inferSchema=False)
    stamp = F.to_timestamp_ntz("datetime")
    prices = {c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume", "amount") if c in raw.columns}
    return raw.withColumns(prices | {"datetime": stamp}).withColumns({
        "date": F.to_date("datetime"), "minute_hhmm": F.date_format("datetime", "HHmm").cast("int")})


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Symbols from a text or CSV file; ``#`` starts a comment, a header is optional."""
    lines = spark.read.text(path).select(F.trim(F.split_part("value", F.lit(","), F.lit(1))).alias("raw"))
    lines = lines.where((F.col("raw") != "") & ~F.col("raw").startswith("#") & ~F.lower("raw").isin(*SYMBOL_NAMES))
    return lines.select(to_vt_symbol(F.col("raw")).alias("vt_symbol")).distinct()


def select_symbols(df: DataFrame, listed: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of the listed symbols; ``strict`` raises if the list names a symbol that ``df`` does not have."""
    wanted = listed.select("vt_symbol").distinct()
    if strict:
        lost = wanted.join(df.select("vt_symbol"), "vt_symbol", "left_anti")
        if not lost.isEmpty():
            raise ValueError(f"symbols without rows, such as {lost.first()[0]}")
    return df.join(wanted, "vt_symbol", "left_semi")


def normalize_events(df: DataFrame, dates: list[str], flags: dict[str, bool], start=None, end=None,
                     on: str = "signal_date") -> DataFrame:
    """Dates parsed, boolean flags with a default, date range applied."""
    df = df.withColumns({c: F.to_date(c) for c in dates if c in df.columns})
    df = df.withColumns({
        c: (F.coalesce(F.col(c).cast("boolean"), F.lit(d)) if c in df.columns else F.lit(d)) for c, d in flags.items()})
    from barloom.sources.store import within
    return within(df, on, start, end)


def demo_bars(spark: SparkSession, symbols: int = 30, days: int = 600, seed: int = 7) -> DataFrame:
    """Seeded synthetic OHLCV bars (cumulative product of random returns)."""
    from barloom.functions.expr import col, running
    from barloom.plans.panel import Panel
    grid = spark.range(symbols * days).select(
        F.concat(F.lit("S"), F.lpad((F.col("id") / days).cast("int").cast("string"), 4, "0")).alias("vt_symbol"),
        F.date_add(F.lit("2022-01-01").cast("date"), (F.col("id") % days).cast("int")).cast("timestamp_ntz").alias("datetime"),
        F.log1p(F.randn(seed) * 0.02).alias("step"), F.abs(F.randn(seed + 1) * 0.01).alias("up"),
        F.abs(F.randn(seed + 2) * 0.01).alias("down"), F.exp(F.randn(seed + 3) * 0.5 + 12).alias("volume"),
    )
    walked = Panel(durable(grid)).with_columns({"level": running("sum", col("step"))})
    close = F.exp("level") * 100
    before = close / F.exp("step")
    return walked.select(
        "datetime", "vt_symbol", before.alias("open"), (F.greatest(before, close) * (1 + F.col("up"))).alias("high"),
        (F.least(before, close) * (1 - F.col("down"))).alias("low"), close.alias("close"), "volume",
        (close * F.col("volume")).alias("turnover"))
