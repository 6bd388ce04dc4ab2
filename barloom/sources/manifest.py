"""Tables that change together: staged writes and one manifest switch.

New data goes to folders of its own; nothing a reader knows is touched. A commit
renames one small file, the next manifest, into place. A reader takes the newest
manifest and sees every table as of one commit: all tables of a replaced date, or
none. Of two writers that start from the same manifest the second one fails, as
the file it wants to create exists. Folders that no manifest names can be removed
by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.intervals import calendar, islands

#: Part of a table that is always replaced as a whole.
WHOLE = "all"


@dataclass(frozen=True)
class TableSet:
    """Tables under one root; ``root`` may be any folder that Spark's file systems reach."""

    spark: SparkSession
    root: str

    # ---------------------------------------------------------------- manifests
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def version(self) -> int:
        """Number of the newest commit (0: none)."""
        done = [n for n in self._names("manifest") if n.endswith(".json")]
        return int(done[-1].removesuffix(".json")) if done else 0

    def manifest(self, version: int | None = None) -> dict[str, dict[str, str]]:
        """Folder of each part of each table, as of a commit (None: the newest)."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        text = self.spark.read.text(f"{self.root}/manifest/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, tables: dict[str, dict[str, str]], version: int) -> None:
        fs = self._fs()
        staged, final = self._path("staged", f"{uuid.uuid4().hex}.json"), self._path("manifest", f"{version:012d}.json")
        fs.mkdirs(final.getParent())
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(staged, final):
            raise RuntimeError(f"another writer committed version {version} first")

    # ------------------------------------------------------------------- tables
    def replace(self, parts: dict[str, dict[str, DataFrame]]) -> int:
        """Replace parts of tables, {table: {part: rows}}, in one commit; returns its number.

        All rows are written before the commit. An empty frame empties its part.
        """
        before = self.version()
        tables = self.manifest(before)
        written = {}
        for table, frames in parts.items():
            for part, df in frames.items():
                folder = f"data/{table}/{part}/{uuid.uuid4().hex}"
                df.write.parquet(f"{self.root}/{folder}")
                written[table, part] = folder
        for (table, part), folder in written.items():
            tables.setdefault(table, {})[part] = folder
        self._commit(tables, before + 1)
        return before + 1

    def read(self, table: str, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """Rows of a table as of one commit; ``parts`` are the only folders listed."""
        folders = self.manifest(version).get(table)
        if not folders:
            raise ValueError(f"no table {table!r}")
        wanted = [f"{self.root}/{f}" for p, f in sorted(folders.items()) if parts is None or p in parts]
        if not wanted:
            return self.spark.read.parquet(f"{self.root}/{next(iter(folders.values()))}").limit(0)
        return self.spark.read.option("mergeSchema", "true").parquet(*wanted)

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders that none of the newest ``keep`` manifests names; returns their number."""
        newest = self.version()
        named = {f for v in range(max(1, newest - keep + 1), newest + 1) for t in self.manifest(v).values() for f in t.values()}
        fs, gone = self._fs(), 0
        for table in self._names("data"):
            for part in self._names(f"data/{table}"):
                for run in self._names(f"data/{table}/{part}"):
                    if f"data/{table}/{part}/{run}" not in named:
                        gone += bool(fs.delete(self._path("data", table, part, run), True))
        return gone


def replace_date(tables: TableSet, trade_date: str, frames: dict[str, DataFrame], date: str = "trade_date") -> int:
    """Replace one trade date in several market tables at once (rows of other dates are refused)."""
    for name, df in frames.items():
        if not df.where(~F.coalesce(F.col(date) == F.lit(trade_date).cast("date"), F.lit(False))).isEmpty():
            raise ValueError(f"rows of another date in {name!r}")
    return tables.replace({name: {trade_date: df} for name, df in frames.items()})


def export_research(tables: TableSet, bars: DataFrame, universes: dict[str, DataFrame], contracts: DataFrame | None = None) -> int:
    """Bars, calendar, universe intervals, contracts and coverage in one commit.

    ``bars`` (vt_symbol, datetime, ...), each universe (trade_date, vt_symbol). Without
    ``contracts`` every symbol of the bars gets the default ones. Coverage has a row per
    symbol: bars, first and last day, and the share of calendar days in between it has.
    """
    days = calendar(bars.select(F.to_date("datetime").alias("trade_date")), "trade_date")
    symbols = bars.groupBy("vt_symbol").agg(F.count("*").alias("bar_count"), F.to_date(F.min("datetime")).alias("first_date"), F.to_date(F.max("datetime")).alias("last_date"),
                                            F.count_distinct(F.to_date("datetime")).alias("__days"))
    at = lambda name: days.select(F.col("trade_date").alias(f"{name}_date"), F.col("day_index").alias(f"__{name}"))
    coverage = symbols.join(at("first"), "first_date").join(at("last"), "last_date").select(
        "vt_symbol", "bar_count", "first_date", "last_date", (F.col("__days") / (F.col("__last") - F.col("__first") + 1)).alias("coverage"))
    if contracts is None:
        contracts = symbols.select("vt_symbol", F.lit(0.0).alias("long_rate"), F.lit(0.0).alias("short_rate"), F.lit(1.0).alias("size"), F.lit(0.01).alias("pricetick"))
    spread = bars.hint("rebalance", "vt_symbol").sortWithinPartitions("vt_symbol", "datetime")  # few symbols a file, hot ones in several
    return tables.replace({
        "bars": {WHOLE: spread}, "calendar": {WHOLE: days.select("trade_date")}, "contracts": {WHOLE: contracts}, "coverage": {WHOLE: coverage},
        "universes": {name: islands(points, days, "vt_symbol", "trade_date").withColumn("universe", F.lit(name)) for name, points in universes.items()}})
