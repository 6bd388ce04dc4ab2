"""Tables that change together: readers see a whole commit or none of it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.sources import manifest as mf

DAY, NEXT = "2024-01-02", "2024-01-03"


def rows(spark, n, day=DAY):
    return spark.range(n).select(F.lit(day).cast("date").alias("trade_date"), F.col("id").cast("string").alias("vt_symbol"))


@pytest.fixture
def store(spark, tmp_path):
    store = mf.TableSet(spark, str(tmp_path / "set"))
    store.replace({n: {DAY: rows(spark, 5), NEXT: rows(spark, 7, NEXT)} for n in ("daily", "valuation", "limits")})
    return store


def counts(store, **kw):
    return [store.read(n, **kw).count() for n in ("daily", "valuation", "limits")]


def test_one_date_of_three_tables(store, spark):
    assert counts(store) == [12, 12, 12] and counts(store, parts=[NEXT]) == [7, 7, 7]
    mf.replace_date(store, DAY, {n: rows(spark, 2) for n in ("daily", "valuation", "limits")})
    assert counts(store) == [9, 9, 9] and counts(store, version=1) == [12, 12, 12]
    assert store.vacuum() == 3 and counts(store) == [9, 9, 9]


def test_a_failure_between_two_tables_changes_none(store, spark):
    broken = rows(spark, 3).select("trade_date", F.raise_error(F.lit("lost")).cast("string").alias("vt_symbol"))
    with pytest.raises(Exception, match="lost"):
        mf.replace_date(store, DAY, {"daily": rows(spark, 1), "valuation": broken, "limits": rows(spark, 1)})
    assert store.version() == 1 and counts(store) == [12, 12, 12]
    assert store.vacuum() >= 1 and counts(store) == [12, 12, 12]


def test_the_second_of_two_writers_fails(store, spark):
    old = store.manifest()
    store.replace({"daily": {DAY: rows(spark, 1)}})
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit(old, 2)
    assert store.read("daily").count() == 8


def test_rows_of_another_date_are_refused_and_empty_frames_empty(store, spark):
    with pytest.raises(ValueError):
        mf.replace_date(store, DAY, {"daily": rows(spark, 1, NEXT)})
    mf.replace_date(store, DAY, {"daily": rows(spark, 0)})
    assert counts(store) == [7, 12, 12] and store.read("daily", parts=["2030-01-01"]).count() == 0
    with pytest.raises(ValueError):
        store.read("nothing")


def test_export_writes_all_or_nothing(spark, tmp_path):
    bars = spark.createDataFrame([(s, dt.datetime(2024, 1, d)) for s in "AB" for d in (1, 2, 4, 5) if (s, d) != ("B", 2)], "vt_symbol string, datetime timestamp_ntz")
    store = mf.TableSet(spark, str(tmp_path / "export"))
    members = bars.select(F.to_date("datetime").alias("trade_date"), "vt_symbol").where("day(trade_date) <> 4")
    assert mf.export_research(store, bars, {"core": members}) == 1
    assert {(r.vt_symbol, r.bar_count, round(r.coverage, 2)) for r in store.read("coverage").collect()} == {("A", 4, 1.0), ("B", 3, 0.75)}
    assert {(r.vt_symbol, r.valid_from.day, r.valid_to.day) for r in store.read("universes").collect()} == {("A", 1, 2), ("A", 5, 5), ("B", 1, 1), ("B", 5, 5)}
    assert store.read("calendar").count() == 4 and store.read("contracts").count() == 2
