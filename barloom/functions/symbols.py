"""Symbol and date text rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: market suffixes and the exchange names they stand for
EXCHANGES = {"SH": "SSE", "SZ": "SZSE", "BJ": "BSE"}
SPECIAL_NAME = "ST|退"  # special treatment or delisting


def to_vt_symbol(raw: Column) -> Column:
    """CODE.EXCHANGE from common forms; empty text raises."""
    text = F.upper(F.trim(raw.cast("string")))
    code, suffix = F.split_part(text, F.lit("."), F.lit(1)), F.regexp_replace(text, r"^[^.]*\.", "")
    mapped = suffix
    for short, name in EXCHANGES.items():
        mapped = F.when(suffix == short, F.lit(name)).otherwise(mapped)
    digits = F.when(text.rlike(r"^\d{1,5}$"), F.lpad(text, 6, "0")).otherwise(text)
    six = digits.rlike(r"^\d{6}$")
    return (
        F.when(text == "", F.raise_error(F.lit("Symbol cannot be empty")))
        .when(text.contains("."), F.concat_ws(".", code, mapped))
        .when(six & digits.rlike("^[659]"), F.concat(digits, F.lit(".SSE")))
        .when(six & digits.rlike("^[023]"), F.concat(digits, F.lit(".SZSE")))
        .when(six & digits.rlike("^[48]"), F.concat(digits, F.lit(".BSE")))
        .otherwise(digits)
    )


def split_vt_symbol(vt_symbol: Column) -> tuple[Column, Column]:
    """(symbol, exchange) around the last dot."""
    exchange = F.substring_index(vt_symbol, ".", -1)
    return F.regexp_replace(vt_symbol, r"\.[^.]*$", ""), exchange


def join_vt_symbol(symbol: Column, exchange: Column) -> Column:
    return F.concat_ws(".", symbol, exchange)


def is_special_name(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(SPECIAL_NAME)


def on_exchange(vt_symbol: Column, exchange: str) -> Column:
    return vt_symbol.endswith(f".{exchange}")


def vendor_code(vt_symbol: Column, separator: str = ".") -> Column:
    """Lower-case market prefix form: 600000.SSE -> sh.600000 (or sh600000)."""
    code, exchange = split_vt_symbol(vt_symbol)
    prefix = F.when(exchange == "SSE", "sh").when(exchange == "SZSE", "sz").when(exchange == "BSE", "bj")
    return F.when(prefix.isNotNull(), F.concat(prefix, F.lit(separator), code))


def match_key(date: Column, *parts: Column) -> Column:
    return F.concat_ws("|", F.date_format(date, "yyyy-MM-dd"), *[p.cast("string") for p in parts])


def parse_time(text: Column) -> Column:
    """Eight digits are yyyyMMdd and nothing else; other text is tried as ISO."""
    t = F.trim(text.cast("string"))
    eight = t.rlike(r"^\d{8}$")
    return F.when(eight, F.try_to_timestamp(t, F.lit("yyyyMMdd"))).otherwise(
        F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in (
            "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss.SSSSSS")])
    ).cast("timestamp_ntz")
