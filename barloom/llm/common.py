"""What several operators of this subpackage share: word rules, batches, shared tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, and the pattern of a run of them.
BLANKS = "\t\n\x0b\x0c\r "
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text column as an array (null or blank: empty)."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared checkpoint folder.

    Only a session that names none (a test in local mode) gets a temporary one;
    with remote executors that is an error, as they could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        current = spark.sparkContext.getCheckpointDir()
        base = str(current) if current is not None else None
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Tables that each open ``scratch`` deletes at its end, the innermost last.
_scratches: ContextVar[tuple[list[str], ...]] = ContextVar("scratches", default=())


def stored(df: DataFrame, result: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Inside a ``scratch`` the table goes when that ends; a ``result`` goes with
    the next one outside, or stays if there is none.
    """
    path, level = shared_folder(df.sparkSession), len(_scratches.get()) - 1 - result
    df.write.parquet(path)
    if level >= 0:
        _scratches.get()[level].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``stored`` writes inside, at the end. Nothing that reads them may leave; store it as a ``result``."""
    paths: list[str] = []
    token = _scratches.set((*_scratches.get(), paths))
    try:
        yield
    finally:
        _scratches.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    They go when the driver collects the plans that made them, which in a long
    job with a quiet driver may be never. Call it after ``stored``, when what was
    written no longer needs them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_parts(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Cut a long text before blanks that follow a non-blank, ``size`` characters or a little more each.

    No pre-token of the rules used here spans such a place, so the parts can be
    worked on one after the other. A text without such a place stays whole.
    """
    start, n = 0, len(text)
    while n - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def chunks(items: list[str], size: int = 1 << 20) -> Iterator[range]:
    """Runs of row numbers whose texts hold about ``size`` characters."""
    first, held = 0, 0
    for i, x in enumerate(items):
        held += len(x)
        if held >= size:
            yield range(first, i + 1)
            first, held = i + 1, 0
    if first < len(items):
        yield range(first, len(items))
