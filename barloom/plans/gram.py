"""Cross-products of many columns in one pass: X'X, sums and row count.

Each task adds up the products of its Arrow blocks and sends the upper half once;
Spark sums the halves. So the work per row is one matrix product in numpy and
what is shuffled is columns squared per task, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Number of the all-ones column, which gives sums and the row count.
ONES = -1


def cross_products(df: DataFrame, columns: list[str], shift: float = 0.0) -> DataFrame:
    """(i, j, product): sum of (x_i - shift) * (x_j - shift) over rows with finite values only, i <= j, by column number; i = ONES for the column of ones."""
    k = len(columns)
    upper = np.triu_indices(k + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = np.ones((batch.num_rows, k + 1))
            for n, c in enumerate(columns):
                x[:, n + 1] = batch.column(c).to_numpy(zero_copy_only=False) - shift
            x = x[np.isfinite(x).all(axis=1)]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(upper[0] + ONES, pa.int32()), pa.array(upper[1] + ONES, pa.int32()), pa.array(total[upper])], ["i", "j", "product"])

    # missing values are left out in the task: as many filters as columns would swamp the optimizer
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return rows.mapInArrow(work, "i int, j int, product double").groupBy("i", "j").agg(F.sum("product").alias("product"))


def matrix(df: DataFrame, columns: list[str], shift: float = 0.0) -> np.ndarray:
    """The whole matrix with the ones first; its size depends on the columns alone."""
    out = np.zeros((len(columns) + 1,) * 2)
    for r in cross_products(df, columns, shift).collect():
        out[r.i - ONES, r.j - ONES] = out[r.j - ONES, r.i - ONES] = r.product
    return out


def correlations(df: DataFrame, columns: list[str], shift: float = 0.0) -> DataFrame:
    """(factor, other, corr) of every ordered pair; NaN where a column does not vary. One pass, at the call."""
    total = matrix(df, columns, shift)
    n, sums = total[0, 0], total[0, 1:]
    with np.errstate(all="ignore"):
        spread = total[1:, 1:] - np.outer(sums, sums) / n
        # what is left of a constant column's squares is rounding
        own = np.where(np.diag(spread) > 1e-12 * np.diag(total)[1:], np.diag(spread), 0.0)
        corr = spread / np.sqrt(np.outer(own, own))
    corr[np.diag_indices(len(columns))] = np.where(own > 0, 1.0, np.nan)
    corr[(own == 0)[:, None] | (own == 0)[None, :]] = np.nan
    cells = pa.table({"factor": np.repeat(columns, len(columns)), "other": np.tile(columns, len(columns)), "corr": corr.ravel()})
    return df.sparkSession.createDataFrame(cells)
