"""Linear recurrences y = a*y + b as a parallel prefix over affine maps.

Composing two steps gives another step: (a2, b2) after (a1, b1) is
(a2*a1, a2*b1 + b2). Log-step doubling composes each row with the row 1, 2, 4, ...
before it, on whole numpy columns, so no step loops over bars. Rows of many
groups lie one after the other in a batch; a group's first row restarts the
state, and a group that goes on in the next batch hands its last value over. A
task holds one Arrow batch at a time, however long a group is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST = "__first"
TINY = np.finfo(float).tiny


def affine_scan(a: np.ndarray, b: np.ndarray, restart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of y (from state 0), of the product of a since the last restart, and of 'restarted since the start'.

    A step with a = 0 restarts its column, a row of ``restart`` all of them. A
    restart lets nothing through, while a NaN of the state outlives any number
    of other steps: products that underflow keep the least positive number.
    """
    y, p, r = b.copy(), a.copy(), a == 0.0
    if restart is not None:
        r |= restart[:, None]
    step = 1
    with np.errstate(all="ignore"):
        while step < len(y) and not r[step:].all():
            open_ = ~r[step:]
            product = p[step:] * p[:-step]
            product = np.where((product == 0.0) & ~r[:-step], np.copysign(TINY, product), product)
            y[step:] = np.where(open_, p[step:] * y[:-step] + y[step:], y[step:])
            p[step:] = np.where(open_, product, p[step:])
            r = np.concatenate([r[:step], r[step:] | r[:-step]])
            step *= 2
    return y, p, r


def scan_rows(df: DataFrame, group: list[str], order: str, live: list[str], feeds: list[tuple[str, str]], out: list[tuple[str, ...]]) -> DataFrame:
    """``live`` columns of ``df`` with the recurrence of each (a, b) of ``feeds`` along ``order`` inside each group.

    Names of ``out``: y alone, or y, product and restarted. The row number tells
    Spark to bring each group together and in order (it needs no exchange and no
    sort where windows over the group came before), and marks each first row.
    """
    fields = [df.schema[c] for c in live]
    kinds = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    for k in range(max(map(len, out))):
        fields += [T.StructField(names[k], kinds[k]) for names in out]
    a_cols, b_cols = ([f[i] for f in feeds] for i in (0, 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # y, product and restarted of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in a_cols])
            b = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in b_cols])
            first = batch.column(FIRST).to_numpy(zero_copy_only=False)
            started = np.logical_or.accumulate(first)
            y, p, r = affine_scan(a, b, first)
            restarted = restarts_in_group(a, first)
            if held is not None and not first[0]:
                with np.errstate(all="ignore"):
                    y = np.where(r, y, y + p * held[0])
                    p = np.where(started[:, None], p, p * held[1])
                restarted |= ~started[:, None] & held[2]
            held = y[-1], p[-1], restarted[-1]
            parts = [y, p, restarted]
            columns = [pa.array(np.ascontiguousarray(parts[k][:, i])) for k in range(max(map(len, out))) for i in range(len(out))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in live), *columns], names=[f.name for f in fields])

    window = Window.partitionBy(*group).orderBy(order)
    needed = list(dict.fromkeys([*live, *a_cols, *b_cols]))
    return df.select(*dict.fromkeys([*needed, *group, order])).withColumn(FIRST, F.row_number().over(window) == 1).select(*needed, FIRST).mapInArrow(work, T.StructType(fields))


def restarts_in_group(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a step with a = 0 came since the group's first row (or the batch's)."""
    seen = np.cumsum(a == 0.0, axis=0)
    start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    before = np.where(start[:, None] > 0, seen[np.maximum(start - 1, 0)], 0)
    return seen > before
