"""Exact evaluation of sequential rules along a symbol (no closed window form).

``kernel(state, pdf) -> (state, outputs)`` walks bars in time order. Groups of a
checked size run whole. A longer symbol is cut into blocks that start from a
guess (a warm-up on the bars before the block); blocks whose guess differs from
the end state of the block before are run again from that state, until every
block starts where its predecessor ended. The result equals the serial walk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.plans import skew
from barloom.plans.panel import BLK, IDX, Panel, append_columns
from barloom.session import durable

Kernel = Callable[[np.ndarray, pd.DataFrame], tuple[np.ndarray, dict[str, np.ndarray]]]
WARM_UP = 512


def state_scan(panel: Panel, kernel: Kernel, init: tuple[float, ...], outputs: list[str]) -> DataFrame:
    """The panel's rows with the kernel's output columns (doubles)."""
    df, symbol, time = panel.df, panel.symbol, panel.time
    base = list(df.columns)
    new = [T.StructField(o, T.DoubleType()) for o in outputs]
    start = np.array(init, dtype=float)

    if not skew.oversized(df, [symbol], panel.max_group_rows)[symbol]:
        def whole(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by(time).combine_chunks()
            _, out = kernel(start.copy(), rows.to_pandas())
            return append_columns(rows, out)

        return df.groupBy(symbol).applyInArrow(whole, T.StructType([*df.schema.fields, *new]))

    block = panel.max_group_rows or skew.MAX_GROUP_ROWS
    warm = min(block, WARM_UP)
    rows = durable(skew.with_row_index(df, symbol, time, block, IDX)
                   .withColumn(BLK, F.floor(F.col(IDX) / F.lit(block))))
    states = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("__start", "__end")]
    schema = T.StructType([*rows.schema.fields, *new, *states])

    def emit(part: pa.Table, begin: np.ndarray) -> pa.Table:
        n = len(part)
        end, out = kernel(begin.copy(), part.to_pandas())
        marks = {"__start": [begin.tolist()] + [None] * (n - 1),
                 "__end": [None] * (n - 1) + [np.asarray(end, float).tolist()]}
        part = append_columns(part, out)
        for name, values in marks.items():
            part = part.append_column(name, pa.array(values, pa.list_(pa.float64())))
        return part

    def guessed(part: pa.Table) -> pa.Table:
        part = part.sort_by(time).combine_chunks()
        own = np.asarray(part["__part"]) == np.asarray(part[IDX]) // block
        begin = start.copy()
        if (~own).any():
            begin, _ = kernel(begin, part.filter(pa.array(~own)).to_pandas())
        mine = part.filter(pa.array(own)).drop_columns(["__part"])
        if len(mine) == 0:
            types = {f.name: pa.float64() for f in new} | {f.name: pa.list_(pa.float64()) for f in states}
            for name, kind in types.items():
                mine = mine.append_column(name, pa.array([], kind))
            return mine
        return emit(mine, np.asarray(begin, float))

    framed = rows.withColumn(
        "__part", F.explode(F.sequence(F.col(BLK), F.floor((F.col(IDX) + warm) / F.lit(block))))
    )
    done = durable(framed.groupBy(symbol, "__part").applyInArrow(guessed, schema))

    def again(part: pa.Table) -> pa.Table:
        part = part.sort_by(time).combine_chunks()
        return emit(part.drop_columns(["__want"]), np.array(part["__want"][0].as_py(), dtype=float))

    while True:
        ends = done.where(F.col("__end").isNotNull()).select(
            symbol, (F.col(BLK) + 1).alias(BLK), F.col("__end").alias("__want")
        )
        wrong = durable(
            done.where(F.col("__start").isNotNull()).select(symbol, BLK, "__start")
            .join(ends, [symbol, BLK]).where(F.col("__start") != F.col("__want"))
            .select(symbol, BLK, "__want")
        )
        if wrong.isEmpty():
            return done.select(*base, *outputs)
        redo = rows.join(wrong, [symbol, BLK]).select(*rows.columns, "__want")
        fixed = redo.groupBy(symbol, BLK).applyInArrow(again, schema)
        done = durable(
            done.join(wrong.select(symbol, BLK), [symbol, BLK], "left_anti").select(*fixed.columns).union(fixed)
        )
