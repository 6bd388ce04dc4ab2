"""Exact quantiles of whole columns by rounds of range counts.

A quantile sketch brackets each wanted order statistic: its error is bounded, so
the bracket is known to hold the statistic, and the next pass counts exactly what
lies below and inside. Brackets that still hold many rows are sketched again from
the inside. At last the few values inside are counted and walked in order. Each
pass is one aggregate with partial results per task: no task ever holds the values
of a column, and the driver sees one number per column and quantile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative rank error of the sketch is one over this.
ACCURACY = 10_000
#: Rows inside a bracket that the last pass may sort (of one order statistic).
INSIDE = 200_000


@dataclass
class Bracket:
    column: int
    rank: int  # from 0
    low: float
    high: float
    below: int = 0
    inside: int = 0

    @property
    def settled(self) -> bool:
        return self.low == self.high


def exact_quantiles(df: DataFrame, columns: dict[str, Column] | list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column, nulls and NaN left out (None: no values)."""
    exprs = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    names = [f"v{i}" for i in range(len(exprs))]
    rows = df.select(*[F.nanvl(x.cast("double"), F.lit(None).cast("double")).alias(n) for n, x in zip(names, exprs.values())])
    top = rows.agg(*[F.count(n).alias(n) for n in names]).first()
    counts = [top[n] for n in names]
    ranks = [sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) if n else [] for n in counts]
    brackets = [Bracket(i, r, -math.inf, math.inf, 0, n) for i, n in enumerate(counts) for r in ranks[i]]
    _narrow(rows, brackets)
    found = {(b.column, b.rank): b.low for b in brackets if b.settled}
    found |= _select(rows, [b for b in brackets if not b.settled])
    out = {}
    for i, name in enumerate(exprs):
        n, values = counts[i], []
        for p in probs:
            at = p * (n - 1)
            if not n:
                values.append(None)
                continue
            lo, hi = found[i, math.floor(at)], found[i, math.ceil(at)]
            values.append(lo if lo == hi else lo + (hi - lo) * (at - math.floor(at)))
        out[name] = values
    return out


def _within(b: Bracket) -> Column:
    v = F.col(f"v{b.column}")
    return v.between(F.lit(b.low), F.lit(b.high))


def _narrow(rows: DataFrame, brackets: list[Bracket]) -> None:
    """Tighten brackets in place until each is one value, small, or does not get smaller."""
    open_ = [b for b in brackets if b.inside > INSIDE]
    while open_:
        error = 2.0 / ACCURACY
        asked = []
        for b in open_:
            at = (b.rank - b.below + 0.5) / b.inside
            asked.append(F.percentile_approx(F.when(_within(b), F.col(f"v{b.column}")), [max(0.0, at - error), min(1.0, at + error)], ACCURACY))
        ends = rows.agg(*[x.alias(f"q{k}") for k, x in enumerate(asked)]).first()
        tried = [Bracket(b.column, b.rank, *ends[f"q{k}"]) for k, b in enumerate(open_)]
        _count(rows, tried)
        again = []
        for b, t in zip(open_, tried):
            if not t.below <= b.rank < t.below + t.inside:
                raise RuntimeError("a quantile sketch broke its error bound")
            shrunk = t.inside < b.inside
            b.low, b.high, b.below, b.inside = t.low, t.high, t.below, t.inside
            if shrunk and b.inside > INSIDE and not b.settled:
                again.append(b)
        open_ = again


def _count(rows: DataFrame, brackets: list[Bracket]) -> None:
    got = rows.agg(*[x for k, b in enumerate(brackets) for x in (
        F.count_if(F.col(f"v{b.column}") < F.lit(b.low)).alias(f"b{k}"), F.count_if(_within(b)).alias(f"i{k}"))]).first()
    for k, b in enumerate(brackets):
        b.below, b.inside = got[f"b{k}"], got[f"i{k}"]


def _select(rows: DataFrame, brackets: list[Bracket]) -> dict[tuple[int, int], float]:
    """The order statistics inside small brackets; equal values are one row before any order is made."""
    if not brackets:
        return {}
    hits = F.array_compact(F.array(*[F.when(_within(b), F.struct(F.lit(k).alias("k"), F.col(f"v{b.column}").alias("v"))) for k, b in enumerate(brackets)]))
    values = rows.select(F.explode(hits).alias("x")).select("x.*").groupBy("k", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.element_at(F.array(*[F.lit(b.rank - b.below) for b in brackets]), F.col("k") + 1)
    upto = values.withColumn("upto", F.sum("n").over(order)).where((F.col("upto") > wanted) & (F.col("upto") - F.col("n") <= wanted))
    return {(brackets[r.k].column, brackets[r.k].rank): r.v for r in upto.collect()}  # one row an order statistic
