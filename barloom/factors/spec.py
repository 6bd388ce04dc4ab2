"""Named factors: registry helpers, required columns, extraction to a wide frame."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import Expr
from barloom.plans.panel import Panel


@dataclass(frozen=True)
class Factor:
    name: str
    expr: Expr
    category: str

    @property
    def required_columns(self) -> tuple[str, ...]:
        """Source columns, read off the expression."""
        found, stack, seen = set(), [self.expr], set()
        while stack:
            e = stack.pop()
            if e.uid in seen:
                continue
            seen.add(e.uid)
            if e.op == "col":
                found.add(e.params[0])
            stack.extend(e.args)
        return tuple(sorted(found))


def family(category: str, exprs: dict[str, Expr], tags: dict[str, str] | None = None) -> list[Factor]:
    tags = tags or {}
    return [Factor(n, e, tags.get(n, category)) for n, e in exprs.items()]


def names(factors: list[Factor]) -> list[str]:
    return [f.name for f in factors]


def expressions(factors: list[Factor]) -> dict[str, Expr]:
    return {f.name: f.expr for f in factors}


def dedupe(factors: list[Factor]) -> list[Factor]:
    """Keep the first factor of each expression (equal expressions are one node)."""
    seen: set[int] = set()
    return [f for f in factors if not (f.expr.uid in seen or seen.add(f.expr.uid))]


def of_category(factors: list[Factor], category: str) -> list[Factor]:
    return [f for f in factors if f.category == category]


def snake_case(name: str) -> str:
    """emaFast -> ema_fast"""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


REGIMES = ("bull_active", "range_neutral", "weak_defensive", "bear_pause", "unknown")


def with_regime_flags(df: DataFrame) -> DataFrame:
    """Derive rank_score, heat_score and 0/1 regime columns where they are absent."""
    if "rank_score" not in df.columns and "rank" in df.columns:
        df = df.withColumn("rank_score", F.col("rank").cast("double"))
    if "heat_score" not in df.columns and "rank_score" in df.columns:
        df = df.withColumn("heat_score", F.col("rank_score").cast("double"))
    if "market_regime" in df.columns:
        df = df.withColumns({
            f"regime_{r}": (F.col("market_regime") == r).cast("int")
            for r in REGIMES if f"regime_{r}" not in df.columns
        })
    return df


def extract(panel: Panel, factors: list[Factor], category: str | None = None) -> DataFrame:
    """One wide frame (keys + a column per factor), after checking the source columns."""
    if category is not None:
        factors = of_category(factors, category)
    panel = panel.transform(with_regime_flags)
    missing = sorted({c for f in factors for c in f.required_columns} - set(panel.df.columns))
    if missing:
        raise ValueError(f"panel lacks columns required by the selected factors: {', '.join(missing)}")
    return panel.select(expressions(factors))
