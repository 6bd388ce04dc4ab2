"""Feature/label dataset: lazy expressions, universe filter, processors, segments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import Expr
from barloom.operators import evaluate as ev
from barloom.plans.intervals import interval_join
from barloom.plans.panel import Panel
from barloom.sources.store import within

Processor = Callable[[DataFrame], DataFrame]
TRAIN, VALID, TEST = "train", "valid", "test"


@dataclass
class FeatureSet:
    """Named features and a label over a panel, evaluated as one plan."""

    panel: Panel
    periods: dict[str, tuple[str, str]]
    process_type: str = "append"  # learn processors run after infer ones, or on raw data
    features: dict[str, Expr] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    label: Expr | None = None
    infer_steps: list[Processor] = field(default_factory=list)
    learn_steps: list[Processor] = field(default_factory=list)
    raw: DataFrame | None = None
    infer: DataFrame | None = None
    learn: DataFrame | None = None

    def add_feature(self, name: str, expr: Expr | None = None, result: DataFrame | None = None) -> None:
        """A feature from an expression, or from a (datetime, vt_symbol, data) frame."""
        if (expr is None) == (result is None):
            raise ValueError("give either an expression or a result frame")
        if name in self.features or name in self.frames:
            raise ValueError(f"duplicate feature {name!r}")
        if expr is not None:
            self.features[name] = expr
        else:
            self.frames[name] = result

    def set_label(self, expr: Expr) -> None:
        self.label = expr

    def add_processor(self, task: str, step: Processor) -> None:
        {"infer": self.infer_steps, "learn": self.learn_steps}[task].append(step)

    def prepare(self, universe: DataFrame | None = None) -> DataFrame:
        """Keys, features, label; null to NaN; rows inside the universe's intervals."""
        exprs = dict(self.features) | ({"label": self.label} if self.label is not None else {})
        df = self.panel.select(exprs)
        for name, frame in self.frames.items():
            df = df.join(frame.select("datetime", "vt_symbol", F.col("data").alias(name)), ["datetime", "vt_symbol"], "left")
        order = ["datetime", "vt_symbol", *self.features, *self.frames] + (["label"] if self.label is not None else [])
        df = df.select(*order[:2], *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in order[2:]])
        if universe is not None:
            df = interval_join(df, universe.select("vt_symbol", "valid_from", "valid_to"), "vt_symbol", "datetime",
                               "valid_from", "valid_to").select(*order)
        self.raw = df
        return df

    def process(self) -> None:
        df = self.raw
        for step in self.infer_steps:
            df = df.transform(step)
        self.infer = df
        learn = df if self.process_type == "append" else self.raw
        for step in self.learn_steps:
            learn = learn.transform(step)
        self.learn = learn

    def fetch(self, kind: str, segment: str) -> DataFrame:
        """'raw', 'infer' or 'learn' rows of a segment's period."""
        frame = {"raw": self.raw, "infer": self.infer, "learn": self.learn}[kind]
        return within(frame, "datetime", *self.periods[segment])

    def feature_performance(self, name: str, quantiles: int = 10, horizon: int = 1) -> DataFrame:
        """Per date and quantile: mean forward return of the feature's buckets."""
        return ev.quantile_returns(self.panel.with_columns({"factor": self.features[name]}, keep=["close"]),
                                   quantiles, horizon)


def signal_performance(panel: Panel, signal: DataFrame, quantiles: int = 10, horizon: int = 1) -> DataFrame:
    rows = panel.df.select("datetime", "vt_symbol", "close").join(
        signal.select("datetime", "vt_symbol", F.col("signal").alias("factor")), ["datetime", "vt_symbol"], "left")
    return ev.quantile_returns(rows, quantiles, horizon)


def price_matrix(df: DataFrame, symbols: list[str]) -> DataFrame:
    """Dates x symbols for a named, bounded list of symbols."""
    return df.where(F.col("vt_symbol").isin(*symbols)).groupBy("datetime").pivot("vt_symbol", symbols).agg(F.first("close"))
