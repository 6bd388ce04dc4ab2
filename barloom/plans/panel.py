"""Evaluation of panel expressions as staged DataFrame operations.

Window work alternates between two layouts: per symbol and per date. Expressions
are grouped so that all work of one layout runs before the next shuffle:

* symbol stage - trailing and leading frames, lags: one exchange, one sort
* whole-symbol stage - per-symbol and running aggregates, same layout
* recurrence stage - y = a*y + b along the bars, a parallel prefix on Arrow batches
* date stage - cross-sectional aggregates and ranks

When ``oversized`` finds a symbol (or date) too large for one task, the same
stages run on fixed-size blocks of bars with a halo (or on pre-aggregated
values), so a hot group is spread over many tasks and the result is unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.expr import Expr
from barloom.plans import skew
from barloom.plans.prefix import scan_rows
from barloom.session import durable

IDX, BLK = "__idx", "__blk"
# From this many ranks of one date on, one Arrow pass over the (checked, bounded)
# date replaces a sort of all live columns per rank.
BULK_RANKS = 4
KIND = {"roll": 0, "lag": 0, "rowno": 0, "symagg": 1, "running": 1, "scan": 2, "dateagg": 3, "daterank": 3}


@dataclass(frozen=True)
class Panel:
    """A DataFrame keyed by (symbol, time), at most one row per key."""

    df: DataFrame
    symbol: str = "vt_symbol"
    time: str = "datetime"
    max_group_rows: int | None = None
    #: Keys found to have a group too large for one task (or none), measured once; a panel
    #: with some of the rows of another takes that one's answers.
    oversized: dict[str, bool] = field(default_factory=dict, compare=False, repr=False)

    def with_columns(self, exprs: dict[str, Expr], keep: list[str] | None = None) -> DataFrame:
        """The panel's rows with one column per expression; ``keep`` limits the others."""
        return _Evaluation(self, exprs, keep).run()

    def select(self, exprs: dict[str, Expr]) -> DataFrame:
        return self.with_columns(exprs, keep=[])

    def filter(self, expr: Expr) -> DataFrame:
        return self.with_columns({"__flag": expr}).where(F.col("__flag") == 1).drop("__flag")

    def measured(self, keys: list[str], df: DataFrame | None = None) -> dict[str, bool]:
        """``oversized`` with answers for ``keys``; ``df`` is the panel with the columns in use."""
        missing = [k for k in keys if k not in self.oversized]
        if missing:
            self.oversized.update(skew.oversized(self.df if df is None else df, missing, self.max_group_rows))
        return self.oversized

    def transform(self, fn) -> "Panel":
        return replace(self, df=fn(self.df), oversized={})


def evaluate(df: DataFrame, exprs: dict[str, Expr], **kw) -> DataFrame:
    """Shorthand: keys plus the named expressions of a bar panel."""
    return Panel(df, **kw).select(exprs)


# ------------------------------------------------------------------ aggregates
def _array_frame(x: Column) -> Column:
    return F.collect_list(x)


AGGS = {
    "avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
    # variances as covariances, and these with their sides changed: the running mean then enters a product
    # in the order of SQL engines, so that two bars lose the same digits and rank alike
    "stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp, "var_pop": lambda x: F.covar_pop(x, x),
    "covar_pop": lambda x, y: F.covar_pop(y, x), "product": F.product, "list": _array_frame, "median": F.median,
    "first": lambda x: F.first(x, ignorenulls=True), "last": lambda x: F.last(x, ignorenulls=True),
}


class _Evaluation:
    def __init__(self, panel: Panel, exprs: dict[str, Expr], keep: list[str] | None):
        self.panel, self.exprs = panel, exprs
        self.symbol, self.time = panel.symbol, panel.time
        keys = [self.symbol, self.time]
        kept = panel.df.columns if keep is None else keep
        self.keep = [c for c in kept if c not in keys and c not in exprs]
        self.stage: dict[int, int] = {}
        self.nodes: list[Expr] = []
        self.uses: dict[int, int] = {}
        for e in exprs.values():
            self._visit(e)
        self.limit = panel.max_group_rows
        self.block = self.limit or skew.MAX_GROUP_ROWS
        self.temp: dict[int, str] = {}
        self.frontier_memo: dict[int, frozenset] = {}
        self.carried: set[int] = set()

    # ---------------------------------------------------------------- analysis
    def _visit(self, e: Expr) -> int:
        self.uses[e.uid] = self.uses.get(e.uid, 0) + 1
        if e.uid in self.stage:
            return self.stage[e.uid]
        low = max((self._visit(a) for a in e.args), default=0)
        if e.op in KIND:
            while low % 4 != KIND[e.op]:
                low += 1
        self.stage[e.uid] = low
        self.nodes.append(e)
        return low

    def _frontier(self, e: Expr) -> frozenset:
        """Window nodes and columns that a row-wise expression reads."""
        got = self.frontier_memo.get(e.uid)
        if got is None:
            if e.op == "map" and e.uid not in self.carried:
                got = frozenset().union(*(self._frontier(a) for a in e.args))
            else:
                got = frozenset() if e.op == "lit" else frozenset([e])
            self.frontier_memo[e.uid] = got
        return got

    def _reach(self, nodes: list[Expr]) -> dict[int, tuple[int, int]]:
        """Bars back and ahead each symbol-stage node reads, nested frames added up."""
        reach: dict[int, tuple[int, int]] = {}
        inside = {n.uid for n in nodes}

        def of(e: Expr) -> tuple[int, int]:
            if e.uid in reach:
                return reach[e.uid]
            back = ahead = 0
            if e.op == "map" or e.uid in inside:
                kids = [of(a) for a in e.args]
                back, ahead = max((k[0] for k in kids), default=0), max((k[1] for k in kids), default=0)
            if e.uid in inside and e.op == "roll":
                back, ahead = back + max(0, -e.params[1]), ahead + max(0, e.params[2])
            elif e.uid in inside and e.op == "lag":
                back, ahead = back + max(0, e.params[0]), ahead + max(0, -e.params[0])
            reach[e.uid] = back, ahead
            return reach[e.uid]

        for n in nodes:
            of(n)
        return reach

    # ------------------------------------------------------------- compilation
    def _c(self, e: Expr) -> Column:
        name = self.temp.get(e.uid)
        if name is not None:
            return F.col(name)
        if e.op == "col":
            return F.col(e.params[0])
        if e.op == "lit":
            return F.lit(e.params[0])
        if e.op == "map":
            return e.params[0](*(self._c(a) for a in e.args))
        raise RuntimeError(f"{e!r} used before its stage")

    def _name(self, e: Expr) -> str:
        return f"__x{e.uid}"

    def _materialize_maps(self, df: DataFrame, wanted: list[Expr]) -> DataFrame:
        """Give shared row-wise nodes a column of their own, innermost first."""
        levels: dict[int, list[Expr]] = {}
        seen: dict[int, int] = {}

        def depth(e: Expr) -> int:
            if e.uid in seen:
                return seen[e.uid]
            if e.op != "map" or e.uid in self.temp:
                seen[e.uid] = 0
                return 0
            d = max((depth(a) for a in e.args), default=0)
            heavy = self.uses[e.uid] > 1 or any(
                a.op == "map" and a.params[0].__name__ == "safe_div" for a in e.args
            )
            if heavy:
                levels.setdefault(d, []).append(e)
                d += 1
            seen[e.uid] = d
            return d

        for e in wanted:
            depth(e)
        for d in sorted(levels):
            cols = {self._name(e): self._c(e) for e in levels[d]}
            df = df.withColumns(cols)
            self.temp.update({e.uid: self._name(e) for e in levels[d]})
        return df

    # --------------------------------------------------------------- execution
    def run(self) -> DataFrame:
        leaves = {e.params[0] for e in self.nodes if e.op == "col"}
        keys = [self.symbol, self.time]
        df = self.panel.df.select(*keys, *self.keep, *sorted(leaves - set(keys) - set(self.keep)))
        work = [n for n in self.nodes if n.op in KIND]
        kinds = {n.op for n in work}
        self.hot_symbol = self.hot_date = False
        by_symbol = bool(kinds & {"roll", "lag", "rowno", "symagg", "running", "scan"})
        by_date = bool(kinds & {"dateagg", "daterank"})
        if by_symbol or by_date:
            names = ([self.symbol] if by_symbol else []) + ([self.time] if by_date else [])
            found = self.panel.measured(names, df)
            self.hot_symbol, self.hot_date = found.get(self.symbol, False), found.get(self.time, False)
        # Rolling frames cost far more CPU than bytes, and adaptive execution sizes tasks
        # by bytes: a small panel would end up on one core. Larger ones are left to it.
        size = None if self.hot_symbol or self.hot_date else skew.estimated_bytes(df)
        self.spread = size is not None and size <= skew.SMALL_INPUT_BYTES
        self.layout = None
        if self.hot_symbol:
            df = durable(skew.with_row_index(df, self.symbol, self.time, self.block, IDX))
        stages = sorted({self.stage[n.uid] for n in work})
        for s in stages:
            nodes = [n for n in work if self.stage[n.uid] == s]
            df = self._run_stage(df, s, nodes)
            df = self._prune(df, s, work)
        df = self._materialize_maps(df, list(self.exprs.values()))
        return df.select(
            *keys, *self.keep, *[self._c(e).alias(name) for name, e in self.exprs.items()]
        )

    def _prune(self, df: DataFrame, s: int, work: list[Expr]) -> DataFrame:
        """Keep what later stages need, as the fewest values a row: they cross the next exchange."""
        wanted = [*self.exprs.values(), *(a for n in work if self.stage[n.uid] > s for a in n.args)]
        if any(self.stage[n.uid] > s for n in work):
            df = self._carry(df, s, wanted)
        live = set().union(*(self._frontier(e) for e in wanted))
        names = [self.symbol, self.time, *self.keep] + ([IDX] if self.hot_symbol else [])
        for e in sorted(live, key=lambda n: n.uid):
            name = e.params[0] if e.op == "col" else self.temp.get(e.uid)
            if name and name not in names:
                names.append(name)
        stay = {n.uid for n in work} | self.carried
        self.temp = {u: c for u, c in self.temp.items() if u in stay and c in names}
        return df.select(*names)

    def _carry(self, df: DataFrame, s: int, wanted: list[Expr]) -> DataFrame:
        """Compute row-wise values now where they are narrower than what they read.

        A frame held as a list, say, is dropped for the one rank taken from it. Values
        whose inputs are kept anyway, or are fewer than the values, wait.
        """
        ready: dict[int, Expr] = {}
        kept: set[Expr] = {Expr("col", (), (c,)) for c in self.keep}
        seen: set[int] = set()

        def visit(e: Expr) -> None:
            if e.uid in seen:
                return
            seen.add(e.uid)
            if e.op != "map" or e.uid in self.carried:
                if e.op in ("map", "col") or e.op in KIND and self.stage[e.uid] <= s:
                    kept.add(e)
            elif all(n.op not in KIND or self.stage[n.uid] <= s for n in self._frontier(e)):
                ready[e.uid] = e
            else:
                for a in e.args:
                    visit(a)

        for e in wanted:
            visit(e)
        weight = lambda n: 1 - n.params[1] + n.params[2] if n.op == "roll" and n.params[0] == "list" else 1
        extra = {u: self._frontier(e) - kept for u, e in ready.items()}
        while extra:
            # inputs that serve more values than they cost stay; every value that reads only those waits
            saved = {}
            for inputs in set(extra.values()):
                saved[inputs] = sum(x <= inputs for x in extra.values()) - sum(map(weight, inputs))
            best = max(saved, key=lambda x: (saved[x], -len(x), sorted(n.uid for n in x)))
            if saved[best] <= 0 and best:
                break
            kept |= best
            extra = {u: x - kept for u, x in extra.items() if not x <= best}
        chosen = [ready[u] for u in sorted(extra) if u not in self.temp]
        df = self._materialize_maps(df, chosen)
        missing = {self._name(e): self._c(e) for e in chosen if e.uid not in self.temp}
        df = df.withColumns(missing) if missing else df
        self.temp.update({e.uid: self._name(e) for e in chosen})
        self.carried |= set(extra)
        self.frontier_memo.clear()
        return df

    def _levels(self, nodes: list[Expr]) -> list[list[Expr]]:
        """Nodes of one stage in batches that only need earlier batches."""
        inside = {n.uid: n for n in nodes}
        memo: dict[int, int] = {}

        def level(e: Expr) -> int:
            if e.uid not in memo:
                d = max((level(a) for a in e.args), default=0)
                memo[e.uid] = d + 1 if e.uid in inside else d
            return memo[e.uid]

        batches: dict[int, list[Expr]] = {}
        for n in nodes:
            batches.setdefault(level(n), []).append(n)
        return [batches[k] for k in sorted(batches)]

    def _run_stage(self, df: DataFrame, s: int, nodes: list[Expr]) -> DataFrame:
        kind = s % 4
        split = kind == 0 and self.hot_symbol
        key = self.time if kind == 3 else self.symbol
        if self.spread and self.layout != key:
            df = df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)
        bulk = kind == 3 and sum(n.op == "daterank" for n in nodes) >= BULK_RANKS
        self.layout = None if kind == 2 or bulk else key  # grouped maps forget the layout
        parts = [self.symbol]
        if split:
            reach = self._reach(nodes)
            back = max(r[0] for r in reach.values())
            ahead = max(r[1] for r in reach.values())
            size = F.lit(self.block)
            first = F.greatest(F.lit(0), F.floor((F.col(IDX) - ahead) / size))
            last = F.floor((F.col(IDX) + back) / size)
            df = df.withColumn(BLK, F.explode(F.sequence(first, last)))
            parts.append(BLK)
        for batch in self._levels(nodes):
            df = self._materialize_maps(df, [a for n in batch for a in n.args])
            if kind == 0:
                df = df.withColumns({self._name(n): self._symbol_window(n, parts) for n in batch})
            elif kind == 1:
                df = self._whole_symbol(df, batch)
            elif kind == 2:
                df = self._recurrences(df, batch)
            else:
                df = self._cross_section(df, batch)
            self.temp.update({n.uid: self._name(n) for n in batch})
        if split:
            df = df.where(F.col(BLK) == F.floor(F.col(IDX) / F.lit(self.block)))
        return df

    def _symbol_window(self, n: Expr, parts: list[str]) -> Column:
        w = Window.partitionBy(*parts).orderBy(self.time)
        if n.op == "rowno":
            return F.col(IDX) if self.hot_symbol else (F.row_number().over(w) - 1).cast("long")
        if n.op == "lag":
            k = n.params[0]
            x = self._c(n.args[0])
            return (F.lag(x, k) if k > 0 else F.lead(x, -k)).over(w)
        agg, lo, hi = n.params
        frame, xs = w.rowsBetween(lo, hi), [self._c(a) for a in n.args]
        if agg == "stddev_pop":
            return F.sqrt(AGGS["var_pop"](*xs).over(frame))
        return AGGS[agg](*xs).over(frame)

    def _whole_symbol(self, df: DataFrame, batch: list[Expr]) -> DataFrame:
        if not self.hot_symbol:
            whole = Window.partitionBy(self.symbol)
            ordered = whole.orderBy(self.time).rowsBetween(Window.unboundedPreceding, 0)
            return df.withColumns({
                self._name(n): AGGS[n.params[0]](self._c(n.args[0])).over(whole if n.op == "symagg" else ordered)
                for n in batch
            })
        df = durable(df)
        totals = [n for n in batch if n.op == "symagg"]
        if totals:
            agg = df.groupBy(self.symbol).agg(
                *[AGGS[n.params[0]](self._c(n.args[0])).alias(self._name(n)) for n in totals]
            )
            df = df.join(agg, self.symbol)
        runs = [n for n in batch if n.op == "running"]
        if runs:
            df = df.withColumn(BLK, F.floor(F.col(IDX) / F.lit(self.block)))
            merge = {"count": "sum"}
            before = Window.partitionBy(self.symbol).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
            sums = df.groupBy(self.symbol, BLK).agg(
                *[AGGS[n.params[0]](self._c(n.args[0])).alias(f"__b{n.uid}") for n in runs]
            )
            carry = sums.select(self.symbol, BLK, *[
                AGGS[merge.get(n.params[0], n.params[0])](F.col(f"__b{n.uid}")).over(before).alias(f"__c{n.uid}")
                for n in runs
            ])
            local = Window.partitionBy(self.symbol, BLK).orderBy(self.time).rowsBetween(Window.unboundedPreceding, 0)
            df = df.join(carry, [self.symbol, BLK])
            out = {}
            for n in runs:
                here = AGGS[n.params[0]](self._c(n.args[0])).over(local)
                prior = F.col(f"__c{n.uid}")
                join = {
                    "sum": lambda p, h: F.coalesce(p + h, p, h),
                    "count": lambda p, h: F.coalesce(p, F.lit(0)) + h,
                    "min": F.least, "max": F.greatest,
                    "last": lambda p, h: F.coalesce(h, p), "first": lambda p, h: F.coalesce(p, h),
                }[n.params[0]]
                out[self._name(n)] = join(prior, here)
            df = df.withColumns(out).drop(BLK, *[f"__c{n.uid}" for n in runs])
        return df

    # -------------------------------------------------------------- recurrences
    def _recurrences(self, df: DataFrame, batch: list[Expr]) -> DataFrame:
        feeds = {}
        for n in batch:
            feeds[f"__a{n.uid}"] = F.coalesce(self._c(n.args[0]).cast("double"), F.lit(float("nan")))
            feeds[f"__b{n.uid}"] = F.coalesce(self._c(n.args[1]).cast("double"), F.lit(float("nan")))
        live = [c for c in df.columns if c not in feeds]
        df = df.withColumns(feeds)
        names = [self._name(n) for n in batch]
        pairs = [(f"__a{n.uid}", f"__b{n.uid}") for n in batch]
        if not self.hot_symbol:
            return scan_rows(df, [self.symbol], self.time, live, pairs, [(name,) for name in names])
        df = durable(df.withColumn(BLK, F.floor(F.col(IDX) / F.lit(self.block))))
        local = durable(
            scan_rows(df, [self.symbol, BLK], self.time, [*live, BLK], pairs, [(f"__y{n.uid}", f"__p{n.uid}", f"__r{n.uid}") for n in batch])
        )
        ends = local.groupBy(self.symbol, BLK).agg(*[
            F.max_by(F.struct(f"__y{n.uid}", f"__p{n.uid}", f"__r{n.uid}"), self.time).alias(f"__e{n.uid}")
            for n in batch
        ])
        chain = ends.select(self.symbol, BLK, *[
            c for n in batch for c in (
                F.when(F.col(f"__e{n.uid}")[f"__r{n.uid}"], F.lit(0.0))
                .otherwise(F.col(f"__e{n.uid}")[f"__p{n.uid}"]).alias(f"__a{n.uid}"),
                F.col(f"__e{n.uid}")[f"__y{n.uid}"].alias(f"__b{n.uid}"),
            )
        ])
        # one row per block: a symbol's chain of block ends is its rows / block size
        carried = scan_rows(chain, [self.symbol], BLK, [self.symbol, BLK], pairs, [(name,) for name in names])
        into = carried.select(
            self.symbol, (F.col(BLK) + 1).alias(BLK), *[F.col(self._name(n)).alias(f"__in{n.uid}") for n in batch]
        )
        joined = local.join(into, [self.symbol, BLK], "left")
        return joined.select(*live, *[
            F.when(F.col(f"__r{n.uid}") | F.col(f"__in{n.uid}").isNull(), F.col(f"__y{n.uid}"))
            .otherwise(F.col(f"__y{n.uid}") + F.col(f"__p{n.uid}") * F.col(f"__in{n.uid}"))
            .alias(self._name(n))
            for n in batch
        ])

    # ------------------------------------------------------------ cross-section
    def _cross_section(self, df: DataFrame, batch: list[Expr]) -> DataFrame:
        if not self.hot_date:
            whole = Window.partitionBy(self.time)
            ranks = [n for n in batch if n.op == "daterank"]
            bulk = len(ranks) >= BULK_RANKS
            out = {}
            for n in batch:
                x = self._c(n.args[0])
                if n.op == "dateagg":
                    out[self._name(n)] = AGGS[n.params[0]](x).over(whole)
                elif not bulk:
                    ordered = whole.orderBy(x.asc_nulls_last())
                    peers = F.count(F.lit(1)).over(ordered.rangeBetween(0, 0))
                    out[self._name(n)] = F.when(x.isNotNull(), F.rank().over(ordered) + (peers - 1) / F.lit(2.0))
            df = df.withColumns(out) if out else df
            if bulk:
                feeds = {f"__v{n.uid}": self._c(n.args[0]).cast("double") for n in ranks}
                df = _rank_groups(df.withColumns(feeds), self.time, df.columns, list(feeds), [self._name(n) for n in ranks])
            return df
        feeds = {f"__v{n.uid}": self._c(n.args[0]) for n in batch}
        df = durable(df.withColumns(feeds))
        plain = [n for n in batch if n.op == "dateagg" and n.params[0] != "median"]
        if plain:
            agg = df.groupBy(self.time).agg(
                *[AGGS[n.params[0]](F.col(f"__v{n.uid}")).alias(self._name(n)) for n in plain]
            )
            df = df.join(agg, self.time)
        done = {n.uid for n in plain}
        for n in batch:
            if n.uid in done:
                continue
            v = f"__v{n.uid}"
            counts = skew.value_counts(df.select(self.time, v), self.time, v, self.block)
            if n.op == "daterank":
                ranks = counts.select(
                    self.time, v, (F.col("__before") + (F.col("__cnt") + 1) / F.lit(2.0)).alias(self._name(n))
                )
                df = df.join(ranks, [self.time, v], "left")
            else:
                counts = durable(counts)
                size = counts.groupBy(self.time).agg(F.sum("__cnt").alias("__n"))
                lo, hi = F.floor((F.col("__n") + 1) / 2), F.ceil((F.col("__n") + 1) / 2)
                holds = lambda pos: (F.col("__before") < pos) & (pos <= F.col("__before") + F.col("__cnt"))
                mid = counts.join(size, self.time).groupBy(self.time).agg(
                    ((F.max(F.when(holds(lo), F.col(v))) + F.max(F.when(holds(hi), F.col(v)))) / 2.0)
                    .alias(self._name(n))
                )
                df = df.join(mid, self.time, "left")
        return df.drop(*feeds)


def append_columns(table: pa.Table, columns: dict[str, np.ndarray]) -> pa.Table:
    """Add numpy columns to an Arrow table; NaN stays NaN (pandas would make it null)."""
    for name, values in columns.items():
        table = table.append_column(name, pa.array(values, from_pandas=False))
    return table


def average_rank(values: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Average ranks of the present values; NaN is the largest and ties with NaN."""
    out = np.full(len(values), np.nan)
    _, place, counts = np.unique(values[~missing], return_inverse=True, return_counts=True)
    out[~missing] = (np.cumsum(counts) - (counts - 1) / 2.0)[place]
    return out


def _rank_groups(df: DataFrame, group: str, live: list[str], feeds: list[str], names: list[str]) -> DataFrame:
    """Average ranks of several columns inside each group, in one pass."""
    fields = [df.schema[c] for c in live] + [T.StructField(n, T.DoubleType()) for n in names]

    def run(rows: pa.Table) -> pa.Table:
        out = rows.select(live)
        for feed, name in zip(feeds, names):
            column = rows[feed]
            missing = column.is_null().to_numpy()
            ranks = average_rank(column.fill_null(0.0).to_numpy(), missing)
            out = out.append_column(name, pa.array(ranks, mask=missing))
        return out

    return df.select(*dict.fromkeys([*live, *feeds])).groupBy(group).applyInArrow(run, T.StructType(fields))
