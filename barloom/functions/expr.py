"""Lazy panel expressions.

An ``Expr`` describes one value per panel row: a column, row arithmetic, a window
over a symbol's bars, a statistic over one date, or a linear recurrence along a
symbol. ``barloom.plans.panel`` turns a dictionary of them into one DataFrame.
Nodes are interned, so a sub-expression used by many factors is one node and is
computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from barloom.functions import safe

_NODES: dict[tuple, "Expr"] = {}


class Expr:
    __slots__ = ("op", "args", "params", "uid")

    def __new__(cls, op: str, args: tuple = (), params: tuple = ()):
        key = (op, tuple(a.uid for a in args), tuple((type(p).__name__, p) for p in params))
        node = _NODES.get(key)
        if node is None:
            node = object.__new__(cls)
            node.op, node.args, node.params, node.uid = op, tuple(args), tuple(params), len(_NODES)
            _NODES[key] = node
        return node

    def __add__(self, o): return apply(_add, self, o)
    def __radd__(self, o): return apply(_add, o, self)
    def __sub__(self, o): return apply(_sub, self, o)
    def __rsub__(self, o): return apply(_sub, o, self)
    def __mul__(self, o): return apply(_mul, self, o)
    def __rmul__(self, o): return apply(_mul, o, self)
    def __truediv__(self, o): return apply(safe.safe_div, self, o)
    def __rtruediv__(self, o): return apply(safe.safe_div, o, self)
    def __floordiv__(self, o): return apply(safe.floor_div, self, o)
    def __mod__(self, o): return apply(safe.floor_mod, self, o)
    def __pow__(self, o): return apply(F.pow, self, o)
    def __neg__(self): return apply(_neg, self)
    def __abs__(self): return apply(F.abs, self)
    def __gt__(self, o): return apply(_gt, self, o)
    def __ge__(self, o): return apply(_ge, self, o)
    def __lt__(self, o): return apply(_lt, self, o)
    def __le__(self, o): return apply(_le, self, o)
    def __eq__(self, o): return apply(_eq, self, o)
    def __ne__(self, o): return apply(_ne, self, o)
    def __hash__(self): return hash(self.uid)
    def __repr__(self): return f"Expr({self.op}, {self.params}, args={[a.uid for a in self.args]})"
    def __bool__(self): raise TypeError("a panel expression has no truth value; use where()")


def _num(c):
    return safe.dbl(c)


def _add(a, b): return _num(a) + _num(b)
def _sub(a, b): return _num(a) - _num(b)
def _mul(a, b): return _num(a) * _num(b)
def _neg(a): return -_num(a)
def _gt(a, b): return (a > b).cast("int")
def _ge(a, b): return (a >= b).cast("int")
def _lt(a, b): return (a < b).cast("int")
def _le(a, b): return (a <= b).cast("int")
def _eq(a, b): return (a == b).cast("int")
def _ne(a, b): return (a != b).cast("int")


def col(name: str) -> Expr:
    return Expr("col", (), (name,))


def lit(value) -> Expr:
    return Expr("lit", (), (value,))


def as_expr(x) -> Expr:
    return x if isinstance(x, Expr) else lit(x)


def apply(fn: Callable, *args) -> Expr:
    """Row-wise function of Columns; ``fn`` must be a module-level callable."""
    return Expr("map", tuple(as_expr(a) for a in args), (fn,))


def roll(agg: str, *xs, lo: int, hi: int = 0) -> Expr:
    """Aggregate over bars ``lo..hi`` relative to the row, inside one symbol."""
    return Expr("roll", tuple(as_expr(x) for x in xs), (agg, lo, hi))


def shift(x, n: int) -> Expr:
    return as_expr(x) if n == 0 else Expr("lag", (as_expr(x),), (n,))


def bar_index() -> Expr:
    """Zero-based position of the bar inside its symbol."""
    return Expr("rowno")


def running(agg: str, x) -> Expr:
    """Aggregate from the symbol's first bar to this one (sum, min, max, count)."""
    return Expr("running", (as_expr(x),), (agg,))


def per_symbol(agg: str, x) -> Expr:
    return Expr("symagg", (as_expr(x),), (agg,))


def per_date(agg: str, x) -> Expr:
    return Expr("dateagg", (as_expr(x),), (agg,))


def date_rank(x) -> Expr:
    """Average rank (1..n) of the non-null values of one date."""
    return Expr("daterank", (as_expr(x),))


def recurrence(a, b) -> Expr:
    """y[t] = a[t] * y[t-1] + b[t] along each symbol; a[t] = 0 restarts it."""
    return Expr("scan", (as_expr(a), as_expr(b)))


def where(cond, a, b) -> Expr:
    return apply(_where, cond, a, b)


def _where(c, a, b): return F.when(c == 1, _num(a)).otherwise(_num(b))


open_, high, low, close = col("open"), col("high"), col("low"), col("close")
volume, turnover, vwap = col("volume"), col("turnover"), col("vwap")
