"""SQL text of a panel expression, for checking whole factor families in DuckDB.

A test aid only: each node becomes one column of a chain of CTEs, so another
engine evaluates the same formula with its own window, rank and recursion code.
"""

from __future__ import annotations

from barloom.functions.expr import Expr

from catalog.base import BARS, DIGITS, r

NAN, INF = "CAST('nan' AS DOUBLE)", "CAST('inf' AS DOUBLE)"


def _d(x): return f"CAST({x} AS DOUBLE)"


def _div(a, b): return f"({_d(a)} / {_d(b)})"


MAPS = {
    "_add": lambda a, b: f"({_d(a)} + {_d(b)})", "_sub": lambda a, b: f"({_d(a)} - {_d(b)})",
    "_mul": lambda a, b: f"({_d(a)} * {_d(b)})", "_neg": lambda a: f"(-{_d(a)})", "safe_div": _div,
    "_gt": lambda a, b: f"CAST({a} > {b} AS INTEGER)", "_ge": lambda a, b: f"CAST({a} >= {b} AS INTEGER)",
    "_lt": lambda a, b: f"CAST({a} < {b} AS INTEGER)", "_le": lambda a, b: f"CAST({a} <= {b} AS INTEGER)",
    "abs": lambda a: f"abs({a})", "pow": lambda a, b: f"pow({a}, {b})", "reverse": lambda a: f"list_reverse({a})",
    "_where": lambda c, a, b: f"CASE WHEN {c} = 1 THEN {_d(a)} ELSE {_d(b)} END",
    "_when_full": lambda v, c, n: f"CASE WHEN {c} = {n} THEN {v} END",
    "_position": lambda v, b: _d(f"list_position({v}, {b})"),
    "_rank_in_frame": lambda xs, v, n: f"CASE WHEN {xs} IS NOT NULL THEN (len(list_filter({xs}, lambda e: e < {v})) + "
                                       f"(len(list_filter({xs}, lambda e: e = {v})) + 1) / 2.0) / {n} END",
    "_interpolate": lambda xs, p: f"list_sort({xs})[CAST(floor({p}) AS INT) + 1] + (list_sort({xs})[CAST(ceil({p}) AS INT) + 1] "
                                  f"- list_sort({xs})[CAST(floor({p}) AS INT) + 1]) * ({p} - floor({p}))",
    "_weighted_age": lambda xs, n: f"list_sum(list_transform({xs}, lambda e, i: e * ({n} + 1 - i))) / ({n} * ({n} + 1) / 2)",
    "_no_inf_nan": lambda a: f"CASE WHEN isfinite({_d(a)}) THEN {a} END", "_no_inf": lambda a: f"CASE WHEN NOT isinf({_d(a)}) THEN {a} END",
    "_pair": lambda a, b: f"CASE WHEN {b} IS NOT NULL THEN {_d(a)} END",
    "_correlation": lambda c, va, vb, n: f"CASE WHEN {n} > 1 THEN CASE WHEN isfinite({c} / sqrt({va} * {vb})) THEN round({c} / sqrt({va} * {vb}), 12) "
                                       f"ELSE {c} / sqrt({va} * {vb}) END WHEN {n} = 1 THEN {NAN} END",
    "_least": lambda a, b: f"least({_d(a)}, {_d(b)})", "_greatest": lambda a, b: f"greatest({_d(a)}, {_d(b)})",
    "safe_log": lambda a: f"CASE WHEN {a} > 0 THEN ln({a}) WHEN {a} = 0 THEN -{INF} WHEN {a} < 0 THEN {NAN} END",
    "_zero": lambda a: f"coalesce({a}, 0)", "_scaled": lambda x, t: f"CASE WHEN {t} <> 0 THEN {_div(x, t)} ELSE 0 END",
    "_sign": lambda x: f"CASE WHEN {x} > 0 THEN 1.0 WHEN {x} < 0 THEN -1.0 ELSE 0.0 END",
    "_choose": lambda t, x, a, b: f"CASE WHEN {t} < {x} THEN {_d(a)} ELSE {_d(b)} END",
    "_signed_power": lambda x, e: f"CASE WHEN {x} > 0 THEN pow({_d(x)}, {e}) WHEN {x} < 0 THEN -pow(abs({_d(x)}), {e}) ELSE 0 END",
    "_power_by_row": lambda x, y: f"CASE WHEN {x} > 0 THEN pow({_d(x)}, {y}) WHEN {x} < 0 AND floor({y}) = {y} "
                                  f"THEN -pow(abs({_d(x)}), {y}) ELSE 0 END",
    "_or_nan": lambda x: f"coalesce({_d(x)}, {NAN})", "_index_if_number": lambda x, i: f"CASE WHEN NOT isnan({x}) THEN {i} END",
    "_show": lambda p, s, y: f"CASE WHEN {p} >= {s} THEN {_d(y)} ELSE {NAN} END",
    "_gain_a": lambda p, s, a: f"CASE WHEN {p} > {s} THEN {_d(a)} ELSE 0 END",
    "_gain_b": lambda p, s, seed, b: f"CASE WHEN {p} > {s} THEN {_d(b)} WHEN {p} = {s} THEN {_d(seed)} ELSE 0 END",
    "_ratio_100": lambda u, t: f"CASE WHEN {t} = 0 THEN {t} * 0 ELSE 100 * {u} / {t} END",
    "_sample_std": lambda s, n, w: f"CASE WHEN {n} = {w} THEN {s} END", "_only_full": lambda c, n, w: f"CASE WHEN {n} = {w} THEN {c} END",
    "_is_number": lambda x: f"CAST(NOT isnan({x}) AS INTEGER)", "_zero_if": lambda v: f"CASE WHEN {v} = 1 THEN 0.0 ELSE 1.0 END",
    "_one_unless": lambda v: f"CASE WHEN {v} = 1 THEN 0.0 ELSE 1.0 END", "_number_or_null": lambda x: f"CASE WHEN NOT isnan({x}) THEN {x} END",
    "_show_null": lambda s, n, y: f"CASE WHEN {s} >= {n} THEN {y} END",
    "_mean_skipping_null": lambda *xs: f"list_avg([{', '.join(_d(x) for x in xs)}])",
}
COMPARISONS = {"_gt", "_ge", "_lt", "_le"}
PART, BY_TIME = "PARTITION BY vt_symbol", "ORDER BY datetime"


def _bound(k: int) -> str:
    return "CURRENT ROW" if k == 0 else f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"


def family_sql(exprs: dict[str, Expr], base: str = BARS, source: str = "bars", digits: int = DIGITS) -> str:
    depth: dict[int, int] = {}
    order: list[Expr] = []

    def visit(e: Expr) -> int:
        if e.uid not in depth:
            d = max((visit(a) for a in e.args), default=0)
            depth[e.uid] = d + (e.op not in ("col", "lit"))
            order.append(e)
        return depth[e.uid]

    for e in exprs.values():
        visit(e)

    def ref(e: Expr) -> str:
        if e.op == "lit":
            v = e.params[0]
            return NAN if v != v else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
        return e.params[0] if e.op == "col" else f"n{e.uid}"

    def text(e: Expr) -> str:
        args = [ref(a) for a in e.args]
        if e.op == "map":
            return MAPS[e.params[0].__name__](*args)
        if e.op == "lag":
            n = e.params[0]
            return f"{'lag' if n > 0 else 'lead'}({args[0]}, {abs(n)}) OVER ({PART} {BY_TIME})"
        if e.op == "rowno":
            return f"row_number() OVER ({PART} {BY_TIME}) - 1"
        if e.op == "roll":
            agg, lo, hi = e.params
            frame = f"({PART} {BY_TIME} ROWS BETWEEN {_bound(lo)} AND {_bound(hi)})"
            if agg == "list":
                return f"list({args[0]}) FILTER ({args[0]} IS NOT NULL) OVER {frame}"
            return f"{agg}({', '.join(args)}) OVER {frame}"
        if e.op == "symagg":
            return f"{e.params[0]}({args[0]}) OVER ({PART})"
        if e.op == "running":
            return f"{e.params[0]}({args[0]}) OVER ({PART} {BY_TIME} ROWS UNBOUNDED PRECEDING)"
        if e.op == "dateagg":
            return f"{e.params[0]}({args[0]}) OVER (PARTITION BY datetime)"
        if e.op == "daterank":
            x = args[0]
            return (f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY datetime ORDER BY {x} NULLS LAST) + "
                    f"(count(*) OVER (PARTITION BY datetime, {x}) - 1) / 2.0 END")
        raise ValueError(e.op)

    ctes, last = [base], source
    for d in range(1, max(depth.values(), default=0) + 1):
        layer = [e for e in order if depth[e.uid] == d and e.op not in ("col", "lit")]
        plain, scans = [e for e in layer if e.op != "scan"], [e for e in layer if e.op == "scan"]
        if plain:
            cols = ", ".join(f"{text(e)} AS n{e.uid}" for e in plain)
            ctes.append(f"l{d} AS MATERIALIZED (SELECT *, {cols} FROM {last})")
            last = f"l{d}"
        if scans:
            feed = ", ".join(f"coalesce({_d(ref(e.args[0]))}, {NAN}) AS a{e.uid}, coalesce({_d(ref(e.args[1]))}, {NAN}) AS b{e.uid}"
                             for e in scans)
            ctes.append(f"f{d} AS MATERIALIZED (SELECT vt_symbol, datetime, row_number() OVER ({PART} {BY_TIME}) AS i, {feed} FROM {last})")
            first = ", ".join(f"b{e.uid} AS n{e.uid}" for e in scans)
            step = ", ".join(f"CASE WHEN s.a{e.uid} = 0 THEN s.b{e.uid} ELSE s.a{e.uid} * p.n{e.uid} + s.b{e.uid} END" for e in scans)
            ctes.append(f"w{d} AS (SELECT vt_symbol, datetime, i, {first} FROM f{d} WHERE i = 1 UNION ALL SELECT s.vt_symbol, s.datetime, s.i, {step} "
                        f"FROM w{d} p JOIN f{d} s ON s.vt_symbol = p.vt_symbol AND s.i = p.i + 1)")
            keep = ", ".join(f"w.n{e.uid}" for e in scans)
            ctes.append(f"j{d} AS MATERIALIZED (SELECT t.*, {keep} FROM {last} t JOIN w{d} w USING (vt_symbol, datetime))")
            last = f"j{d}"
    cols = ", ".join(
        f"{ref(e)} AS {name}" if e.op == "map" and e.params[0].__name__ in COMPARISONS else r(ref(e), name, digits)
        for name, e in exprs.items())
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT vt_symbol, datetime, {cols} FROM {last}"
