"""Registered queries: one per operator or operator family, with the SQL that checks it."""

import importlib

MODULES = ("operators_basic", "indicators", "factors", "evaluation", "portfolio", "storage", "events")


def load():
    """Import every query module once and return the registry module.

    A module that fails half-way leaves none of its names behind, so the next
    call meets the real error again and not a duplicate name.
    """
    base = importlib.import_module("catalog.base")
    for name in MODULES:
        before = set(base.QUERIES)
        try:
            importlib.import_module(f"catalog.{name}")
        except BaseException:
            for new in set(base.QUERIES) - before:
                base.QUERIES.pop(new)
                base.ORACLE.pop(new, None)
            raise
    return base
