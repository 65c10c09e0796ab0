"""All named queries of the package."""

from __future__ import annotations

import importlib

from memlake.registry.core import QUERIES, SQL, bind

MODULES = ("sources", "timeline", "search", "graph", "mining", "text", "plans", "monitor", "streams")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"memlake.registry.{m}")


def queries():
    _load()
    return {name: bind(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    _load()
    return dict(SQL)
