"""Ready-made queries over the supplied tables, each with the SQL that defines its result."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ("sources", "sinks", "cleaning", "profiling", "association", "charts", "ml")


def _modules():
    return [import_module(f"tabwright.queries.{section}") for section in SECTIONS]


def all_queries() -> dict:
    return {name: run for module in _modules() for name, run in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
