"""Collects the registered queries of all plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ["mobility", "places", "tensors", "factors", "parsing"]


def _modules():
    return [import_module(f"urbanflow.plans.{name}") for name in MODULES]


def all_queries() -> dict[str, Callable]:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
