"""Checked queries, grouped by area. Importing this package fills the registry."""

import importlib

from wiretally.plans.catalog.registry import QUERIES

_AREAS = ("windows", "columns", "verdicts", "records", "stored", "learning", "live")

for _a in _AREAS:
    importlib.import_module(f"wiretally.plans.catalog.{_a}")

__all__ = ["QUERIES"]
