"""Imports every query module once, so that the registry is complete."""

from __future__ import annotations

import importlib
import pkgutil

from shelfmark import plans
from shelfmark.plans.registry import ORACLE, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.endswith("_queries")):
    importlib.import_module(f"shelfmark.plans.{_module}")

__all__ = ["ORACLE", "QUERIES"]
