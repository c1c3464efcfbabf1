"""Imports every operator module, so that the registry is complete."""

from __future__ import annotations

import importlib
import pkgutil

from tallyforge import operators, streaming
from tallyforge.plans.registry import ORACLE_SQL, QUERIES

for package in (operators, streaming):
    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{package.__name__}.{module.name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
