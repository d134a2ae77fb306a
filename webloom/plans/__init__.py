"""Registered queries. Importing the package fills the registry."""

import importlib
import pkgutil

from webloom.plans.registry import ORACLES, QUERIES

for _module in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
