"""Registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from edgetide.catalog.registry import ORACLES, QUERIES, Query


def load() -> dict[str, Query]:
    """All queries, after importing every module of this package."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return dict(QUERIES)
