"""Composite jobs and the runnable queries built from the operators."""

from __future__ import annotations

import importlib
import pkgutil

from cartulary.plans.catalogue import REGISTRY, Query


def load_queries() -> dict[str, Query]:
    """Import every ``*_queries`` module of this package and return what they registered."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return dict(REGISTRY)
