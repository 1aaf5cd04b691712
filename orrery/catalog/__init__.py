"""Registered queries (one per operator of the survey) with DuckDB oracles."""

from __future__ import annotations

import importlib

MODULES = ["series", "cover", "arrival", "forecast", "features", "model", "risk", "text"]


def load_registry():
    from .common import REGISTRY

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY
