"""Domain tables derived from the driver's parquet, and every registered query with its SQL counterpart."""

from __future__ import annotations

import importlib

MODULES = ["selection", "evaluation", "normalisation", "photos", "drawing", "clouds", "files", "pictures", "outlines"]


def load():
    """(queries, SQL counterparts) of all query modules."""
    for name in MODULES:
        importlib.import_module(f"aerolens.catalog.{name}")
    from aerolens.catalog import registry

    return registry.QUERIES, registry.ORACLES
