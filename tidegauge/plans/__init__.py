"""Operators bound to concrete tables, each with its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("features", "series", "reports", "ingest", "learning", "streams", "files")


def load_catalog():
    """All registered queries by name."""
    for module in _MODULES:
        import_module(f"tidegauge.plans.{module}")
    from tidegauge.plans.catalog import CATALOG

    return CATALOG
