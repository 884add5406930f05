"""Operators of a training-data pipeline, and their registered queries."""

from __future__ import annotations


def load_queries():
    """The queries of this subpackage by name, the pipeline included."""
    from tidegauge.llm.queries import CATALOG

    return CATALOG
