"""Queries over the driver's tables: inputs are derived from whole tables by plain arithmetic."""

from __future__ import annotations

import importlib

MODULES = ("field_queries", "text_queries", "box_queries", "key_queries", "run_queries", "context_queries")


def all_queries():
    """(queries by name, SQL twins by name)"""
    from . import registry

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLES
