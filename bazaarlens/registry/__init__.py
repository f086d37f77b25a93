"""Registered queries with their check SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ("commerce", "behaviour", "tables", "recommendations", "sinks")


def load():
    """Import every area once; return (queries, check SQL)."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    from .core import ORACLE, QUERIES
    return QUERIES, ORACLE
