"""Registered queries with their SQL twins, one module per group of operators."""

from __future__ import annotations

from importlib import import_module

from checks.registry import REGISTRY

MODULES = [
    "sources",
    "sinks",
    "filters",
    "reshape",
    "joins",
    "aggregates",
    "latest",
    "ordering",
    "unions",
    "scalars",
    "packing",
    "streams",
    "history",
    "quality",
    "freesql",
]


def load() -> dict:
    """All registered queries, by name."""
    for name in MODULES:
        import_module(f"checks.{name}")
    return REGISTRY
