"""Registered queries with their equivalent SQL."""

from importlib import import_module

MODULES = [
    "features", "contracts", "monitoring", "evaluation", "texts", "graphs", "pods", "evidences",
    "streams", "learning",
]


def load():
    """Import every query module and return the registry."""
    for name in MODULES:
        import_module(f"failscope.plans.{name}")
    return import_module("failscope.plans.registry")
