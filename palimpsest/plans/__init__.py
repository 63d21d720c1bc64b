"""Registered queries: bindings of the given tables, the Spark form and its SQL twin."""

from importlib import import_module

MODULES = ("bindings", "texts", "pages", "versions", "searching", "changes", "sources", "operations", "streams")


def load() -> dict:
    """Import every plan module and return the registry."""
    for name in MODULES:
        import_module(f"palimpsest.plans.{name}")
    from palimpsest.plans.registry import REGISTRY

    return REGISTRY
