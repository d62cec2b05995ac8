"""Queries over the given tables, one per operator."""

from importlib import import_module

MODULES = ["tables", "files", "selections", "journals", "config", "runs", "extraction", "streams"]


def load_all() -> None:
    """Imports every module that registers queries."""
    for name in MODULES:
        import_module(f"parcelry.plans.{name}")
