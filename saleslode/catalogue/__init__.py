"""Every operator as a named query with its ANSI-SQL twin.

Each module offers ``QUERIES`` (name -> function of session and table folder) and
``ORACLES`` (name -> SQL text over the same tables).
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("gold", "ranks", "columns", "silver", "quality", "analytics", "warehouse",
           "serving", "models", "lake", "published")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"{__name__}.{name}"), attribute).items():
            if key in merged:
                raise ValueError(f"query name used twice: {key}")
            merged[key] = value
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict[str, str]:
    return _merged("ORACLES")
