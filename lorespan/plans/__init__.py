"""Registered queries by subject."""

from __future__ import annotations

from importlib import import_module

from lorespan.plans.registry import ENTRIES, Entry

MODULES = ("cleaning", "chunking", "retrieval", "evaluation", "analytics", "filters", "streams")


def load() -> dict[str, Entry]:
    for m in MODULES:
        import_module(f"lorespan.plans.{m}")
    return dict(ENTRIES)
