"""Registered queries, one module per area."""

from __future__ import annotations

import importlib

_AREAS = ("library", "timeline", "catalog", "text", "chunks", "quality", "state", "dialogue", "evaluation",
          "signals", "files", "streams", "settings")


def load_all():
    """Import every area once and return the registry."""
    from lectern.plans import registry

    for area in _AREAS:
        importlib.import_module(f"lectern.plans.{area}")
    return registry
