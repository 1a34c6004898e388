"""All registered queries."""

from __future__ import annotations

import importlib

from trialsift.plans.registry import REGISTRY

_MODULES = ("decisions", "evaluation", "batch", "trace", "structure", "retrieval", "registry_records", "context", "quotes", "exports", "streams", "files")


def load():
    for name in _MODULES:
        importlib.import_module(f"trialsift.plans.{name}")
    return REGISTRY
