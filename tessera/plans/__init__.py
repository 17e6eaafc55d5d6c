"""The registered queries; each module has QUERIES (name -> callable) and ORACLES (name -> SQL)."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in getattr(m, "QUERIES", {}).items()}


def oracles() -> dict:
    return {k: v for m in _modules() for k, v in getattr(m, "ORACLES", {}).items()}
