"""The registered queries of this subpackage: QUERIES (name -> callable) and ORACLES (name -> SQL)."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}
for _name in ("leakage_queries", "subject_queries", "packing_queries", "splitting_queries", "conversation_queries", "vector_queries"):
    _m = importlib.import_module(f"tessera.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= getattr(_m, "ORACLES", {})
