"""All registered queries of the library's own operators with their SQL: importing the modules fills the registry."""

from __future__ import annotations

import importlib
import importlib.util

from .context import ORACLES, QUERIES

for _part in ("text", "filters", "joins", "aggregates", "windows", "retrieval", "classify", "graph", "evaluation", "build", "streams"):
    if importlib.util.find_spec(f"{__package__}.{_part}_queries"):
        importlib.import_module(f"{__package__}.{_part}_queries")

__all__ = ["ORACLES", "QUERIES"]
