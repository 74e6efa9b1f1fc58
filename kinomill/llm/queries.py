"""All queries of the subpackage, each with the SQL it is held against where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("topn_queries", "bpe_queries", "leaks_queries", "forest_queries", "texttype_queries", "neighbours_queries", "matching_queries")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"kinomill.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
