"""Runnable queries over the given tables."""

from __future__ import annotations

from importlib import import_module

from corpusmill.querybook.registry import ORACLES, QUERIES

_MODULES = ("text_queries", "manifest_queries", "search_queries", "answer_queries", "flow_queries")


def load() -> tuple[dict, dict]:
    """(queries, SQL twins)."""
    for name in _MODULES:
        import_module(f"corpusmill.querybook.{name}")
    return QUERIES, ORACLES
