"""Registered queries, one module per group of operators."""

from __future__ import annotations

import importlib

MODULES = (
    "text_queries",
    "rule_queries",
    "page_queries",
    "section_queries",
    "history_queries",
    "stix_queries",
    "source_queries",
    "run_queries",
)


def registered():
    """The catalog with every query module loaded."""
    for name in MODULES:
        importlib.import_module(f"threatloom.queries.{name}")
    return importlib.import_module("threatloom.queries.catalog")
