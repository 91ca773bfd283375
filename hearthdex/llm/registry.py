"""Names of this subpackage's queries; each module holds QUERIES and SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("token_queries", "vector_queries", "page_queries", "code_queries")


def _all(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"hearthdex.llm.{name}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
