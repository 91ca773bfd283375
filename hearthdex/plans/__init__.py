"""Named queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

#: Modules that hold QUERIES and SQL.
MODULES = ("changes", "corpus", "retrieval", "pipeline")


def _all(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"hearthdex.plans.{name}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")


def flagship(spark, sf_dir):
    return queries()["search_end_to_end"](spark, sf_dir)
