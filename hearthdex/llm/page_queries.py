"""Queries over pages."""

from __future__ import annotations

from hearthdex.llm.stuffing import stuffed
from hearthdex.session import table


def p7_found(spark, sf_dir):
    return stuffed(table(spark, sf_dir, "documents")).select("doc_id")


def p7_kinds(spark, sf_dir):
    """Each found page with its share of spam characters and what it is made of."""
    return stuffed(table(spark, sf_dir, "documents"))


QUERIES = {"p7_found": p7_found, "p7_kinds": p7_kinds}
SQL: dict[str, str] = {}
