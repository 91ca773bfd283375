"""Queries over source files."""

from __future__ import annotations

from hearthdex.llm.provenance import not_handwritten
from hearthdex.llm.syntax import invalid_files, invalid_rates
from hearthdex.session import table


def p1_reasons(spark, sf_dir):
    """Each file not written by hand, with the reason."""
    return not_handwritten(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "upstream_files"))


def p1_found(spark, sf_dir):
    return p1_reasons(spark, sf_dir).select("repo", "path")


def p2_found(spark, sf_dir):
    return invalid_files(table(spark, sf_dir, "chunks")).select("repo", "path")


def p2_errors(spark, sf_dir):
    """Each invalid file with the line of its first error."""
    return invalid_files(table(spark, sf_dir, "chunks"))


def p2_rates(spark, sf_dir):
    return invalid_rates(table(spark, sf_dir, "chunks"))


QUERIES = {
    "p1_found": p1_found,
    "p1_reasons": p1_reasons,
    "p2_found": p2_found,
    "p2_errors": p2_errors,
    "p2_rates": p2_rates,
}
SQL: dict[str, str] = {}
