"""Queries over the vectors of chunks."""

from __future__ import annotations

from hearthdex.llm.neighbours import exact_neighbours, neighbour_pairs, neighbours, recall
from hearthdex.session import table


def p4_neighbours(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "chunks"))


def p4_found(spark, sf_dir):
    return neighbour_pairs(p4_neighbours(spark, sf_dir))


def p4_recall(spark, sf_dir):
    """Of the ids divisible by 100, which part of their exact neighbours is found."""
    return recall(p4_neighbours(spark, sf_dir), exact_neighbours(table(spark, sf_dir, "chunks")))


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_recall": p4_recall}
SQL: dict[str, str] = {}
