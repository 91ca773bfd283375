"""Queries over tokens of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthdex.llm.bpe import with_token_counts, with_token_ids
from hearthdex.llm.containers import CAPACITY, packed
from hearthdex.session import table


def p5_ids(spark, sf_dir):
    return with_token_ids(table(spark, sf_dir, "documents"))


def p6_containers(spark, sf_dir):
    return packed(with_token_counts(table(spark, sf_dir, "documents")))


def p6_fill(spark, sf_dir):
    """How full the containers are: one row for each tenth of the capacity."""
    each = p6_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return each.groupBy(F.floor(F.col("used") * 10 / CAPACITY).alias("tenth")).agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens")
    )


QUERIES = {"p5_ids": p5_ids, "p6_containers": p6_containers, "p6_fill": p6_fill}
SQL: dict[str, str] = {}
