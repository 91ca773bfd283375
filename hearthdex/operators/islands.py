"""Hits of a file that touch become one entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

#: Lines that may lie uncovered between two hits of one entry, plus one.
REACH = 2


def islands(hits: DataFrame, keys: Sequence[str] = ("path",), ties: Sequence[str] = ()) -> DataFrame:
    """``hits`` with ``island`` (from 1 within ``keys``) and ``piece``, the text with its separator.

    Hits are taken by ``start_line``, then ``chunk_index``, then ``ties``. A hit continues the island if
    it starts at most two lines behind the furthest end so far. A line break stands
    before a piece that starts behind the hit before it; overlaps are kept as they are.
    """
    order = W.partitionBy(*keys).orderBy("start_line", "chunk_index", *ties)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start_line") > F.max("end_line").over(before) + REACH, F.lit(True))
    step = hits.withColumns({"_opens": opens, "_last": F.lag("start_line").over(order)})
    separator = F.when(~F.col("_opens") & (F.col("start_line") > F.col("_last")), "\n").otherwise("")
    return step.withColumns(
        {
            "island": F.sum(F.col("_opens").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)),
            "piece": F.concat(separator, F.coalesce("text", F.lit(""))),
        }
    ).drop("_opens", "_last")


def merged(hits: DataFrame, keys: Sequence[str] = ("path",), ties: Sequence[str] = ()) -> DataFrame:
    """One row per island: ``keys, start_line, end_line, language, symbol, code, score``.

    Language and symbol are the first hit's, the score is the best. Null and NaN scores
    rank below all others.
    """
    at = F.struct("start_line", "chunk_index", *ties)
    place = F.struct("start_line", "chunk_index", *ties, "piece")
    return (
        islands(hits.withColumn("score", F.coalesce(F.nanvl("score", F.lit(-2.0)), F.lit(-2.0))), keys, ties)
        .groupBy(*keys, "island")
        .agg(
            F.min("start_line").alias("start_line"),
            F.max("end_line").alias("end_line"),
            F.min_by("language", at).alias("language"),
            F.min_by("symbol", at).alias("symbol"),
            F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["piece"]), "").alias("code"),
            F.max("score").alias("score"),
        )
        .drop("island")
    )
