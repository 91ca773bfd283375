"""Differences of two listings by key and hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def changed(current: DataFrame, stored: DataFrame, keys: Sequence[str] = ("path",), value: str = "hash") -> DataFrame:
    """Rows of ``current`` that ``stored`` lacks or has with another hash. Null keys match nothing."""
    old = stored.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_there"))
    return (
        current.join(old, list(keys), "left")
        .where(F.col("_there").isNull() | ~F.col("_old").eqNullSafe(F.col(value)))
        .select(*current.columns)
    )


def deleted(current: DataFrame, stored: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Keys of ``stored`` that ``current`` lacks."""
    return stored.select(*keys).join(current.select(*keys), list(keys), "left_anti")


def delta(current: DataFrame, stored: DataFrame, keys: Sequence[str] = ("path",), value: str = "hash") -> DataFrame:
    """``keys, kind`` (changed or deleted) in one full join."""
    now = current.select(*keys, F.col(value).alias("_now"), F.lit(True).alias("_in_now"))
    old = stored.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    kind = F.when(F.col("_in_now").isNull(), "deleted").when(
        F.col("_in_old").isNull() | ~F.col("_now").eqNullSafe(F.col("_old")), "changed"
    )
    return now.join(old, list(keys), "full_outer").select(*keys, kind.alias("kind")).where("kind is not null")


def in_order(rows: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Rows of a difference by key, for those who list or work it off; a full sort, so only where the order is wanted."""
    return rows.orderBy(*keys)
