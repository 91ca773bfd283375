"""Filling containers of fixed capacity with items that are not split unless they must be."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hearthdex.session import materialized

#: Tokens in a container.
CAPACITY = 2048

#: Items that one task packs. Groups are packed apart; each leaves at most a few
#: containers less than full, so larger groups waste less and smaller ones spread better.
GROUP_ITEMS = 20_000


class _Shelf:
    """Unpacked items by size."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        order = np.argsort(sizes, kind="stable")
        self.left = np.bincount(sizes, minlength=capacity + 1)
        starts = np.concatenate(([0], np.cumsum(self.left)))
        self.items = [order[starts[i] : starts[i + 1]] for i in range(capacity + 1)]
        self.at = np.arange(capacity + 1)

    def largest(self, gap: int) -> int:
        """The largest size on the shelf that fits, or 0."""
        found = np.flatnonzero(self.left[1 : gap + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def best_two(self, gap: int) -> tuple[int, int]:
        """The two sizes on the shelf whose sum is largest within ``gap``, or (0, 0)."""
        have = self.left[: gap + 1] > 0
        first = np.flatnonzero(have)
        first = first[first > 0]
        if not len(first):
            return 0, 0
        fitting = np.maximum.accumulate(np.where(have, self.at[: gap + 1], 0))
        second = fitting[gap - first]
        # a pair of equal sizes needs two items; else the next smaller size
        lone = (second == first) & (self.left[first] < 2)
        second = np.where(lone, fitting[np.maximum(first - 1, 0)], second)
        total = np.where(second > 0, first + second, 0)
        i = int(np.argmax(total))
        return (int(first[i]), int(second[i])) if total[i] else (0, 0)

    def take(self, size: int) -> int:
        self.left[size] -= 1
        return int(self.items[size][self.left[size]])

    def give(self, size: int, item: int) -> None:
        self.items[size][self.left[size]] = item
        self.left[size] += 1


def best_two_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of each item; all sizes lie in 1..capacity.

    A container is filled greedily, always with the largest item that fits. Then, as
    long as that fills it more, its smallest item is put back for two unpacked ones
    that together fit its place and the gap better.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    if len(sizes) and not (1 <= sizes.min() and sizes.max() <= capacity):
        raise ValueError("sizes must lie within the capacity")
    shelf, where = _Shelf(sizes, capacity), np.empty(len(sizes), dtype=np.int64)
    packed = number = 0
    while packed < len(sizes):
        inside: list[tuple[int, int]] = []
        gap = capacity
        while gap and (size := shelf.largest(gap)):
            inside.append((size, shelf.take(size)))
            gap -= size
        while gap and len(inside) > 1:
            size, item = inside[-1]  # the smallest, as sizes only fall
            a, b = shelf.best_two(gap + size)
            if a + b <= size:
                break
            inside.pop()
            inside += [(a, shelf.take(a)), (b, shelf.take(b))]
            shelf.give(size, item)
            gap -= a + b - size
            inside.sort(reverse=True)
        for _, item in inside:
            where[item] = number
        packed += len(inside)
        number += 1
    return where


def _pack(capacity: int):
    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(keys[0])
        pdf = pdf.sort_values(["n_tokens", "key"], kind="stable", na_position="last").reset_index(drop=True)
        n = pdf["n_tokens"].to_numpy()
        full, rest = n // capacity, n % capacity
        whole = np.repeat(np.arange(len(n)), full)  # the full pieces of long items
        part = np.cumsum(np.ones(len(whole), dtype=np.int64)) - 1 - np.repeat(np.cumsum(full) - full, full)
        last = np.flatnonzero(rest)
        row = np.concatenate([whole, last])
        piece = np.concatenate([part, full[last]]).astype(np.int64)
        bins = np.concatenate([np.arange(len(whole)), len(whole) + best_two_fit(rest[last], capacity)])
        size = np.concatenate([np.full(len(whole), capacity), rest[last]]).astype(np.int64)
        return pd.DataFrame(
            {
                "container_id": group * (1 << 40) + bins.astype(np.int64),
                "key": pdf["key"].to_numpy()[row],
                "piece": piece,
                "first_token": piece * capacity,
                "n_tokens": size,
            }
        )

    return run


def packed(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``container_id, key, piece, first_token, n_tokens``: each item's place.

    ``sizes`` has one row per item. Items of no size (0 or null) need no container
    and have no row. An item longer than ``capacity`` is cut into full pieces, each a
    container of its own, and one last piece that is packed like an item; no other
    item is cut. Rows that repeat are items of their own; a null ``key`` is kept.
    Items are spread over groups by a hash of key, size and place in the written table, about ``group_items`` each, so
    keys that many items share, null too, meet in no one group; each group is packed by one task.
    """
    if capacity < 1 or group_items < 1:
        raise ValueError("capacity and group_items must be positive")
    rows = materialized(
        sizes.select(F.col(key).alias("key"), F.col(size).cast("long").alias("n_tokens")).where("n_tokens > 0"), "sizes"
    )
    groups = max(1, -(-rows.count() // group_items))
    kind = rows.schema["key"].dataType.simpleString()
    return (
        rows.withColumn("grp", F.pmod(F.xxhash64("key", "n_tokens", F.monotonically_increasing_id()), F.lit(groups)))
        .groupBy("grp")
        .applyInPandas(_pack(capacity), f"container_id long, key {kind}, piece long, first_token long, n_tokens long")
        .withColumnRenamed("key", key)
    )
