"""Packing texts into requests, in order."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, functions as F

from hearthdex.embedding.base import EmbedError, Embedder

#: Texts and bytes of a request.
MAX_CHUNKS, MAX_BYTES = 64, 32_000
#: Attempts, and the pauses between them in seconds.
PAUSES = (0.1, 0.4)


def batches(sizes: Sequence[int], max_chunks: int = MAX_CHUNKS, max_bytes: int = MAX_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of items: a new one begins where the next item would be one too many or too large; an oversized item is alone."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= max(max_chunks, 1) or held + size > max_bytes):
            yield start, i
            start, held = i, 0
        held += size
    if sizes and start < len(sizes):
        yield start, len(sizes)


def batch_ids(sizes: Column, max_chunks: int = MAX_CHUNKS, max_bytes: int = MAX_BYTES) -> Column:
    """The batch number, from 0, of each element of an array of sizes, by the same rule."""
    zero = F.struct(
        F.lit(-1).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("ids")
    )

    def step(acc: Column, size: Column) -> Column:
        fresh = (acc["batch"] < 0) | (acc["n"] >= max(max_chunks, 1)) | (acc["held"] + size > max_bytes)
        batch = acc["batch"] + F.when(fresh, 1).otherwise(0)
        return F.struct(
            batch.alias("batch"),
            F.when(fresh, 1).otherwise(acc["n"] + 1).alias("n"),
            (F.when(fresh, F.lit(0).cast("long")).otherwise(acc["held"]) + size).alias("held"),
            F.concat(acc["ids"], F.array(batch)).alias("ids"),
        )

    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), zero, step)["ids"]


def with_retry(call: Callable[[], np.ndarray], pauses: Iterable[float] = PAUSES) -> np.ndarray:
    """The call, again after each pause as long as its error is worth it."""
    for pause in pauses:
        try:
            return call()
        except EmbedError as x:
            if not x.retryable:
                raise
            time.sleep(pause)
    return call()


def embed_all(embedder: Embedder, texts: list[str], max_chunks: int = MAX_CHUNKS, max_bytes: int = MAX_BYTES, pauses: Iterable[float] = PAUSES) -> np.ndarray:
    """A vector per text, request by request; no texts need no request."""
    parts = []
    pauses = tuple(pauses)
    for start, end in batches([len(t.encode("utf-8", "surrogatepass")) for t in texts], max_chunks, max_bytes):
        part = texts[start:end]
        rows = with_retry(lambda part=part: embedder.embed(part), pauses)
        if len(rows) != len(part):
            raise EmbedError(f"{len(rows)} vectors for {len(part)} texts")
        parts.append(rows)
    return np.concatenate(parts) if parts else np.zeros((0, embedder.dim), dtype=np.float32)
