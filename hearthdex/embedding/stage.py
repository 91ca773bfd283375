"""Reading, chunking and embedding changed files in tasks; a file's outcome is a row, never an exception."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from hearthdex.chunking.structural import chunks_for_embedding
from hearthdex.embedding.base import ContextExceeded, EmbedError, Embedder
from hearthdex.embedding.batching import PAUSES, embed_all
from hearthdex.sources.corpus import read_source

#: Retryable failures in a row after which a task stops.
BREAKER = 5

OUTCOME = (
    "path string, file_hash string, status string, error string, largest long, n_prompt long, n_ctx long, "
    "chunks array<struct<chunk_index:long, start_line:long, end_line:long, language:string, symbol:string, text:string, vector:array<float>>>"
)
_NAMES = ["path", "file_hash", "status", "error", "largest", "n_prompt", "n_ctx", "chunks"]


def embed_files(
    work: DataFrame, root: str, embedder: Embedder, budget: int, max_chunks: int, max_bytes: int, pauses: tuple[float, ...] = PAUSES
) -> DataFrame:
    """A row per file of ``work`` (``path, hash``): ok, skipped, overflow, failed, auth or aborted.

    Files are taken by path within a task. After an auth failure, or BREAKER failures
    in a row that a retry might have cured, the task's other files come out as aborted.
    ``largest`` is the size of the largest piece that was sent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        streak, stopped = 0, None
        for pdf in batches:
            rows = []
            for path, digest in sorted(zip(pdf["path"], pdf["hash"])):
                if stopped:
                    rows.append((path, digest, "aborted", stopped, 0, 0, 0, []))
                    continue
                raw = read_source(root, path)
                try:
                    source = None if raw is None else raw.decode("utf-8")
                except UnicodeDecodeError:
                    source = None
                if source is None:
                    rows.append((path, digest, "skipped", None, 0, 0, 0, []))
                    continue
                chunks, largest = chunks_for_embedding(path, source, budget)
                try:
                    vectors = embed_all(embedder, [c.text for c in chunks], max_chunks, max_bytes, pauses)
                except ContextExceeded as x:
                    streak = 0
                    rows.append((path, digest, "overflow", str(x), largest, x.n_prompt, x.n_ctx, []))
                except EmbedError as x:
                    rows.append((path, digest, "auth" if x.fatal else "failed", str(x), largest, 0, 0, []))
                    streak = streak + 1 if x.retryable else 0
                    if x.fatal or streak >= BREAKER:
                        stopped = str(x) if x.fatal else f"{streak} files in a row failed: {x}"
                else:
                    streak = 0
                    each = [
                        {"chunk_index": i, "start_line": c.start_line, "end_line": c.end_line, "language": c.language, "symbol": c.symbol, "text": c.text, "vector": v.tolist()}
                        for i, (c, v) in enumerate(zip(chunks, vectors))
                    ]
                    rows.append((path, digest, "ok", None, largest, 0, 0, each))
            yield pd.DataFrame(rows, columns=_NAMES)

    return work.select("path", "hash").mapInPandas(run, OUTCOME)
