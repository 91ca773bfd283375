"""The engine: keeps the index fresh, searches it, reads single files."""

from __future__ import annotations

import os
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from hearthdex.chunking.structural import chunk_source, focus_pieces, language_for_path
from hearthdex.config import Config, expand
from hearthdex.embedding.autostart import connect_or_start
from hearthdex.embedding.base import ContextExceeded, EmbedError, Embedder, EmbedTimeout, MockEmbedder
from hearthdex.embedding.batching import embed_all, with_retry
from hearthdex.embedding.budget import Budget, CannotShrink, concurrency
from hearthdex.embedding.endpoint import HttpEmbedder
from hearthdex.embedding.stage import embed_files
from hearthdex.functions.globs import is_excluded, is_language_allowed, resolve_excludes
from hearthdex.functions.paths import extension, language_of
from hearthdex.operators.delta import delta, in_order
from hearthdex.operators.islands import merged
from hearthdex.operators.knn import nearest
from hearthdex.operators.select import distilled, focus_why
from hearthdex.session import materialized
from hearthdex.sources.corpus import scan
from hearthdex.store.snapshot import Index

#: Rounds of re-splitting after overflows, and entries of a focused read.
ROUNDS, FOCUS = 8, 5

ENTRY = "path string, start_line long, end_line long, language string, symbol string, code string, score double, why_matched string, rank int"


class RefreshError(RuntimeError):
    """Files could not be indexed."""


@dataclass
class Summary:
    indexed: int = 0
    failed: list[tuple[str, str]] = field(default_factory=list)

    def report(self) -> str:
        return "\n".join(f"{path}: {error}" for path, error in self.failed)


class RefreshState:
    """Whether files may have changed, whether a watcher would tell, and the lock of the single refresh."""

    def __init__(self) -> None:
        self.dirty, self.watch_active = True, False
        self.lock = threading.Lock()

    def can_skip_scan(self) -> bool:
        return self.watch_active and not self.dirty

    @contextmanager
    def cleaning(self):
        """Clean from now on, so that events during the scan count; dirty again unless ``done()`` was called."""
        self.dirty, finished = False, []
        try:
            yield lambda: finished.append(True)
        finally:
            if not finished:
                self.dirty = True


def build_embedder(config: Config) -> Embedder:
    e = config.embedder
    if e.backend == "mock":
        return MockEmbedder(dim=64)
    key = expand(e.api_key) if e.api_key else None
    found, _ = connect_or_start(lambda: HttpEmbedder(e.endpoint, e.model, key, e.request_timeout_secs), e.endpoint, e.start_command or None, e.start_timeout_secs)
    return found


class Engine:
    def __init__(self, spark: SparkSession, config: Config, embedder: Embedder | None = None, state: RefreshState | None = None, pauses: tuple[float, ...] = (0.1, 0.4)):
        self.spark, self.config = spark, config
        self.embedder = embedder or build_embedder(config)
        self.state = state or RefreshState()
        self.pauses = pauses
        self.budget = Budget(self.embedder.max_input_tokens, config.embedder.max_chunk_tokens)
        self.index = Index(spark, config.index_folder(), self.embedder.id, max(self.embedder.dim, 1))
        self.excludes = resolve_excludes(config.excludes, config.index_tests)
        self.last = Summary()

    # freshness

    def ensure_fresh(self) -> None:
        if self.state.can_skip_scan():
            return
        with self.state.lock:
            if not self.state.can_skip_scan():
                self._guarded()

    def reconcile(self) -> Summary:
        """Tolerant: failures are in the summary."""
        with self.state.lock:
            return self._guarded()

    def refresh(self) -> Summary:
        """Strict: raises with a line per file that failed."""
        summary = self.reconcile()
        if summary.failed:
            raise RefreshError(summary.report())
        return summary

    def reindex(self) -> Summary:
        self.index.wipe()
        self.state.dirty = True
        return self.refresh()

    def _guarded(self) -> Summary:
        with self.state.cleaning() as done:
            try:
                self.last = self._reconcile()
            except Exception as x:
                self.last = Summary(0, [("(run)", f"aborted: {x}")])
                raise
            if not self.last.failed:
                done()
        return self.last

    def _reconcile(self) -> Summary:
        current = materialized(scan(self.spark, self.config.repo_root, self.excludes), "scan")
        stored = self.index.files().withColumnRenamed("file_hash", "hash")
        changes = materialized(in_order(delta(current, stored)), "delta")
        work = changes.where("kind = 'changed'").join(current, "path").where(
            is_language_allowed(extension(F.col("path")), language_of(F.col("path")), self.config.languages)
        ).select("path", "hash")
        outcomes, failed, aborted = self._embed(work)
        fresh = hashes = None
        for outcome in outcomes:
            ok = outcome.where("status = 'ok'")
            rows = ok.select("path", "file_hash", F.explode("chunks").alias("c")).select(
                "path", "c.start_line", "c.end_line", "c.chunk_index", "c.language", "c.symbol", "c.text", "file_hash", "c.vector"
            )
            done = ok.select("path", "file_hash")
            fresh = rows if fresh is None else fresh.unionByName(rows)
            hashes = done if hashes is None else hashes.unionByName(done)
        gone = changes.where("kind = 'deleted'").select("path")
        indexed = hashes.count() if hashes is not None else 0
        if aborted:
            gone = gone.limit(0)  # what was done stays; nothing is deleted by a run that stopped
        if indexed or gone.take(1):
            nothing = self.index.files().limit(0)
            self.index.commit(fresh if fresh is not None else self.index.chunks().limit(0), hashes if hashes is not None else nothing, gone)
        return Summary(indexed, sorted(failed))

    def _embed(self, work: DataFrame) -> tuple[list[DataFrame], list[tuple[str, str]], bool]:
        """Rounds over the files that overflowed, each with the budget folded from the round before."""
        e = self.config.embedder
        lanes = concurrency(e.concurrency, self.embedder.max_concurrent_requests)
        outcomes: list[DataFrame] = []
        failed: list[tuple[str, str]] = []
        for _ in range(ROUNDS):
            if not work.take(1):
                return outcomes, failed, False
            out = materialized(
                embed_files(work.repartition(lanes, "path"), self.config.repo_root, self.embedder, self.budget.bytes, e.max_batch_chunks, e.max_batch_bytes, self.pauses),
                "outcome",
            )
            outcomes.append(out)
            bad = out.where("status in ('failed', 'auth', 'aborted')").select("path", "error", "status").collect()
            failed += [(r["path"], r["error"]) for r in bad]
            if any(r["status"] in ("auth", "aborted") for r in bad):
                return outcomes, failed, True
            over = out.where("status = 'overflow'").select("path", "largest", "n_prompt", "n_ctx").orderBy("path").collect()
            hopeless = []
            for r in over:
                try:
                    self.budget.after_overflow(r["path"], r["largest"], r["n_prompt"], r["n_ctx"])
                except CannotShrink as x:
                    hopeless.append(r["path"])
                    failed.append((r["path"], str(x)))
            again = out.where("status = 'overflow'")
            if hopeless:
                again = again.where(~F.col("path").isin(hopeless))
            work = again.select("path", F.col("file_hash").alias("hash"))
        rest = [r["path"] for r in work.select("path").collect()]
        return outcomes, failed + [(p, f"still too large after {ROUNDS} rounds") for p in rest], False

    # searching

    def search(self, query: str, k: int | None = None, keep_fresh: bool = True) -> DataFrame:
        """Entries that answer the query, best first (``rank``).

        The k best chunks are taken before excluded paths are dropped, so fewer may come
        out. Refreshing is not under the search's time limit, embedding the query is.
        """
        if keep_fresh:
            self.ensure_fresh()
        s = self.config.search
        k = max(1, k or s.max_results)
        deadline = time.monotonic() + max(1, s.search_timeout_secs)
        vector = self._embed_one(query)
        if time.monotonic() > deadline:
            raise EmbedTimeout("the query's embedding took too long")
        hits = nearest(self.index.chunks(), vector.tolist(), k)
        hits = hits.where(~is_excluded(F.col("path"), self.excludes)).coalesce(1)
        return distilled(merged(hits), self.config.strip, s.relevance_ratio, s.token_budget).orderBy("rank")

    def answer(self, query: str, k: int | None = None) -> list[Row]:
        """:meth:`search` run to its rows; its jobs are interrupted at the time limit, which refreshing doesn't count to."""
        self.ensure_fresh()
        limit = max(1, self.config.search.search_timeout_secs)
        context = self.spark.sparkContext
        tag, done, late = f"hearthdex-{uuid.uuid4().hex}", threading.Event(), []

        def watch() -> None:
            pause = float(limit)
            while not done.wait(pause):  # a job that starts after the limit is interrupted too
                late.append(True)
                context.cancelJobsWithTag(tag)
                pause = 0.5

        context.addJobTag(tag)
        threading.Thread(target=watch, daemon=True).start()
        try:
            rows = self.search(query, k, keep_fresh=False).collect()
        except Exception as x:
            if late:
                raise EmbedTimeout(f"the search took longer than {limit} s") from x
            raise
        else:
            if late:
                raise EmbedTimeout(f"the search took longer than {limit} s")
            return rows
        finally:
            done.set()
            context.removeJobTag(tag)

    def _embed_one(self, text: str) -> np.ndarray:
        rows = with_retry(lambda: self.embedder.embed([text]), self.pauses)
        if len(rows) != 1:
            raise EmbedError(f"{len(rows)} vectors for one text")
        return rows[0]

    # reading

    def _inside(self, path: str) -> str:
        root = os.path.realpath(self.config.repo_root)
        at = os.path.realpath(os.path.join(root, path))
        if os.path.commonpath([root, at]) != root:
            raise ValueError(f"{path} lies outside the repository")
        return at

    def read_file(self, path: str, focus: str | None = None) -> DataFrame:
        """The file as it is now: its outline, or with ``focus`` the definitions nearest to it.

        Neither the index nor the excludes count. Paths that leave the repository are refused.
        """
        with open(self._inside(path), encoding="utf-8") as f:
            chunks = chunk_source(language_for_path(path), f.read())
        if focus is None:
            rows = [(path, c.start_line, c.end_line, c.language, c.symbol, (c.text.split("\n")[0]).removesuffix("\r"), 0.0, "outline", i + 1) for i, c in enumerate(chunks)]
            return self.spark.createDataFrame(rows, ENTRY)
        if not chunks:
            return self.spark.createDataFrame([], ENTRY)
        goal = self._embed_one(focus)  # an overflow of the focus itself must not change the budget
        e = self.config.embedder
        for _ in range(ROUNDS):
            pieces = focus_pieces(chunks, self.budget.bytes)
            texts = [c.text for c, _ in pieces]
            try:
                vectors = embed_all(self.embedder, texts, e.max_batch_chunks, e.max_batch_bytes, self.pauses)
                break
            except ContextExceeded as x:
                self.budget.after_overflow(path, max(len(t.encode()) for t in texts), x.n_prompt, x.n_ctx)
        else:
            raise EmbedError(f"{path}: still too large after {ROUNDS} rounds")
        scores = np.nan_to_num(vectors.astype(np.float64) @ goal.astype(np.float64), nan=-2.0)
        best = np.argsort(-scores, kind="stable")[:FOCUS]
        rows = [
            (path, pieces[i][0].start_line, pieces[i][0].end_line, pieces[i][0].language, pieces[i][0].symbol, pieces[i][0].text, float(scores[i]), pieces[i][1], n + 1)
            for n, i in enumerate(best)
        ]
        out = self.spark.createDataFrame(rows, ENTRY.replace("why_matched string", "partial boolean"))
        return out.withColumn("why_matched", focus_why(F.col("score"), F.col("partial"))).drop("partial")


class LazyEngine:
    """Made on first use; a failure is not kept, the next use tries again."""

    def __init__(self, make):
        self._make, self._engine, self._lock = make, None, threading.Lock()

    def get(self) -> Engine:
        with self._lock:
            if self._engine is None:
                self._engine = self._make()
            return self._engine


__all__ = ["Engine", "LazyEngine", "RefreshError", "RefreshState", "Summary", "build_embedder"]
