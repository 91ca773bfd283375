"""A stream of changes of a source tree that triggers reconciling.

The stream is a Python data source: each micro-batch lists the tree and compares names,
sizes and times with the listing before. Its rows only say *that* something changed; what
to index is the difference of hashes, as deletions can't be seen in files that are read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from hearthdex.engine import Engine
from hearthdex.sources.corpus import walk


def listing(root: str, excludes: Iterable[str] = ()) -> dict[str, list[int]]:
    out = {}
    for path in walk(root, excludes):
        try:
            s = os.stat(os.path.join(root, path))
            out[path] = [s.st_size, s.st_mtime_ns]
        except OSError:
            continue
    return out


class ChangeReader(SimpleDataSourceStreamReader):
    """Rows are emitted once; the state between batches is the listing, kept beside a count as the offset."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.excludes = [x for x in options.get("excludes", "").split("\n") if x]
        self.seen: dict[str, list[int]] | None = None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        now = listing(self.root, self.excludes)
        if self.seen is None:
            rows = [(p, "present") for p in sorted(now)]
        else:
            rows = [(p, "changed") for p in sorted(now) if self.seen.get(p) != now[p]] + [(p, "deleted") for p in sorted(self.seen) if p not in now]
        self.seen = now
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([("", "replayed")] if end != start else [])  # a replayed batch still reconciles

    def commit(self, end: dict) -> None:
        json.dumps(end)


class ChangeSource(DataSource):
    """``spark.readStream.format("corpus_changes").load(root)``: path, kind."""

    @classmethod
    def name(cls) -> str:
        return "corpus_changes"

    def schema(self) -> str:
        return "path string, kind string"

    def simpleStreamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))


def is_relevant(path: Column, index_folder: str) -> Column:
    """Paths outside the index; its own writes must not wake it."""
    inside = index_folder.rstrip("/")
    return (path != inside) & ~path.startswith(inside + "/")


def changes(spark: SparkSession, root: str, excludes: Iterable[str] = ()) -> DataFrame:
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("corpus_changes").option("excludes", "\n".join(excludes)).load(root)


class Watcher:
    """Reconciles once, then after each micro-batch with relevant rows.

    A batch gathers all changes since the one before, which is the debounce. If the
    stream fails, searches scan again: the state is dirty and no watcher is active.
    """

    def __init__(self, engine: Engine, checkpoint: str):
        self.engine, self.checkpoint = engine, checkpoint
        self.query: StreamingQuery | None = None

    def _batch(self, rows: DataFrame, _: int) -> None:
        index = os.path.relpath(self.engine.config.index_folder(), self.engine.config.repo_root)
        if rows.where(is_relevant(F.col("path"), index)).where("kind <> 'present'").take(1):
            self.engine.state.dirty = True
            self.engine.reconcile()

    def start(self, once: bool = False) -> StreamingQuery:
        self.engine.reconcile()
        writer = changes(self.engine.spark, self.engine.config.repo_root, self.engine.excludes).writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint)
        delay = f"{max(1, self.engine.config.watch.debounce_ms)} milliseconds"
        self.query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=delay)).start()
        self.engine.state.watch_active = True
        return self.query

    def poll(self) -> bool:
        """Whether the stream still runs; else the state goes back to scanning."""
        alive = self.query is not None and self.query.isActive and self.query.exception() is None
        if not alive:
            self.engine.state.watch_active, self.engine.state.dirty = False, True
        return alive

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
        self.poll()
