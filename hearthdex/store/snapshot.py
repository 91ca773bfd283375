"""The index: chunks and file hashes as versions behind one pointer.

A commit writes both tables under a new version and then replaces the pointer, so a
reader sees either version whole. Chunks lie in buckets by the path's hash; a commit
rewrites only buckets that it touches and the pointer lists where each bucket lies.
"""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearthdex.chunking.structural import CHUNKER_VERSION

CHUNKS = "path string, start_line long, end_line long, chunk_index long, language string, symbol string, text string, file_hash string, vector array<float>"
FILES = "path string, file_hash string"
#: Buckets of the chunk table, and versions whose files are kept.
BUCKETS, KEPT = 64, 2


@dataclass
class Pointer:
    version: int
    embedder_id: str
    dim: int
    chunker_version: int = CHUNKER_VERSION
    buckets: dict[str, str] = field(default_factory=dict)
    files: str | None = None


class Index:
    """A handle reads the pointer anew for each query, so it sees what others committed."""

    def __init__(self, spark: SparkSession, folder: str, embedder_id: str, dim: int, buckets: int = BUCKETS):
        self.spark, self.folder, self.n = spark, folder, buckets
        self.embedder_id, self.dim = embedder_id, dim
        os.makedirs(folder, exist_ok=True)
        self.rebuilt = self._open()

    # the pointer

    def _at(self) -> str:
        return os.path.join(self.folder, "CURRENT.json")

    def pointer(self) -> Pointer | None:
        """None if it is missing or can't be read."""
        try:
            with open(self._at(), encoding="utf-8") as f:
                return Pointer(**json.load(f))
        except (OSError, ValueError, TypeError):
            return None

    def _open(self) -> bool:
        """Starts afresh if the index is of another embedder, width or chunker, or has no readable pointer. True if so."""
        now = self.pointer()
        if now and (now.embedder_id, now.dim, now.chunker_version) == (self.embedder_id, self.dim, CHUNKER_VERSION):
            if now.files is None and now.buckets:
                self._backfill(now)
            return False
        self.wipe()
        return True

    def wipe(self) -> None:
        for name in os.listdir(self.folder):
            at = os.path.join(self.folder, name)
            if name == "CURRENT.json":
                os.remove(at)
            elif name.startswith("v") and name[1:].isdigit():
                shutil.rmtree(at, ignore_errors=True)
        self._swap(Pointer(0, self.embedder_id, self.dim))

    def _swap(self, pointer: Pointer) -> None:
        new = self._at() + ".new"
        with open(new, "w", encoding="utf-8") as f:
            json.dump(asdict(pointer), f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(new, self._at())

    def _backfill(self, now: Pointer) -> None:
        """Hashes from the chunks, for an index without the table of files."""
        at = self._folder(now.version + 1, "files")
        backfill(self.chunks()).write.mode("overwrite").parquet(at)
        now.version, now.files = now.version + 1, at
        self._swap(now)

    def _folder(self, version: int, table: str) -> str:
        return os.path.join(self.folder, f"v{version}", table)

    # reading

    def chunks(self) -> DataFrame:
        now = self.pointer()
        if not now or not now.buckets:
            return self.spark.createDataFrame([], CHUNKS)
        return self.spark.read.schema(CHUNKS).parquet(*sorted(now.buckets.values()))

    def files(self) -> DataFrame:
        now = self.pointer()
        return self.spark.read.schema(FILES).parquet(now.files) if now and now.files else self.spark.createDataFrame([], FILES)

    def stats(self) -> tuple[int, int]:
        """Files and chunks; reads what is there, without a refresh."""
        return self.files().count(), self.chunks().count()

    # writing

    def bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.n)).cast("int")

    def commit(self, fresh: DataFrame, hashes: DataFrame, gone: DataFrame | None = None) -> int:
        """Replaces the chunks of all paths in ``hashes`` (``path, file_hash``) with ``fresh``, deletes those in ``gone``.

        A path without chunks in ``fresh`` keeps its hash and has no chunks. The same commit
        again changes nothing. Returns the new version.
        """
        now = self.pointer() or Pointer(0, self.embedder_id, self.dim)
        version = now.version + 1
        touched = hashes.select("path")
        if gone is not None:
            touched = touched.unionByName(gone.select("path"))
        touched = touched.distinct()
        marked = [r["b"] for r in touched.select(self.bucket().alias("b")).distinct().collect()]  # n at most
        old_at = [now.buckets[str(b)] for b in marked if str(b) in now.buckets]
        old = self.spark.read.schema(CHUNKS).parquet(*old_at) if old_at else self.spark.createDataFrame([], CHUNKS)
        chunks = upserted(old, fresh.select(old.columns), touched).withColumn(
            "vector", F.when(F.size("vector") == self.dim, F.col("vector")).otherwise(F.raise_error(F.lit("a vector has another width than the index")))
        )
        at = self._folder(version, "chunks")
        (
            chunks.withColumn("start_line", F.least("start_line", F.lit(4294967295))).withColumn("end_line", F.least("end_line", F.lit(4294967295)))
            .withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        )
        files_at = self._folder(version, "files")
        upserted(self.files(), hashes.select("path", "file_hash"), touched).write.mode("overwrite").parquet(files_at)
        buckets = {k: v for k, v in now.buckets.items() if int(k) not in marked}
        for b in marked:
            folder = os.path.join(at, f"bucket={b}")
            if os.path.isdir(folder):
                buckets[str(b)] = folder
        self._swap(Pointer(version, self.embedder_id, self.dim, CHUNKER_VERSION, buckets, files_at))
        self._tidy(version)
        return version

    def _tidy(self, version: int) -> None:
        """Removes versions that neither the pointer nor a reader of the version before can need."""
        now = self.pointer()
        used = {os.path.relpath(p, self.folder).split(os.sep)[0] for p in [*now.buckets.values(), now.files] if p}
        for name in os.listdir(self.folder):
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) <= version - KEPT and name not in used:
                shutil.rmtree(os.path.join(self.folder, name), ignore_errors=True)


def upserted(old: DataFrame, fresh: DataFrame, touched: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``old`` with all rows of the touched keys replaced by ``fresh``."""
    return old.join(touched.select(*keys).distinct(), list(keys), "left_anti").select(old.columns).unionByName(fresh)


def without(old: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    return old.join(gone.select(*keys), list(keys), "left_anti")


def backfill(chunks: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """A hash per file from its chunks; they agree within a file, else the greatest counts."""
    return chunks.groupBy(*keys).agg(F.max("file_hash").alias("file_hash"))
