"""Files of a source tree as rows.

Spark's own file readers leave out names that begin with ``_`` and empty files, and know no
ignore files; so the driver walks (names only) and tasks read and hash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hearthdex.functions.globs import excludes_regex
from hearthdex.sources.ignore import find_repository, is_ignored, read_rules, rules_above


def walk(root: str, excludes: Iterable[str] = ()) -> Iterator[str]:
    """Relative paths of the files to index, sorted within folders.

    Hidden names, symbolic links and what ignore files name are left out, and what the
    patterns match; excluded folders aren't entered. Ignore files of folders above the root
    count up to the repository's, and so do the repository's own list and the user's.
    """
    excluded = re.compile(excludes_regex(excludes)).match
    repository = find_repository(root)
    above, where = rules_above(root, repository)

    def visit(folder: str, base: str, rules: list) -> Iterator[str]:
        rules = rules + read_rules(folder, (where + base).rstrip("/"), repository is not None)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for entry in entries:
            path = f"{base}/{entry.name}" if base else entry.name
            try:
                if entry.name.startswith(".") or entry.is_symlink():
                    continue
                is_folder = entry.is_dir()
                if is_ignored(where + path, is_folder, rules) or excluded(path):
                    continue
                if is_folder:
                    yield from visit(entry.path, path, rules)
                elif entry.is_file():
                    yield path
            except OSError:
                continue

    yield from visit(root, "", above)


def read_source(root: str, path: str) -> bytes | None:
    try:
        with open(os.path.join(root, path), "rb") as f:
            return f.read()
    except OSError:
        return None


def _slices(spark: SparkSession, n: int) -> int:
    return max(1, min(n, 4 * spark.sparkContext.defaultParallelism))


def path_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The walked names as rows, spread over tasks."""
    rows = spark.createDataFrame(pd.DataFrame({"path": pd.Series(paths, dtype=str)}), "path string") if paths else spark.createDataFrame([], "path string")
    return rows.repartition(_slices(spark, len(paths))) if paths else rows


def scan(spark: SparkSession, root: str, excludes: Iterable[str] = ()) -> DataFrame:
    """``path, hash`` of each file that can be read; the hash is SHA-256 over its bytes, in hex."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [read_source(root, p) for p in pdf["path"]]
            yield pd.DataFrame({"path": pdf["path"], "hash": [None if r is None else hashlib.sha256(r).hexdigest() for r in raw]})

    return path_rows(spark, list(walk(root, excludes))).mapInPandas(run, "path string, hash string").where("hash is not null")


def sources(paths: DataFrame, root: str) -> DataFrame:
    """``paths`` with ``text``; files that vanished or aren't UTF-8 have no row."""
    keep = paths.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for p in pdf["path"]:
                raw = read_source(root, p)
                try:
                    texts.append(None if raw is None else raw.decode("utf-8"))
                except UnicodeDecodeError:
                    texts.append(None)
            pdf = pdf[keep].assign(text=pd.Series(texts, dtype=object, index=pdf.index))
            yield pdf[pdf["text"].notna()]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)
    return paths.mapInPandas(run, f"{fields}, text string")


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.excludes = [x for x in options.get("excludes", "").split("\n") if x]
        self.parts = int(options.get("numpartitions", options.get("numPartitions", 8)))

    def partitions(self) -> list[_Part]:
        paths = list(walk(self.root, self.excludes))
        size = max(1, -(-len(paths) // self.parts))
        return [_Part(paths[i : i + size]) for i in range(0, len(paths), size)] or [_Part([])]

    def read(self, partition: _Part):
        for path in partition.paths:
            raw = read_source(self.root, path)
            if raw is None:
                continue
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = None
            yield path, hashlib.sha256(raw).hexdigest(), len(raw), text


class CorpusSource(DataSource):
    """``spark.read.format("corpus").load(root)``: path, hash, n_bytes, text (null unless UTF-8).

    Option ``excludes`` has a pattern per line, ``numPartitions`` is the number of tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return "path string, hash string, n_bytes long, text string"

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorpusSource)


def valid_utf8(raw) -> object:
    """Whether a binary column holds UTF-8."""
    return F.is_valid_utf8(raw.cast("string"))
