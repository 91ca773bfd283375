from __future__ import annotations

import json
import os

import pytest

from hearthdex.operators.delta import changed, deleted, delta
from hearthdex.operators.files import current_files
from hearthdex.store.snapshot import CHUNKS, FILES, Index


def test_delta(spark):
    now = spark.createDataFrame([("a", "h1", 1), ("b", "NEW", 1), ("c", "h3", 1), (None, "x", 1)], "path string, hash string, kind int")
    old = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("d", "h4")], FILES.replace("file_hash", "hash"))
    assert sorted(r["path"] or "" for r in changed(now, old).collect()) == ["", "b", "c"]
    assert [r["path"] for r in deleted(now, old).collect()] == ["d"]
    assert {(r["path"], r["kind"]) for r in delta(now, old).where("path is not null").collect()} == {("b", "changed"), ("c", "changed"), ("d", "deleted")}
    assert delta(now.limit(0), old.limit(0)).count() == 0


def row(path, i, digest, vector=(1.0, 0.0, 0.0), text="t", symbol=None):
    return (path, 1, 1, i, "rust", symbol, text, digest, list(vector))


def commit(spark, index, rows, hashes, gone=()):
    fresh = spark.createDataFrame(rows, CHUNKS)
    return index.commit(fresh, spark.createDataFrame(list(hashes), FILES), spark.createDataFrame([(g,) for g in gone], "path string") if gone else None)


def state(index):
    return sorted((r["path"], r["chunk_index"], r["file_hash"]) for r in index.chunks().collect()), sorted(tuple(r) for r in index.files().collect())


def test_upsert_delete_and_readers(spark, tmp_path):
    index = Index(spark, str(tmp_path), "mock", 3, buckets=4)
    assert index.rebuilt and index.stats() == (0, 0)
    commit(spark, index, [row("a", 0, "1"), row("a", 1, "1"), row("b'", 0, "1")], [("a", "1"), ("b'", "1")])
    reader = Index(spark, str(tmp_path), "mock", 3, buckets=4)
    assert not reader.rebuilt and reader.stats() == (2, 3)
    commit(spark, index, [row("a", 0, "2")], [("a", "2")])
    want = ([("a", 0, "2"), ("b'", 0, "1")], [("a", "2"), ("b'", "1")])
    assert state(index) == want == state(reader)
    commit(spark, index, [row("a", 0, "2")], [("a", "2")])
    assert state(index) == want
    commit(spark, index, [], [("a", "3")], ["b'"])
    assert state(reader) == ([], [("a", "3")])
    assert len([n for n in os.listdir(tmp_path) if n.startswith("v")]) <= 3


def test_two_definitions_on_one_line_are_kept(spark, tmp_path):
    index = Index(spark, str(tmp_path), "mock", 3)
    commit(spark, index, [row("a", 0, "1", text="x"), row("a", 1, "1", text="y")], [("a", "1")])
    assert sorted(r["text"] for r in index.chunks().collect()) == ["x", "y"]


def test_wrong_width_is_refused(spark, tmp_path):
    index = Index(spark, str(tmp_path), "mock", 3)
    with pytest.raises(Exception, match="another width"):
        commit(spark, index, [row("a", 0, "1", (1.0,))], [("a", "1")])
    assert index.stats() == (0, 0)


def test_another_embedder_or_a_broken_pointer_rebuilds(spark, tmp_path):
    index = Index(spark, str(tmp_path), "mock", 3)
    commit(spark, index, [row("a", 0, "1")], [("a", "1")])
    assert Index(spark, str(tmp_path), "mock", 4).rebuilt
    index = Index(spark, str(tmp_path), "mock", 3)
    commit(spark, index, [row("a", 0, "1")], [("a", "1")])
    (tmp_path / "CURRENT.json").write_text("{broken")
    assert Index(spark, str(tmp_path), "mock", 3).stats() == (0, 0)


def test_hashes_are_filled_in_from_chunks(spark, tmp_path):
    index = Index(spark, str(tmp_path), "mock", 3)
    commit(spark, index, [row("a", 0, "1"), row("a", 1, "1"), row("b", 0, "2")], [("a", "1"), ("b", "2")])
    at = tmp_path / "CURRENT.json"
    pointer = json.loads(at.read_text()) | {"files": None}
    at.write_text(json.dumps(pointer))
    again = Index(spark, str(tmp_path), "mock", 3)
    assert not again.rebuilt and sorted(tuple(r) for r in again.files().collect()) == [("a", "1"), ("b", "2")]


def test_current_files(spark):
    rows = [
        ("r", "a", 1, "B", 2), ("r", "a", 0, "A", 2), ("r", "a", 0, "A", 2), ("r", "a", 0, "old", 1), ("r", "a", 5, "tail", 1), ("r", "n", None, "x", None), ("r", "n", 0, None, None),
        (None, "a", 0, "x", 1), ("r", None, 0, "x", 1), ("s", "a", 0, "other", 9),
    ]
    df = spark.createDataFrame(rows, "repo string, path string, chunk_index int, text string, indexed_at int")
    assert sorted(tuple(r) for r in current_files(df).collect()) == [("r", "a", "AB"), ("r", "n", "x"), ("s", "a", "other")]
    assert current_files(df.limit(0)).count() == 0
