from __future__ import annotations

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hearthdex.chunking.split import Chunk, cut_line, kept_lines, split_chunk, text_lines
from hearthdex.chunking.windows import line_windows, windows_of
from hearthdex.embedding.batching import batch_ids, batches
from hearthdex.functions.globs import excludes_regex, resolve_excludes
from hearthdex.functions.paths import clean_digest, clean_path, language_of, relative_path
from hearthdex.functions.text import first_line, lines, strip_banner, token_estimate


def values(spark, rows, kind, *exprs):
    df = spark.createDataFrame([(r,) for r in rows], f"x {kind}").coalesce(1)
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_paths(spark):
    got = values(spark, ["a/b", ".\\a\\\\b", "./a//b/", "/a/./b", "a/x/../b", "../a/b", "", None, "a..b/c"], "string", clean_path(F.col("x")))
    assert [g[0] for g in got] == ["a/b", "a/b", "a/b", "a/b", "a/b", "a/b", "", None, "a..b/c"]
    assert values(spark, ["/r/a\\b", "/other/a"], "string", relative_path(F.col("x"), "/r")) == [("a/b",), ("/other/a",)]
    assert values(spark, ["blake3:AB", "0xab", " ab ", "", None], "string", clean_digest(F.col("x"))) == [("ab",), ("ab",), ("ab",), (None,), (None,)]
    assert [g[0] for g in values(spark, ["a.rs", "a.RS", "b.tsx", "c.jsx", "d.test.ts", "x", None], "string", language_of(F.col("x")))] == ["rust", None, "tsx", "javascript", "typescript", None, None]


def test_lines_and_banners(spark):
    texts = ["", "a", "a\n", "a\r\nb", "\n\n", "a\n\nb\r\n", "// x\n\n# y\n * z\nfn a() {}  \n  // kept\n", "　\n# b\nx ", "#only", None]
    got = values(spark, texts, "string", lines(F.col("x")), first_line(F.col("x")), strip_banner(F.col("x")), strip_banner(F.col("x"), False), token_estimate(F.col("x")))
    for text, (ls, first, bare, kept, tokens) in zip(texts, got):
        if text is None:
            assert ls is None and first is None and bare is None
            continue
        want = text_lines(text)
        assert ls == want
        assert first == (want[0] if want else "")
        rest = list(want)
        while rest and (not rest[0].strip() or rest[0].lstrip().startswith(("//", "#", "/*", "*"))):
            rest.pop(0)
        assert bare == "\n".join(x.rstrip() for x in rest)
        assert kept == "\n".join(x.rstrip() for x in want)
        assert tokens == max(1, len(text) // 4)


def test_windows_match_the_loop(spark):
    texts = ["\n".join(f"l{i}" for i in range(n)) for n in (0, 1, 79, 80, 81, 144, 145, 400)]
    for size in (1, 2, 7, 80):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        got = {}
        for r in line_windows(df, window=size).collect():
            got.setdefault(r["id"], []).append((r["chunk_index"], r["start_line"], r["end_line"], r["text"]))
        for i, t in enumerate(texts):
            assert sorted(got.get(i, [])) == [(k, *w) for k, w in enumerate(windows_of(text_lines(t), size))]


def test_windows_of_null_and_extra_columns(spark):
    df = spark.createDataFrame([(None, "x", 1), ("a\nb", None, 2)], "text string, path string, n int")
    rows = line_windows(df).collect()
    assert [(r["n"], r["path"], r["text"]) for r in rows] == [(2, None, "a\nb")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab\n\r é😀x", max_size=120), st.integers(1, 30))
def test_splitting_loses_nothing(text, most):
    pieces = split_chunk(Chunk(text, 10, 10 + text.count("\n"), "rust", "f"), most)
    assert "".join(p.text for p in pieces) == text
    for p in pieces:
        assert len(p.text.encode()) <= most or len(p.text) == 1
        assert p.start_line <= p.end_line and (p.language, p.symbol) == ("rust", "f")
    assert all(a.start_line <= b.start_line for a, b in zip(pieces, pieces[1:]))
    assert "".join(kept_lines(text)) == text


def test_splitting_examples():
    assert len(split_chunk(Chunk("short\n", 10, 10, "rust"), 1000)) == 1
    assert len(split_chunk(Chunk("a" * 10_000, 10, 10, "rust"), 100)) == 100
    assert cut_line("😀😀", 1) == ["😀", "😀"]
    three = split_chunk(Chunk("a\n" + "b" * 5000 + "\nc\n", 10, 12, "rust"), 200)
    assert three[0].text == "a\n" and (three[0].start_line, three[0].end_line) == (10, 10) and three[-1].start_line == 12


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=30), st.integers(1, 5), st.integers(1, 30))
def test_batches_keep_order_and_limits(sizes, most, room):
    ranges = list(batches(sizes, most, room))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(sizes)))
    for a, b in ranges:
        assert b - a <= most and (sum(sizes[a:b]) <= room or b - a == 1)


def test_batch_ids_are_the_same_rule(spark):
    lists = [[], [5], [2, 10, 2], [4, 4, 4], [1] * 9, [30, 1, 1, 30]]
    got = values(spark, lists, "array<int>", batch_ids(F.col("x"), 2, 8))
    for sizes, (ids,) in zip(lists, got):
        want = [n for n, (a, b) in enumerate(batches(sizes, 2, 8)) for _ in range(a, b)]
        assert ids == want


def test_excludes():
    rx = re.compile(excludes_regex(resolve_excludes(["build/", "*.log", "/top.txt"])))
    for path in ("Cargo.lock", "x/yarn.lock", "tests/a.rs", "p/tests/x/y.rs", "a.test.ts", "m/a_test.py", "test_x.py", "q/conftest.py", "build/x", "a/build/y", "z/d.log", "top.txt"):
        assert rx.match(path), path
    for path in ("go.mod", "src/testing.rs", "examples/a.rs", "contest.py", "a/top.txt", "builder/x"):
        assert not rx.match(path), path
    assert not re.match(excludes_regex([]), "")
    assert "**/tests/**" not in resolve_excludes(index_tests=True)
