from __future__ import annotations

import io
import json
import os
import time

import pytest

from hearthdex.config import Config
from hearthdex.embedding.autostart import connect_or_start
from hearthdex.embedding.base import EmbedError, MockEmbedder, TransientError
from hearthdex.engine import Engine, LazyEngine, RefreshError
from hearthdex.health import Check, diagnose, overall, render, report
from hearthdex.operators.select import render as render_entries
from hearthdex.server import answer, serve
from hearthdex.sources.corpus import CorpusSource, scan, sources, walk
from hearthdex.streaming.watch import Watcher, listing


def write(root, **files):
    for name, text in files.items():
        at = os.path.join(root, name.replace("__", "/").replace("_dot_", "."))
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def make(spark, root, embedder=None, **config):
    return Engine(spark, Config(repo_root=str(root), **config), embedder or MockEmbedder(16), pauses=(0, 0))


def symbols(engine):
    return sorted((r["path"], r["symbol"]) for r in engine.index.chunks().select("path", "symbol").collect())


def test_walk_and_scan(spark, tmp_path):
    write(tmp_path, a_dot_rs="fn a() {}", **{"pkg/_init.py": ""}, empty_dot_rs="", _dot_hid__z_dot_rs="x", skip_dot_log="x", keep__b_dot_log="x", _dot_gitignore="*.log\n!b.log\nbuild/\n", build__x_dot_rs="x", tests__t_dot_rs="x")
    os.makedirs(tmp_path / ".git")
    os.symlink(tmp_path / "a.rs", tmp_path / "link.rs")
    assert list(walk(str(tmp_path), ["**/tests/**"])) == ["a.rs", "empty.rs", "keep/b.log", "pkg/_init.py"]
    rows = {r["path"]: r["hash"] for r in scan(spark, str(tmp_path)).collect()}
    assert len(rows) == 5 and rows["empty.rs"] == rows["pkg/_init.py"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    spark.dataSource.register(CorpusSource)
    read = spark.read.format("corpus").option("excludes", "**/*.log").load(str(tmp_path))
    assert sorted(r["path"] for r in read.collect()) == ["a.rs", "empty.rs", "pkg/_init.py", "tests/t.rs"]
    write(tmp_path, bad_dot_rs=b"\xff\xfe\x00\x01")
    found = sources(spark.createDataFrame([("a.rs", 1), ("bad.rs", 2), ("gone.rs", 3)], "path string, n int"), str(tmp_path))
    assert [(r["path"], r["n"], r["text"]) for r in found.collect()] == [("a.rs", 1, "fn a() {}")]


def test_reconcile_and_search(spark, tmp_path):
    write(tmp_path, auth_dot_rs="use a;\n\npub fn verify_token(t: &str) -> bool { true }\n", util_dot_py="def helper(x):\n    return x\n", empty_dot_rs="", bad_dot_rs=b"\xff\xfe\x00\x01", Cargo_dot_lock="x", note_dot_md="# x\n", c_dot_tsx="class X {}\n")
    engine = make(spark, tmp_path)
    assert engine.reconcile().indexed == 3 and symbols(engine) == [("auth.rs", "verify_token"), ("util.py", "helper")]
    assert engine.reconcile().indexed == 0
    text = "pub fn verify_token(t: &str) -> bool { true }"
    first = engine.search(text, 2).first()
    assert (first["path"], first["rank"], first["why_matched"]) == ("auth.rs", 1, "similarity 1.000")
    write(tmp_path, util_dot_py="def other(x):\n    return x\n")
    os.remove(tmp_path / "auth.rs")
    assert render_entries(engine.search("other")).startswith("util.py:1-2 [other]")
    assert symbols(engine) == [("util.py", "other")]
    narrowed = make(spark, tmp_path, excludes=["util.py"])
    assert narrowed.search("other").count() == 0 and symbols(narrowed) == []


def test_one_bad_file_does_not_stop_the_others(spark, tmp_path):
    write(tmp_path, a_dot_rs="fn a() {}", b_dot_rs="fn POISON() {}", c_dot_rs="fn c() {}")
    engine = make(spark, tmp_path, MockEmbedder(16, poison="POISON"))
    summary = engine.reconcile()
    assert summary.indexed == 2 and [p for p, _ in summary.failed] == ["b.rs"] and engine.state.dirty
    with pytest.raises(RefreshError, match="b.rs: "):
        engine.refresh()


def test_auth_and_breaker_stop_the_run(spark, tmp_path):
    write(tmp_path, **{f"f{i:02}_dot_rs": f"fn f{i}() {{}}" for i in range(12)})
    at = str(tmp_path.parent / tmp_path.name)
    calls = MockEmbedder(16, always="auth", count_in=at + ".auth")
    summary = make(spark, tmp_path, calls).reconcile()
    assert summary.indexed == 0 and len(summary.failed) == 12 and calls.calls() == 1
    down = MockEmbedder(16, always="transient", count_in=at + ".down")
    assert len(make(spark, tmp_path, down).reconcile().failed) == 12 and down.calls() == 15
    blips = MockEmbedder(16, fail_first=9, count_in=at + ".blips")
    summary = make(spark, tmp_path, blips).reconcile()
    assert (summary.indexed, len(summary.failed)) == (9, 3)


def test_overflow_is_split_again(spark, tmp_path):
    write(tmp_path, big_dot_rs="fn big() {\n" + "    call();\n" * 400 + "}\n", ok_dot_rs="fn ok() {}\n")
    engine = make(spark, tmp_path, MockEmbedder(16, limit=300, bytes_per_token=3))
    assert engine.reconcile() .failed == [] and engine.budget.tightened
    pieces = [r["text"] for r in engine.index.chunks().where("path = 'big.rs'").orderBy("chunk_index").collect()]
    assert len(pieces) > 1 and max(map(len, pieces)) <= 900 and "".join(pieces).count("call") == 400
    entries = engine.read_file("big.rs", "call").collect()
    assert len(entries) == 5 and all("partial" in r["why_matched"] for r in entries)


def test_read_file(spark, tmp_path):
    write(tmp_path, util_dot_py="def a():\n    pass\n\ndef b():\n    pass\n")
    engine = make(spark, tmp_path)
    assert [(r["code"], r["why_matched"]) for r in engine.read_file("util.py").orderBy("rank").collect()] == [("def a():", "outline"), ("def b():", "outline")]
    assert engine.read_file("util.py", "def b():\n    pass").first()["symbol"] == "b"
    with pytest.raises(ValueError):
        engine.read_file("../etc/passwd")
    with pytest.raises(OSError):
        engine.read_file("none.py")


def test_answers_end_in_time(spark, tmp_path, monkeypatch):
    write(tmp_path, a_dot_rs="fn a() {}")
    engine = make(spark, tmp_path)
    assert [r["symbol"] for r in engine.answer("fn a() {}")] == ["a"]
    engine.config.search.search_timeout_secs = 1
    slow = spark.range(2).mapInPandas(lambda batches: (time.sleep(15) or b for b in batches), "id long")
    monkeypatch.setattr(engine, "search", lambda *a, **k: slow)
    with pytest.raises(EmbedError, match="longer than 1 s"):
        engine.answer("x")


def test_starting_a_server(tmp_path):
    tries = []

    def connect():
        tries.append(1)
        if len(tries) < 3:
            raise TransientError("refused")
        return MockEmbedder(4)

    found, child = connect_or_start(connect, "http://127.0.0.1:9", "sleep 30", 5, 0.01)
    assert found.dim == 4 and child.poll() is None
    child.kill()
    for base, command in (("http://far.example:9", "sleep 30"), ("http://127.0.0.1:9", None)):
        tries.clear()
        with pytest.raises(TransientError):
            connect_or_start(connect, base, command)
        assert len(tries) == 1
    with pytest.raises(EmbedError, match="ended with"):
        tries.clear()
        connect_or_start(lambda: (_ for _ in ()).throw(TransientError("no")), "http://127.0.0.1:9", "false", 5, 0.2)


def test_skipping_the_scan_needs_a_watcher(spark, tmp_path):
    write(tmp_path, a_dot_rs="fn a() {}")
    engine = make(spark, tmp_path)
    engine.reconcile()
    write(tmp_path, b_dot_rs="fn b() {}")
    engine.state.watch_active = True
    engine.ensure_fresh()
    assert len(symbols(engine)) == 1
    engine.state.dirty = True
    engine.ensure_fresh()
    assert len(symbols(engine)) == 2 and engine.state.can_skip_scan()


def test_watcher(spark, tmp_path):
    root = tmp_path / "src"
    write(root, a_dot_rs="fn a() {}")
    engine = make(spark, root, index_dir=str(tmp_path / "index"))
    watcher = Watcher(engine, str(tmp_path / "stream"))
    query = watcher.start()
    try:
        query.processAllAvailable()
        assert engine.state.watch_active and len(symbols(engine)) == 1
        write(root, b_dot_rs="fn b() {}")
        os.remove(root / "a.rs")
        for _ in range(120):
            if symbols(engine) == [("b.rs", "b")]:
                break
            time.sleep(0.5)
        assert symbols(engine) == [("b.rs", "b")] and watcher.poll()
    finally:
        watcher.stop()
    assert not engine.state.watch_active and engine.state.dirty
    assert list(listing(str(root))) == ["b.rs"]


def test_health_and_tools(spark, tmp_path):
    write(tmp_path, a_dot_rs="fn a() {}")
    engine = make(spark, tmp_path)
    checks = diagnose(engine.config, engine)
    assert [c.name for c in checks] == ["build", "config", "embedder", "index", "query", "limits", "reconcile", "watcher"]
    assert overall(checks) == "warn" and "[PASS] index: 1 files, 1 chunks" in render(checks)
    assert report(engine).count() == 8
    assert overall(diagnose(engine.config, None, "down")) == "fail" and overall([]) == "pass"
    assert render([Check("x", "fail", "y"), Check("z", "pass", "w")]).startswith("Health of hearthdex: FAIL, 1 of 2\n")

    made = []

    def build():
        made.append(1)
        if len(made) == 1:
            raise OSError("not yet")
        return engine

    lazy = LazyEngine(build)
    say = lambda method, **params: answer(lazy, engine.config, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params})["result"]
    assert say("initialize")["serverInfo"]["name"] == "hearthdex"
    assert [t["name"] for t in say("tools/list")["tools"]] == ["search", "read_file", "diagnostics"]
    call = lambda name, **a: say("tools/call", name=name, arguments=a)["content"][0]["text"]
    assert call("search", query="fn a() {}") == "error: not yet"
    assert call("search", query="fn a() {}").startswith("a.rs:1-1 [a]")
    assert call("read_file", path="../x").startswith("error: ") and call("read_file", path="a.rs").startswith("a.rs:1-1 [a] (outline)")
    assert "Health of" in call("diagnostics") and call("none") == "error: no tool none"
    out = io.StringIO()
    serve(lazy, engine.config, io.StringIO('nonsense\n{"method":"note"}\n{"id":2,"method":"ping"}\n{"id":3,"method":"x"}\n'), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [None, 2, 3] and replies[2]["error"]["code"] == -32601
