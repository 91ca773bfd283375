"""Ignore files above the root, the repository's own list and the user's."""

from __future__ import annotations

from hearthdex.operators.delta import delta, in_order
from hearthdex.sources.corpus import walk


def write(folder, files):
    for path, text in files.items():
        at = folder / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_rules_above_the_root(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    repository = tmp_path / "repo"
    write(tmp_path, {"home/.config/git/ignore": "*.swp\nkept.log\n", "above/.gitignore": "*\n"})
    write(repository, {
        ".git/info/exclude": "/sub/a\n/b\n", ".gitignore": "build/\n*.log\n/sub/c\n/d\n", ".ignore": "e\n", "sub/.gitignore": "!kept.log\n",
        **{f"sub/{p}": "" for p in ("a", "b", "c", "d", "e", "build/x.rs", "in/build/y.rs", "z.log", "kept.log", "f.swp", "g")},
    })
    assert list(walk(str(repository / "sub"))) == ["b", "d", "g", "kept.log"]
    assert [p for p in walk(str(repository)) if p.startswith("sub/")] == ["sub/b", "sub/d", "sub/g", "sub/kept.log"]
    assert list(walk(str(repository / "sub" / "in"))) == []
    write(tmp_path, {"home/.gitconfig": "[core]\n\texcludesFile = ~/mine\n", "home/mine": "g\n"})
    assert list(walk(str(repository / "sub"))) == ["b", "d", "f.swp", "kept.log"]


def test_outside_a_repository_only_own_ignore_files_count(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    write(tmp_path, {"home/.config/git/ignore": "a\n", ".gitignore": "b\n", "tree/.gitignore": "c\n", "tree/.ignore": "d\n", **{f"tree/{p}": "" for p in "abcde"}})
    assert list(walk(str(tmp_path / "tree"))) == ["a", "b", "c", "e"]


def test_differences_in_order(spark):
    now = spark.createDataFrame([("z", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    old = spark.createDataFrame([("z", "0"), ("a", "1"), ("c", "3")], "path string, hash string")
    assert [tuple(r) for r in in_order(delta(now, old)).collect()] == [("a", "deleted"), ("b", "changed"), ("z", "changed")]
