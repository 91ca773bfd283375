from __future__ import annotations

import pytest

from hearthdex.config import Config, ConfigError, expand, load, merged, overridden, parse, resolve_repo
from hearthdex.sources.ignore import is_ignored, parse_rules


def test_levels(tmp_path):
    home, repo = tmp_path / "home", tmp_path / "repo"
    (home / ".config/hearthdex").mkdir(parents=True)
    repo.mkdir()
    (home / ".config/hearthdex/config.toml").write_text('languages = ["go"]\nstrip = false\n[search]\nmax_results = 7\ntoken_budget = 9\n')
    (repo / "hearthdex.toml").write_text('[search]\nmax_results = 3\ntoken_budget = 4000\n')
    c = load(str(repo), home=str(home))
    assert (c.languages, c.strip, c.search.max_results) == (["go"], False, 3)
    assert c.search.token_budget == 9  # a built-in value can't override
    other = tmp_path / "other.toml"
    other.write_text("index_tests = true\nstrip_comments = false\n")
    c = load(str(repo), str(other), str(home))
    assert c.index_tests and c.search.max_results == 7 and not c.strip
    with pytest.raises(ConfigError):
        load(str(repo), str(tmp_path / "none.toml"), str(home))
    assert overridden(c) == ["languages", "index_tests", "strip", "search.max_results", "search.token_budget"] and overridden(Config()) == []


def test_errors():
    for text in ("nope = 1", "strip = 3", "search = 1", "a = ["):
        with pytest.raises(ConfigError):
            parse(text)
    assert parse("[search]\nrelevance_ratio = 1").search.relevance_ratio == 1
    assert merged(Config(repo_root="a"), Config(repo_root="b")).repo_root == "a"


def test_environment():
    env = {"KEY": " v ", "BLANK": " "}
    assert [expand(x, env) for x in ("${KEY}", "$KEY", "plain", "${BLANK}", "", "a$KEY", "${KEY")] == ["v", "v", "plain", None, None, "a$KEY", "${KEY"]
    with pytest.raises(ConfigError):
        expand("$NONE", env)


def test_repository(tmp_path):
    (tmp_path / ".git").write_text("gitdir: x")
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert resolve_repo(None, str(deep)) == str(tmp_path) and resolve_repo("x", str(deep)) == "x"


def test_ignore_rules():
    rules = parse_rules("# c\n\n*.log\n!keep.log\n/top\ndoc/*.txt\nbuild/\na/**/z\n\\#odd\n", "")
    ignored = lambda path, folder=False: is_ignored(path, folder, rules)
    assert ignored("x.log") and ignored("d/x.log") and not ignored("d/keep.log")
    assert ignored("top") and not ignored("d/top") and ignored("doc/a.txt") and not ignored("doc/d/a.txt")
    assert ignored("d/build", True) and not ignored("d/build") and ignored("a/z") and ignored("a/b/c/z") and ignored("#odd")
    assert is_ignored("sub/x.tmp", False, parse_rules("*.tmp", "sub")) and not is_ignored("x.tmp", False, parse_rules("*.tmp", "sub"))
