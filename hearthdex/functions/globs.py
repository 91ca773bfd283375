"""Path patterns compiled once to regular expressions that the JVM evaluates."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

#: Lock files, left out always. Fixed values.
LOCK_FILES = (
    "Cargo.lock package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lock bun.lockb poetry.lock Pipfile.lock uv.lock "
    "Gemfile.lock composer.lock go.sum mix.lock flake.lock packages.lock.json"
).split()
#: Test files, left out unless tests are indexed. Fixed values.
TEST_GLOBS = ("**/tests/**", "**/benches/**", "**/__tests__/**", "**/*.test.*", "**/*.spec.*", "**/*_test.*", "**/test_*.py", "**/conftest.py")


def resolve_excludes(user: Iterable[str] = (), index_tests: bool = False) -> list[str]:
    """Lock files, then tests, then the user's patterns."""
    return [f"**/{name}" for name in LOCK_FILES] + ([] if index_tests else list(TEST_GLOBS)) + list(user)


def glob_regex(pattern: str) -> str:
    """A regular expression for whole paths: ``**`` crosses directories, ``*`` and ``?`` do not.

    As in ignore files, a pattern without a slash but at its end matches at any depth,
    and what matches a directory matches all below it.
    """
    anchored = "/" in pattern.rstrip("/")
    pattern = pattern.strip("/")
    out, i = "" if anchored or pattern.startswith("**") else "(?:.*/)?", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, pattern[i + 1 : end].split(","))) + ")", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out + "(?:/.*)?"


def excludes_regex(patterns: Iterable[str]) -> str:
    """One expression for all patterns; with none it matches nothing."""
    each = [glob_regex(p) for p in patterns]
    return f"^(?:{'|'.join(each)})$" if each else r"^\b\B$"


def is_excluded(path: Column, patterns: Iterable[str]) -> Column:
    return path.rlike(excludes_regex(patterns))


def is_language_allowed(ext: Column, language: Column, allowed: Iterable[str]) -> Column:
    """Whether the extension or the language is on the list, whatever their case; an empty list allows all."""
    names = [x.lower() for x in allowed]
    if not names:
        return F.lit(True)
    return F.lower(ext).isin(names) | F.coalesce(F.lower(language).isin(names), F.lit(False))
