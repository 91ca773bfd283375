"""Ignore files while walking a tree."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from hearthdex.functions.globs import glob_regex


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file; ``base`` is its folder, relative to the repository, or to the root outside one."""

    base: str
    regex: re.Pattern
    negated: bool
    folders_only: bool


def parse_rules(text: str, base: str) -> list[Rule]:
    """Rules of an ignore file: comments and blank lines vanish, a backslash keeps what follows."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
        folders_only = line.endswith("/")
        bare = line.rstrip("/")
        if not bare:
            continue
        pattern = glob_regex(bare if "/" in bare else "**/" + bare)
        out.append(Rule(base, re.compile(pattern.removesuffix("(?:/.*)?") + r"\Z", re.S), negated, folders_only))
    return out


def is_ignored(path: str, is_folder: bool, rules: list[Rule]) -> bool:
    """The last rule that matches decides; ``path`` is relative to what the rules' bases are, with ``/``."""
    for rule in reversed(rules):
        if rule.folders_only and not is_folder:
            continue
        inside = path if not rule.base else path[len(rule.base) + 1 :] if path.startswith(rule.base + "/") else None
        if inside is not None and rule.regex.match(inside):
            return not rule.negated
    return False


def read_rules(folder: str, base: str, in_repository: bool) -> list[Rule]:
    """Rules of the ignore files in a folder; ``.gitignore`` counts inside a repository only."""
    out = []
    for name in ([".gitignore"] if in_repository else []) + [".ignore"]:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                out += parse_rules(f.read(), base)
        except OSError:
            pass
    return out


def find_repository(start: str) -> str | None:
    """The nearest folder from ``start`` upwards that has ``.git``, a folder or a file."""
    at = os.path.abspath(start)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def _rules_of(at: str, base: str = "") -> list[Rule]:
    try:
        with open(at, encoding="utf-8", errors="replace") as f:
            return parse_rules(f.read(), base)
    except OSError:
        return []


def user_list() -> str:
    """The user's list of ignored files: as their settings name it, else at its usual place."""
    home = os.path.expanduser("~")
    folder = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    for settings in (os.path.join(home, ".gitconfig"), os.path.join(folder, "git", "config")):
        try:
            with open(settings, encoding="utf-8", errors="replace") as f:
                named = re.search(r"^\s*excludesfile\s*=\s*\"?([^\"\n]+?)\"?\s*$", f.read(), re.M | re.I)
        except OSError:
            continue
        if named:
            return os.path.expanduser(named[1])
    return os.path.join(folder, "git", "ignore")


def rules_above(root: str, repository: str | None) -> tuple[list[Rule], str]:
    """Rules that hold at ``root`` before its own, weakest first, and the root's place in the repository with ``/`` behind it.

    They are the user's list, the repository's own and the ignore files of the folders from the repository down
    to above the root. Their paths are relative to the repository. Outside a repository there are none.
    """
    if repository is None:
        return [], ""
    inside = os.path.relpath(os.path.realpath(root), os.path.realpath(repository))
    parts = [] if inside == "." else inside.split(os.sep)
    rules = _rules_of(user_list()) + _rules_of(os.path.join(repository, ".git", "info", "exclude"))
    for n in range(len(parts)):
        rules += read_rules(os.path.join(repository, *parts[:n]), "/".join(parts[:n]), True)
    return rules, "".join(f"{p}/" for p in parts)
