"""Settings in three levels: built-in, the user's, the repository's."""

from __future__ import annotations

import os
import re
import tomllib
from copy import deepcopy
from dataclasses import dataclass, field, fields, is_dataclass

from hearthdex.sources.ignore import find_repository


class ConfigError(ValueError):
    pass


@dataclass
class Embedder:
    backend: str = "mock"
    endpoint: str = "http://127.0.0.1:8080"
    model: str = ""
    api_key: str = ""
    max_batch_chunks: int = 64
    max_batch_bytes: int = 32_000
    max_chunk_tokens: int = 2048
    request_timeout_secs: int = 30
    start_command: str = ""
    start_timeout_secs: int = 600
    concurrency: int | None = None


@dataclass
class Search:
    max_results: int = 25
    relevance_ratio: float = 0.75
    token_budget: int = 4000
    search_timeout_secs: int = 60


@dataclass
class Watch:
    enabled: bool = True
    debounce_ms: int = 200


@dataclass
class Config:
    repo_root: str = "."
    index_dir: str = ""
    languages: list[str] = field(default_factory=lambda: ["rust", "python", "typescript"])
    excludes: list[str] = field(default_factory=list)
    index_tests: bool = False
    strip: bool = True
    embedder: Embedder = field(default_factory=Embedder)
    search: Search = field(default_factory=Search)
    watch: Watch = field(default_factory=Watch)

    def index_folder(self) -> str:
        """Outside the walked files: hidden names are never indexed."""
        return self.index_dir or os.path.join(self.repo_root, ".hearthdex")


#: Older names of settings.
RENAMED = {"strip_comments": "strip"}
_NAME = re.compile(r"\$\{([A-Za-z_]\w*)\}\Z|\$([A-Za-z_]\w*)\Z")


def _fill(target: object, values: dict, where: str = "") -> None:
    known = {f.name for f in fields(target)}
    for name, value in values.items():
        name = RENAMED.get(name, name)
        if name not in known:
            raise ConfigError(f"unknown setting {where}{name}")
        now = getattr(target, name)
        if is_dataclass(now):
            if not isinstance(value, dict):
                raise ConfigError(f"{where}{name} must be a table")
            _fill(now, value, f"{where}{name}.")
        elif now is not None and not isinstance(value, type(now)) and not (isinstance(now, float) and isinstance(value, int)):
            raise ConfigError(f"{where}{name} has the wrong type")
        else:
            setattr(target, name, value)


def parse(text: str) -> Config:
    out = Config()
    try:
        _fill(out, tomllib.loads(text))
    except tomllib.TOMLDecodeError as x:
        raise ConfigError(str(x)) from None
    return out


def merged(base: object, over: object) -> object:
    """``over`` wins where it differs from the built-in value; lists are replaced whole. ``repo_root`` is the base's."""
    out, default = deepcopy(base), type(base)()
    for f in fields(base):
        value = getattr(over, f.name)
        if is_dataclass(value):
            setattr(out, f.name, merged(getattr(base, f.name), value))
        elif f.name != "repo_root" and value != getattr(default, f.name):
            setattr(out, f.name, value)
    return out


def overridden(config: object, where: str = "") -> list[str]:
    """Names of the settings that differ from the built-in ones; never their values."""
    out, default = [], type(config)()
    for f in fields(config):
        value = getattr(config, f.name)
        if is_dataclass(value):
            out += overridden(value, f"{where}{f.name}.")
        elif f.name != "repo_root" and value != getattr(default, f.name):
            out.append(where + f.name)
    return out


def load(repo_root: str, explicit: str | None = None, home: str | None = None) -> Config:
    """The user's file under the repository's; ``explicit`` stands in for the latter and must exist."""
    out = Config(repo_root=repo_root)
    user = os.path.join(home or os.path.expanduser("~"), ".config", "hearthdex", "config.toml")
    for at, needed in ((user, False), (explicit or os.path.join(repo_root, "hearthdex.toml"), explicit is not None)):
        try:
            with open(at, encoding="utf-8") as f:
                out = merged(out, parse(f.read()))
        except FileNotFoundError:
            if needed:
                raise ConfigError(f"no file {at}") from None
    return out


def expand(value: str, env: dict[str, str] | None = None) -> str | None:
    """``${NAME}`` or ``$NAME`` as the whole value is read from the environment; unset is an error, blank is None."""
    env = os.environ if env is None else env
    m = _NAME.match(value.strip())
    if m:
        name = m[1] or m[2]
        if name not in env:
            raise ConfigError(f"environment variable {name} is not set")
        value = env[name]
    return value.strip() or None


def resolve_repo(explicit: str | None, start: str = ".") -> str:
    """The path as given, else the nearest repository upwards."""
    if explicit:
        return explicit
    found = find_repository(start)
    if found is None:
        raise ConfigError(f"no repository at or above {os.path.abspath(start)}")
    return found
