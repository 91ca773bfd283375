"""``python -m hearthdex serve|status|reindex|doctor|search``."""

from __future__ import annotations

import argparse
import tempfile

from hearthdex.config import ConfigError, load, resolve_repo
from hearthdex.engine import Engine, LazyEngine, RefreshError
from hearthdex.health import diagnose, overall, render as render_health
from hearthdex.operators.select import render
from hearthdex.session import local_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="hearthdex")
    parser.add_argument("command", choices=["serve", "status", "reindex", "doctor", "search"])
    parser.add_argument("query", nargs="?")
    parser.add_argument("--repo")
    parser.add_argument("--config")
    parser.add_argument("-k", type=int)
    args = parser.parse_args(argv)
    try:
        config = load(resolve_repo(args.repo), args.config)
    except ConfigError as x:
        print(f"error: {x}")
        return 2
    lazy = LazyEngine(lambda: Engine(local_session("*"), config))
    if args.command == "serve":
        from hearthdex.server import serve
        from hearthdex.streaming.watch import Watcher

        if config.watch.enabled:
            import threading

            threading.Thread(target=lambda: Watcher(lazy.get(), tempfile.mkdtemp(prefix="hearthdex-watch-")).start(), daemon=True).start()
        serve(lazy, config)
        return 0
    if args.command == "doctor":
        try:
            checks = diagnose(config, lazy.get())
        except Exception as x:  # noqa: BLE001
            checks = diagnose(config, None, str(x))
        print(render_health(checks), end="")
        return int(overall(checks) == "fail")
    try:
        engine = lazy.get()
        if args.command == "search":
            print(render(engine.search(args.query or "", args.k)), end="")
            return 0
        summary = engine.reindex() if args.command == "reindex" else engine.refresh()
        files, chunks = engine.index.stats()
        print(f"{files} files, {chunks} chunks" + (f" ({summary.indexed} indexed)" if args.command == "reindex" else ""))
        return 0
    except (RefreshError, OSError, ValueError) as x:
        print(f"error: {x}")
        return 1
