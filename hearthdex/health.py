"""A report of eight checks, worst first in its heading."""

from __future__ import annotations

import platform
from dataclasses import dataclass

import pyspark
from pyspark.sql import Column, DataFrame, functions as F

from hearthdex import __version__
from hearthdex.chunking.structural import CHUNKER_VERSION
from hearthdex.config import Config, overridden
from hearthdex.embedding.budget import concurrency
from hearthdex.engine import Engine

#: Severities from best to worst.
SEVERITY = ("pass", "warn", "fail")


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    detail: str


def worst(status: Column) -> Column:
    """The worst status of a group; pass where there is none."""
    rank = F.when(status == "fail", 2).when(status == "warn", 1).otherwise(0)
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.coalesce(F.max(rank), F.lit(0)) + 1)


def overall(checks: list[Check]) -> str:
    return max((c.status for c in checks), key=SEVERITY.index, default="pass")


def render(checks: list[Check]) -> str:
    state = overall(checks)
    fails = sum(c.status == "fail" for c in checks)
    head = f"FAIL, {fails} of {len(checks)}" if state == "fail" else state.upper()
    return f"Health of hearthdex: {head}\n" + "".join(f"  [{c.status.upper()}] {c.name}: {c.detail}\n" for c in checks)


def diagnose(config: Config, engine: Engine | None, error: str = "") -> list[Check]:
    """All checks, whatever fails. The sample query comes before what it may change: the counts, limits and failures."""
    names = overridden(config)
    out = [
        Check("build", "pass", f"hearthdex {__version__}, chunker {CHUNKER_VERSION}, Spark {pyspark.__version__}, Python {platform.python_version()}"),
        Check("config", "pass", f"set: {', '.join(names)}" if names else "built-in settings"),
    ]
    if engine is None:
        skipped = [Check(n, "fail", "not checked without an engine") for n in ("index", "query", "limits", "reconcile", "watcher")]
        return [*out, Check("embedder", "fail", error or "not there"), *skipped]
    out.append(Check("embedder", "pass", f"{engine.embedder.id}, {engine.embedder.dim} numbers"))
    try:
        n = engine.search("function definition", 1).count()
        query = Check("query", "pass", f"a test search found {n}") if n else Check("query", "warn", "a test search found nothing")
    except Exception as x:  # noqa: BLE001 - a report must not fail
        query = Check("query", "fail", f"a test search failed: {x}")
    files, chunks = engine.index.stats()
    out.append(Check("index", "pass" if chunks else "fail", f"{files} files, {chunks} chunks" + ("" if chunks else "; the index is empty")))
    out.append(query)
    probed = engine.embedder.max_input_tokens
    window = f"context window {probed} tokens ({engine.embedder.caps_source})" if probed else f"context window not reported, {config.embedder.max_chunk_tokens} tokens assumed"
    lanes = concurrency(config.embedder.concurrency, engine.embedder.max_concurrent_requests)
    out.append(Check("limits", "warn" if engine.budget.tightened else "pass", f"{window}; chunks up to {engine.budget.bytes} bytes; {lanes} request(s) at once"))
    failed = engine.last.failed
    out.append(Check("reconcile", "warn" if failed else "pass", engine.last.report() if failed else f"{engine.last.indexed} file(s) indexed in the last run"))
    active = engine.state.watch_active
    out.append(Check("watcher", "pass" if active or not config.watch.enabled else "warn", "active" if active else "inactive, each search scans"))
    return out


def report(engine: Engine) -> DataFrame:
    return engine.spark.createDataFrame([(i, c.name, c.status, c.detail) for i, c in enumerate(diagnose(engine.config, engine))], "place int, name string, status string, detail string")
