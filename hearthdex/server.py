"""Three tools over lines of JSON-RPC on standard input and output."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from hearthdex import __version__
from hearthdex.engine import LazyEngine
from hearthdex.health import diagnose, render as render_health
from hearthdex.operators.select import render, render_rows

TOOLS = [
    {
        "name": "search",
        "description": "Find code by meaning; the index is brought up to date first.",
        "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "k": {"type": "integer", "minimum": 0}}, "required": ["query"]},
    },
    {
        "name": "read_file",
        "description": "A file's outline, or with a focus its nearest definitions.",
        "inputSchema": {"type": "object", "properties": {"path": {"type": "string"}, "focus": {"type": "string"}}, "required": ["path"]},
    },
    {"name": "diagnostics", "description": "The state of each stage.", "inputSchema": {"type": "object", "properties": {}}},
]


def call(engine: LazyEngine, config, name: str, arguments: dict) -> str:
    """The tool's text; errors are text too."""
    if name == "diagnostics":
        try:
            return render_health(diagnose(config, engine.get()))
        except Exception as x:  # noqa: BLE001
            return render_health(diagnose(config, None, str(x)))
    try:
        if name == "search":
            return render_rows(engine.get().answer(arguments["query"], arguments.get("k")))
        if name == "read_file":
            return render(engine.get().read_file(arguments["path"], arguments.get("focus")))
        return f"error: no tool {name}"
    except Exception as x:  # noqa: BLE001
        return f"error: {x}"


def answer(engine: LazyEngine, config, request: dict) -> dict | None:
    """The reply to one message; None for notifications."""
    if "id" not in request:
        return None
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "hearthdex", "version": __version__}}
    elif method == "tools/list":
        result = {"tools": TOOLS}
    elif method == "tools/call":
        result = {"content": [{"type": "text", "text": call(engine, config, params.get("name", ""), params.get("arguments") or {})}]}
    elif method == "ping":
        result = {}
    else:
        return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": f"no method {method}"}}
    return {"jsonrpc": "2.0", "id": request["id"], "result": result}


def serve(engine: LazyEngine, config, inp: TextIO | None = None, out: TextIO | None = None) -> None:
    out = out or sys.stdout
    for line in inp or sys.stdin:
        try:
            reply = answer(engine, config, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()
