"""A tool server over standard input and output: JSON-RPC messages, one per line, whose tools are the read commands and the overrides."""

from __future__ import annotations

import contextlib
import io
import json
import sys
from typing import TextIO

from pyspark.sql import SparkSession

_TEXT = {"type": "string"}
#: Tools by name: what they tell, their arguments, those that are required, and the command line they stand for.
TOOLS = {
    "plan": ("the slices of a branch with their dependencies", ["branch"], [], lambda a: ["plan", a["branch"]]),
    "verify": ("whether the declared units rebuild the branch", ["branch"], ["manifest"], lambda a: ["verify", a["branch"]]),
    "validate_plan": ("findings of a declared grouping", ["branch"], ["manifest"], lambda a: ["validate", a["branch"]]),
    "review_context": ("the state of each unit's review", ["branch"], ["manifest", "projection", "comments", "stacks"], lambda a: ["review-context", a["branch"]]),
    "stack_status": ("the chains of stored pull requests and their stacks", ["branch"], ["stacks"], lambda a: ["stack", "status", a["branch"]]),
    "override_list": ("stored overrides of a branch", ["branch"], [], lambda a: ["override", "list", a["branch"]]),
    "override_add": ("store an override", ["branch", "kind", "selector_a"], ["selector_b"], lambda a: ["override", "add", a["branch"], a["kind"], a["selector_a"], *([a["selector_b"]] if a.get("selector_b") else [])]),
    "override_remove": ("remove a stored override", ["branch", "id"], [], lambda a: ["override", "remove", a["branch"], str(a["id"])]),
}


def answer(spark: SparkSession, repo: str, base: str, message: dict) -> dict | None:
    """The reply to one message; None for a notification."""
    from hunkweave.cli import run

    number, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    if number is None:
        return None

    def reply(result: dict) -> dict:
        return {"jsonrpc": "2.0", "id": number, "result": result}

    if method == "initialize":
        return reply({"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "hunkweave", "version": "1"}})
    if method == "tools/list":
        tools = [{"name": n, "description": about, "inputSchema": {"type": "object", "properties": {k: _TEXT for k in (*needed, *more)}, "required": needed}} for n, (about, needed, more, _) in TOOLS.items()]
        return reply({"tools": tools})
    if method != "tools/call":
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"unknown method {method}"}}
    tool, given = TOOLS.get(params.get("name")), params.get("arguments") or {}
    missing = [k for k in tool[1] if not given.get(k)] if tool else []
    if tool is None or missing:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": -32602, "message": f"unknown tool or missing {', '.join(missing)}"}}
    flags = [] if params["name"] == "override_add" else [x for k in tool[2] if given.get(k) for x in (f"--{k.replace('_', '-')}", str(given[k]))]
    out, err = io.StringIO(), io.StringIO()
    try:
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
            status = run(spark, ["--repo", repo, "--base", base, "--json", *tool[3](given), *flags])
    except (Exception, SystemExit) as e:
        status = 1
        err.write(str(e))
    return reply({"content": [{"type": "text", "text": out.getvalue() + err.getvalue()}], "isError": bool(status)})


def loop(spark: SparkSession, repo: str, base: str, source: TextIO | None = None, sink: TextIO | None = None) -> int:
    """Answer messages until the input ends."""
    source, sink = source or sys.stdin, sink or sys.stdout
    for line in source:
        if line.strip():
            try:
                found = answer(spark, repo, base, json.loads(line))
            except ValueError:
                found = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if found is not None:
                print(json.dumps(found), file=sink, flush=True)
    return 0
