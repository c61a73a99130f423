"""The read commands as tools of a JSON-RPC server over standard input and output, one message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from weftline import api
from weftline.errors import WeftlineError

_TEXT, _WHOLE = {"type": "string"}, {"type": "integer"}
#: name -> (what it does, properties, required)
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "resolve": ("Where a node id lives and what its frontmatter says; follows redirects.", {"id": _TEXT}, ["id"]),
    "render": ("A node as portable Markdown with relative links.", {"id": _TEXT}, ["id"]),
    "backlinks": ("Nodes that reference an id.", {"id": _TEXT, "type": _TEXT, "limit": _WHOLE}, ["id"]),
    "refs": ("Nodes that an id references, within a number of hops.", {"id": _TEXT, "depth": _WHOLE, "type": _TEXT}, ["id"]),
    "search": ("Hybrid search; files with the sections that match.", {"query": _TEXT, "type": _TEXT, "scope": _TEXT, "limit": _WHOLE}, ["query"]),
    "suggest": ("Existing nodes that a descriptor may mean.", {"descriptor": _TEXT, "type": _TEXT, "limit": _WHOLE}, ["descriptor"]),
    "unresolved": ("References that name things without an id.", {"type": _TEXT, "scope": _TEXT}, []),
}
PROTOCOL = "2024-11-05"


def tools_list() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p} | ({"required": r} if r else {})} for n, (d, p, r) in TOOLS.items()]


class _Refused(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def call_tool(corpus: api.Corpus, params: dict) -> dict:
    """The result of a tool call; what the command refuses comes back as an error result, not as a protocol error."""
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        raise _Refused(-32602, f"unknown tool '{name}'")
    _, properties, required = TOOLS[name]
    given = {}
    for key, kind in properties.items():
        value = args.get(key)
        good = isinstance(value, str) if kind is _TEXT else isinstance(value, int) and not isinstance(value, bool) and value >= 0
        if good:
            given[key] = value
        elif key in required:
            raise _Refused(-32602, f"missing required argument '{key}'")
    try:
        value, failed = getattr(corpus, name)(**given), False
    except WeftlineError as e:
        value, failed = e.to_json(), True
    return {"content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False)}], "isError": failed}


def handle(corpus: api.Corpus, line: str) -> str | None:
    """The answer to one message; None for blank lines and notifications."""
    if not line.strip():
        return None
    try:
        message = json.loads(line)
    except ValueError as e:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"parse error: {e}"}})
    if not isinstance(message, dict) or "id" not in message:
        return None
    method, params = message.get("method") or "", message.get("params") or {}
    methods: dict[str, Callable[[], dict]] = {
        "initialize": lambda: {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "weftline", "version": "0.1.0"}},
        "tools/list": lambda: {"tools": tools_list()},
        "tools/call": lambda: call_tool(corpus, params),
        "ping": dict,
    }
    answer: dict = {"jsonrpc": "2.0", "id": message["id"]}
    try:
        if not method:
            raise _Refused(-32600, "invalid request: no method")
        if method not in methods:
            raise _Refused(-32601, f"unknown method '{method}'")
        answer["result"] = methods[method]()
    except _Refused as e:
        answer["error"] = {"code": e.code, "message": str(e)}
    return json.dumps(answer, ensure_ascii=False)


def serve(corpus: api.Corpus, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """Answer messages until the input ends."""
    for line in source:
        answer = handle(corpus, line)
        if answer is not None:
            sink.write(answer + "\n")
            sink.flush()
