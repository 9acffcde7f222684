"""The search tools over the Model Context Protocol: JSON-RPC 2.0 messages, one a line on standard input and output."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from brindle.edge.api import by_kind, tool_search

VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE, INVALID, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602

_QUERY = {"type": "string", "description": "What to look for, in natural language or as keywords."}
_LIMIT = {"type": "integer", "minimum": 1, "maximum": 100, "default": 5}
_SOURCE = {"type": "string", "description": "Only rows of exactly this source."}
_TIME = {"type": "number", "description": "Only queries that took at least so many milliseconds."}
#: name: (kind of vault, description, properties of the arguments)
TOOLS = {
    "search_documents": ("document", "Searches text and Markdown passages.", {"query": _QUERY, "limit": _LIMIT, "source_filter": _SOURCE}),
    "search_sql_logs": ("sql", "Searches logged SQL queries.", {"query": _QUERY, "limit": _LIMIT, "source_filter": _SOURCE, "min_time": _TIME}),
}


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _arguments(given: object, properties: dict) -> dict:
    if not isinstance(given, dict) or not isinstance(given.get("query"), str):
        raise Refused(BAD_PARAMS, "query must be a string")
    if unknown := sorted(set(given) - set(properties)):
        raise Refused(BAD_PARAMS, f"unknown arguments: {', '.join(unknown)}")
    limit = given.get("limit", 5)
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= 100:
        raise Refused(BAD_PARAMS, "limit must be from 1 to 100")
    return given


def _call(engines: dict, params: dict) -> dict:
    if params.get("name") not in TOOLS:
        raise Refused(BAD_PARAMS, f"no tool {params.get('name')!r}")
    kind, _, properties = TOOLS[params["name"]]
    text = tool_search(engines, kind, **_arguments(params.get("arguments", {}), properties))
    failed = by_kind(engines, kind) is None or text.startswith("Search execution failed")
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def _result(engines: dict, method: str, params: dict) -> dict:
    if method == "initialize":
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "brindle", "version": "0.1.0"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": ["query"]}} for n, (_, d, p) in TOOLS.items()]}
    if method == "tools/call":
        return _call(engines, params)
    raise Refused(NO_METHOD, f"no method {method!r}")


def answer(engines: dict, message: object) -> dict | None:
    """The answer to one message; none to a notification."""
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, "error": {"code": INVALID, "message": "no JSON-RPC 2.0 request"}}
    if "id" not in message:
        return None
    try:
        params = message.get("params") or {}
        if not isinstance(params, dict):
            raise Refused(BAD_PARAMS, "params must be an object")
        return {"jsonrpc": "2.0", "id": message["id"], "result": _result(engines, message["method"], params)}
    except Refused as e:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": e.code, "message": str(e)}}


def talk(engines: dict, lines: Iterable[str]) -> Iterator[str]:
    """Answers to lines of messages."""
    for line in lines:
        if not line.strip():
            continue
        try:
            found = answer(engines, json.loads(line))
        except ValueError:
            found = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "the line is no JSON"}}
        if found is not None:
            yield json.dumps(found, default=str)
