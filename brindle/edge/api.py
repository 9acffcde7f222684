"""HTTP-shaped functions, (status, body), and a small server over them; tools that answer in text."""

from __future__ import annotations

import json
import logging
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from brindle.edge.report import tool_text

log = logging.getLogger("brindle.api")


def by_kind(engines: dict, kind: str):
    """The first engine whose vault is of the kind."""
    return next((e for e in engines.values() if e.spec.mapper_type == kind), None)


def health(engines: dict) -> tuple[int, dict]:
    if not engines:
        return 503, {"detail": "no engine is ready"}
    return 200, {"status": "ok"} | {f"{k}_model": e.spec.model_name for k, e in engines.items()}


def _invalid(request: dict, kind: str) -> str | None:
    if not isinstance(request, dict) or not isinstance(request.get("query"), str):
        return "query must be a string"
    limit = request.get("limit", 5)
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= 100:
        return "limit must be from 1 to 100"
    if request.get("source_filter") is not None and not isinstance(request["source_filter"], str):
        return "source_filter must be a string"
    low = request.get("min_time")
    if kind == "sql" and low is not None and (not isinstance(low, (int, float)) or isinstance(low, bool)):
        return "min_time must be a number"
    return None


def search(engines: dict, kind: str, request: dict) -> tuple[int, dict]:
    """kind: document or sql; request: query, limit, source_filter, and min_time for sql."""
    engine = by_kind(engines, kind)
    if engine is None:
        return 503, {"detail": f"no {kind} engine is ready"}
    if (wrong := _invalid(request, kind)) is not None:
        return 422, {"detail": wrong}
    try:
        found = engine.search(request["query"], request.get("limit", 5), source=request.get("source_filter"), min_time=request.get("min_time") if kind == "sql" else None)
    except Exception as e:  # noqa: BLE001
        log.exception("search failed")
        return 500, {"detail": str(e)}
    nested = [{"chunk": {k: v for k, v in r.items() if k not in ("score", "distance", "is_fts_match", "relevance", "fused", "workflow")}} | {k: r[k] for k in ("score", "distance", "is_fts_match")} for r in found]
    return 200, {"query": request["query"], "results": nested, "total_results": len(nested)}


def tool_search(engines: dict, kind: str, query: str, limit: int = 5, source_filter: str | None = None, min_time: float | None = None) -> str:
    engine = by_kind(engines, kind)
    if engine is None:
        return f"Error: no {kind} engine is initialized."
    try:
        return tool_text(query, engine.search(query, limit, source=source_filter, min_time=min_time if kind == "sql" else None))
    except Exception as e:  # noqa: BLE001
        return f"Search execution failed: {e}"


def handler(engines: dict) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            self._answer(*(health(engines) if self.path == "/health" else (404, {"detail": "not found"})))

        def do_POST(self) -> None:  # noqa: N802
            kind = {"/search/md": "document", "/search/sql": "sql", "/mcp": "mcp"}.get(self.path)
            if kind is None:
                return self._answer(404, {"detail": "not found"})
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            except ValueError:
                return self._answer(422, {"detail": "the body is no JSON"})
            if kind == "mcp":
                from brindle.edge import mcp

                found = mcp.answer(engines, request)
                return self._answer(202 if found is None else 200, found or {})
            self._answer(*search(engines, kind, request))

        def log_message(self, text: str, *args) -> None:
            log.info(text, *args)

    return Handler


def serve(engines: dict, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(engines))
