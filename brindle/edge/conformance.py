"""Checks of a record server against the contract of sources/http_api: (name, passed, note) each."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from datetime import datetime


def _call(base: str, path: str, key: str | None, body: dict | None = None, timeout: float = 10, seen: dict | None = None) -> tuple[int, object]:
    """Status and JSON body of an answer; seen gets its headers, in lower case."""
    headers = ({"Authorization": f"Bearer {key}"} if key else {}) | ({"Content-Type": "application/json"} if body is not None else {})
    request = urllib.request.Request(base.rstrip("/") + path, headers=headers, data=None if body is None else json.dumps(body).encode())
    try:
        with urllib.request.urlopen(request, timeout=timeout) as a:  # noqa: S310
            if seen is not None:
                seen |= {k.lower(): v for k, v in a.headers.items()}
            return a.status, json.loads(a.read() or b"null")
    except urllib.error.HTTPError as e:
        try:
            return e.code, json.loads(e.read() or b"null")
        except ValueError:
            return e.code, None


def _is_time(value: object) -> bool:
    try:
        return bool(datetime.fromisoformat(value))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return False


_number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
_whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
_words = lambda x: isinstance(x, str) and bool(x.strip())
#: What each field of a record, and of a table that a statement returns, must be.
_RECORD = {"id": _words, "text": _words, "source": _words, "execution_time_ms": _number, "calls": _whole, "tables": lambda x: isinstance(x, list), "latest_ts": _is_time}
_TABLE = {"row_count": _whole, "truncated": lambda x: isinstance(x, bool), "execution_time_ms": _number}
#: Statements that a server must refuse.
_CHANGES = ("INSERT INTO slow_logs VALUES (1)", "UPDATE slow_logs SET id = 1", "DELETE FROM slow_logs", "DROP TABLE slow_logs")


def run(base: str, key: str, timeout: float = 10) -> list[tuple[str, bool, str]]:
    out: list[tuple[str, bool, str]] = []
    say = lambda name, ok, note="": out.append((name, bool(ok), str(note)[:200]))
    get = lambda **q: _call(base, "/sql/queries?" + urllib.parse.urlencode(q), key, timeout=timeout)
    status, health = _call(base, "/health", None, timeout=timeout)
    health = health if isinstance(health, dict) else {}
    say("health answers without a key", status == 200, status)
    say("health is ok", health.get("status") == "ok", health.get("status"))
    say("health has a version", _words(health.get("version")))
    say("health lists databases", isinstance(health.get("databases"), list))
    status, listed = _call(base, "/sql/databases", key, timeout=timeout)
    listed = listed.get("databases") if isinstance(listed, dict) else None
    say("databases answer", status == 200, status)
    say("databases are a list", isinstance(listed, list))
    say("databases are those of health", set(map(str, listed or [])) == set(map(str, health.get("databases") or [])))
    headers: dict[str, str] = {}
    status, page = _call(base, "/sql/queries?limit=2", key, timeout=timeout, seen=headers)
    say("queries are JSON", "application/json" in headers.get("content-type", ""))
    say("queries have a request id", "x-request-id" in headers)
    say("queries answer", status == 200, status)
    page = page if isinstance(page, dict) else {}
    rows = page.get("data") or []
    say("page shape", isinstance(page.get("data"), list) and isinstance(page.get("has_more"), bool))
    say("total is a number", _number(page.get("total_count")))
    for field, fits in _RECORD.items():
        say(f"{field} fits", all(fits(r.get(field)) for r in rows))
    say("limit holds", len(rows) <= 2, len(rows))
    say("required fields", all(r.get("id") and r.get("text") and r.get("source") for r in rows))
    say("tables are lists", all(isinstance(r.get("tables", []), list) for r in rows))
    say("times fall", [r.get("execution_time_ms") or 0 for r in rows] == sorted((r.get("execution_time_ms") or 0 for r in rows), reverse=True))
    if page.get("has_more"):
        say("cursor is given", page.get("next_cursor"))
        status, after = get(limit=2, cursor=page.get("next_cursor") or "")
        more = after.get("data") or [] if isinstance(after, dict) else []
        say("next page answers", status == 200, status)
        say("pages do not overlap", not {r.get("id") for r in rows} & {r.get("id") for r in more})
    if rows:
        low = rows[0].get("execution_time_ms") or 0
        _, some = get(limit=50, min_execution_ms=low)
        say("min_execution_ms holds", all((r.get("execution_time_ms") or 0) >= low for r in (some or {}).get("data", [])))
        _, own = get(limit=50, database=rows[0].get("source"))
        say("database holds", all(r.get("source") == rows[0].get("source") for r in (own or {}).get("data", [])))
    status, none = get(limit=5, since="2999-01-01T00:00:00Z")
    say("since holds", status == 200 and not (none or {}).get("data"))
    say("a wrong limit is refused", get(limit=0)[0] in (400, 422))
    say("no key is refused", _call(base, "/sql/queries?limit=1", None, timeout=timeout)[0] in (401, 403))
    say("a wrong key is refused", _call(base, "/sql/queries?limit=1", key + "x", timeout=timeout)[0] in (401, 403))
    status, table = _call(base, "/sql/execute", key, {"query": "SELECT 1 AS one", "timeout_ms": 5000}, timeout)
    table = table if isinstance(table, dict) else {}
    say("execute answers", status == 200, status)
    say("table shape", isinstance(table.get("columns"), list) and isinstance(table.get("rows"), list) and all(len(r) == len(table["columns"]) for r in table["rows"]))
    for field, fits in _TABLE.items():
        say(f"table has {field}", fits(table.get(field)))
    say("row count holds", table.get("row_count") == len(table.get("rows") or []))
    for sql in _CHANGES:
        status, told = _call(base, "/sql/execute", key, {"query": sql, "timeout_ms": 5000}, timeout)
        verb = sql.split()[0].lower()
        say(f"{verb} is refused", status == 422, status)
        say(f"{verb} is called unsafe", isinstance(told, dict) and told.get("error") == "unsafe_query")
    say("two statements are refused", _call(base, "/sql/execute", key, {"query": "SELECT 1; DROP TABLE slow_logs", "timeout_ms": 5000}, timeout)[0] in (400, 422))
    _, told = _call(base, "/sql/queries?limit=1", None, timeout=timeout)
    told = told if isinstance(told, dict) else {}
    say("a missing key is called invalid_token", told.get("error") == "invalid_token", told.get("error"))
    say("an error has a message", "message" in told)
    return out
