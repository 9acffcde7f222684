"""Results as text."""

from __future__ import annotations


def _distance(r: dict, missing: str) -> str:
    return missing if r.get("distance") is None else f"{r['distance']:.4f}"


def lines(results: list[dict]) -> list[str]:
    """For a terminal: two lines for each result."""
    if not results:
        return ["No results found"]
    out = ["Top Results:"]
    for r in results:
        d = _distance(r, "N/A (FTS Match)")
        if "raw_query" in r:
            out.append(f"[Score/Dist: {d} | DB: {r['source']} | Calls: {r['calls']} | Time: {r['execution_time_ms']}ms]")
        else:
            out.append(f"[Score/Dist: {d} | Source: {r['source']} | Hash: {r['content_hash']}]")
        snippet = (r["raw_query"] if "raw_query" in r else r["text"]) or ""
        out.append('  --> "{}..."'.format(snippet[:100].replace("\n", " ")))
    return out


def tool_text(query: str, results: list[dict]) -> str:
    """For a language model's tool."""
    if not results:
        return f"No results found for query: '{query}'"
    out = [f"Found {len(results)} results for '{query}':\n"]
    for r in results:
        d = _distance(r, "N/A (FTS)")
        if "raw_query" in r:
            body = f"Source Database: {r['source']}\nExecution Time: {r['execution_time_ms']}ms (Calls: {r['calls']})\nSQL Query:\n{r['raw_query']}\n"
        else:
            body = f"Source: {r['source']}\nContent:\n{r['text']}\n"
        out.append(f"--- Result (Score: {d}) ---\n{body}")
    return "\n".join(out)
