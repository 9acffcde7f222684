"""python -m brindle.edge.cli ingest|search|serve|tool|mcp"""

from __future__ import annotations

import argparse
import json
import sys

from brindle.edge import api, mcp, report
from brindle.plans.config import Settings, load

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="brindle")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("-c", "--config-file")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("path")
    a.add_argument("-t", "--type", default="md")
    a.add_argument("-r", "--rebuild", action="store_true")
    a.add_argument("-f", "--force", action="store_true")
    a.add_argument("-q", "--query")
    a = sub.add_parser("search")
    a.add_argument("query")
    a.add_argument("-t", "--type", default="md")
    a.add_argument("-s", "--source")
    a.add_argument("-l", "--limit", type=int, default=5)
    a.add_argument("--min-time", type=float)
    a = sub.add_parser("serve")
    a.add_argument("--host", default="127.0.0.1")
    a.add_argument("--port", type=int, default=8000)
    sub.add_parser("mcp", help="the search tools over the Model Context Protocol on standard input and output")
    sub.add_parser("tool", help="one JSON request a line on standard input, one text answer each")
    return p


def build(settings: Settings, name: str, spark=None):
    if name not in settings.engines:
        raise SystemExit(f"no engine {name!r}; there are {', '.join(settings.engines) or 'none'}")
    from brindle.plans.engine import RetrievalEngine
    from brindle.session import get_spark

    return RetrievalEngine(spark or get_spark(), settings.engines[name], settings)


def main(argv: list[str] | None = None, ask=input, out=print, spark=None) -> int:
    args = parser().parse_args(argv)
    settings = load(args.config_file)
    if args.command == "ingest":
        if args.rebuild and not args.force and ask(f"Delete what {args.type} holds? [y/N] ").strip().lower() not in ("y", "yes"):
            out("Nothing was changed.")
            return 1
        try:
            engine = build(settings, args.type, spark)
            out(f"{engine.ingest(args.path, rebuild=args.rebuild, query=args.query)} chunks added")
        except ValueError as e:
            out(f"Error: {e}")
            return 1
    elif args.command == "search":
        engine = build(settings, args.type, spark)
        for line in report.lines(engine.search(args.query, args.limit, source=args.source, min_time=args.min_time)):
            out(line)
    else:
        engines = {k: build(settings, k, spark) for k in settings.engines}
        if args.command == "serve":
            api.serve(engines, args.host, args.port).serve_forever()
        for line in mcp.talk(engines, sys.stdin) if args.command == "mcp" else ():
            print(line, flush=True)
        for line in sys.stdin if args.command == "tool" else ():
            r = json.loads(line)
            out(api.tool_search(engines, r.get("kind", "document"), r["query"], r.get("limit", 5), r.get("source_filter"), r.get("min_time")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
