"""Command line: ``python -m lodestone scan|generate|read PROJECT``."""

from __future__ import annotations

import argparse
import json

from lodestone.plans import scan as plans
from lodestone.session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "generate", "read"):
        p = sub.add_parser(name)
        p.add_argument("project", nargs="?", default=".")
        p.add_argument("--base", help="folder of the snapshots")
        if name == "scan":
            p.add_argument("--incremental", action="store_true")
        elif name == "generate":
            p.add_argument("--client")
        else:
            p.add_argument("--chunk", type=int, default=0)
    args = parser.parse_args(argv)
    if args.command == "read":
        out = plans.read_payload_chunk(args.project, args.chunk, args.base)
    elif args.command == "scan":
        out = plans.scan(session(), args.project, force_full=not args.incremental, base=args.base)
    else:
        out = plans.generate(session(), args.project, args.client, args.base)
    print(json.dumps(out))
    return int("error" in out)
