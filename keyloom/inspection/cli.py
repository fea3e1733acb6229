"""python -m keyloom.inspection.cli --url URL tables | indexes | entry-fields | query"""

from __future__ import annotations

import argparse
import json
import sys

from .server import Client


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inspect")
    p.add_argument("--url", required=True)
    p.add_argument("--header", action="append", default=[], help="Name: value")
    p.add_argument("--timeout", type=float, default=15)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("tables")
    for name in ("indexes", "entry-fields", "query"):
        s = sub.add_parser(name)
        s.add_argument("--table", required=True)
        if name == "query":
            s.add_argument("--index", default="primary")
            s.add_argument("--limit", type=int, default=30)
            for x in ("selector", "filter", "after"):
                s.add_argument(f"--{x}", type=json.loads, help="a JSON object")
    a = p.parse_args(args)
    client = Client(a.url, dict((x.strip() for x in h.split(":", 1)) for h in a.header), a.timeout)
    if a.what == "tables":
        out = client.tables()
    elif a.what == "indexes":
        out = client.indexes(a.table)
    elif a.what == "entry-fields":
        out = client.entry_fields(a.table)
    else:
        out = client.query(a.table, a.index, a.selector, a.filter, a.limit, a.after)
    json.dump(out, sys.stdout, indent=2)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
