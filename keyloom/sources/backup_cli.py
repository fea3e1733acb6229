"""python -m keyloom.sources.backup_cli list | delete | restore"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .backup import Backups, groups
from .fs import Files


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="backups")
    p.add_argument("--folder", required=True)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    d = sub.add_parser("delete")
    d.add_argument("names", nargs="*")
    d.add_argument("--older-than", help="an ISO date or time")
    r = sub.add_parser("restore")
    r.add_argument("--to", required=True)
    r.add_argument("--before", help="an ISO date or time")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    b = Backups(Files(spark), a.folder)
    if a.what == "list":
        for row in groups(spark, b.list()).orderBy("at", "name").collect():
            print(row.chain, row.name, sep="\t")
        for n in b.incomplete():
            print("-", n, "(incomplete)", sep="\t")
    elif a.what == "delete":
        print(*b.delete(a.names or None, a.older_than), sep="\n")
    else:
        print(b.restore(a.to, a.before).name)
    return 0


if __name__ == "__main__":
    sys.exit(main())
