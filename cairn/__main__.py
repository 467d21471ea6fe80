"""Command line: python -m cairn build|search|stats PATH ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans.snapshot import Snapshot, sizes


def main(given: list[str] | None = None) -> None:
    """Build a snapshot with its index from a Parquet table, search it for the rows of another, or show its parts."""
    parser = argparse.ArgumentParser(prog="cairn")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build")
    build.add_argument("table")
    build.add_argument("path")
    build.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="parameters of the snapshot")
    search = commands.add_parser("search")
    search.add_argument("path")
    search.add_argument("queries")
    search.add_argument("out")
    search.add_argument("-k", type=int, default=10)
    search.add_argument("--exact", action="store_true")
    commands.add_parser("stats").add_argument("path")
    args = parser.parse_args(given)
    spark = SparkSession.builder.appName("cairn").getOrCreate()
    if args.command == "build":
        pairs = [x.partition("=")[::2] for x in args.set]
        parameters = {n: json.loads(v) if v[:1].isdigit() else v for n, v in pairs}
        Snapshot.create(spark.read.parquet(args.table), args.path, **parameters).build()
    elif args.command == "search":
        found = Snapshot.open(spark, args.path).search(spark.read.parquet(args.queries), args.k, args.exact)
        found.write.mode("errorifexists").parquet(args.out)
    else:
        s = Snapshot.open(spark, args.path)
        parts = {r["part"]: {"files": r["n_files"], "bytes": r["bytes"]} for r in sizes(spark, args.path).collect()}
        print(json.dumps({"parameters": s.parameters, "live": s.rows().count(), "parts": parts}))


if __name__ == "__main__":
    main()
