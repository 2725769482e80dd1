"""python -m tessaly: lists what is registered, shows a query's plan, or runs one and writes its rows."""

from __future__ import annotations

import argparse


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessaly")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("factors", "labels", "queries", "transforms"):
        listed = commands.add_parser(name)
        listed.add_argument("--tag", action="append", default=[])
    for name in ("plan", "run"):
        asked = commands.add_parser(name)
        asked.add_argument("query")
        asked.add_argument("--tables", required=True, help="folder of the tables")
        if name == "run":
            asked.add_argument("--out", help="folder for the rows; without it they are counted")
    given = parser.parse_args(arguments)
    from tessaly.functions import transforms
    from tessaly.plans import catalogue, registry

    if given.command in ("factors", "labels"):
        for s in registry.select(tags=given.tag, among=registry.FACTORS if given.command == "factors" else registry.LABELS):
            print(s.id, ",".join(s.tags), f"lookback={s.lookback}", ">".join(s.steps))
        return 0
    if given.command in ("queries", "transforms"):
        print("\n".join(sorted(catalogue.QUERIES) if given.command == "queries" else transforms.names()))
        return 0
    if given.query not in catalogue.QUERIES:
        print(f"unknown query {given.query}")
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessaly").getOrCreate()
    rows = catalogue.QUERIES[given.query](spark, given.tables)
    if given.command == "plan":
        rows.explain("formatted")
    elif given.out:
        rows.write.mode("overwrite").parquet(given.out)
    else:
        print(rows.count())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
