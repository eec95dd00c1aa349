"""``python -m quern --store PATH command``: the store's operations from a shell."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quern.store import Store, spec_of


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    parser.add_argument("--store", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("query").add_argument("sql")
    commands.add_parser("types")
    commands.add_parser("define").add_argument("spec", help="a type as JSON")
    c = commands.add_parser("explore")
    c.add_argument("type")
    c.add_argument("--where")
    c.add_argument("--group-by", default="")
    c = commands.add_parser("page")
    c.add_argument("type")
    c.add_argument("--size", type=int, default=20)
    c.add_argument("--cursor")
    c = commands.add_parser("search")
    c.add_argument("text")
    c.add_argument("--type")
    c = commands.add_parser("invalidate")
    for name in ("entry", "label", "reason", "at"):
        c.add_argument(name)
    c.add_argument("--superseded-by")
    a = parser.parse_args(argv)
    store = Store(SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate(), a.store)
    match a.command:
        case "query":
            rows = store.query(a.sql)
        case "types":
            rows = store.spark.createDataFrame([(n, v[-1].version, v[-1].major) for n, v in store.registry.versions.items()], "name string, version int, major int")
        case "define":
            made, what = store.define(spec_of(json.loads(a.spec)))
            return print(json.dumps({"name": made.name, "version": made.version, "outcome": what}))
        case "explore":
            rows = store.explore(a.type, a.where, [x for x in a.group_by.split(",") if x])
        case "page":
            found, cursor = store.page(a.type, a.size, a.cursor)
            return print(json.dumps({"rows": [r.asDict() for r in found], "next_cursor": cursor}, default=str))
        case "search":
            rows = store.search(a.text, a.type)
        case "invalidate":
            return store.invalidate(a.entry, a.label, a.reason, a.at, a.superseded_by)
    for line in rows.toJSON().toLocalIterator():
        print(line)
    return None


if __name__ == "__main__":
    main()
