"""Command line: add, query, timeline, graph, conflicts, deprecate and list over a store's folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .memory import FactStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--db", required=True, help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add")
    add.add_argument("content")
    add.add_argument("--entity", action="append", default=[])
    add.add_argument("--source", default="")
    add.add_argument("--no-resolve", action="store_true", help="replace nothing")
    add.add_argument("--show-id", action="store_true", help="print the id by itself too")
    add.add_argument("--effective-at")
    query = sub.add_parser("query")
    query.add_argument("question")
    query.add_argument("-k", type=int, default=5)
    query.add_argument("--at")
    timeline = sub.add_parser("timeline")
    timeline.add_argument("--entity")
    near = sub.add_parser("graph")
    near.add_argument("--entity", required=True)
    near.add_argument("--depth", type=int, default=1)
    conflicts = sub.add_parser("conflicts")
    conflicts.add_argument("content")
    conflicts.add_argument("--entity", action="append", default=[])
    gone = sub.add_parser("deprecate")
    gone.add_argument("id")
    gone.add_argument("--replaced-by")
    sub.add_parser("list", help="facts that are active now").add_argument("--all", action="store_true", help="future and deprecated ones too")
    return p


def shown(n: int, row) -> str:
    flag = "  [DEPRECATED]" if row["deprecated"] else ""
    return f"{n}. {row['content']}{flag}\n   id={row['id'][:8]}  effective={str(row['effective_at'])[:10]}  created={str(row['created_at'])[:10]}"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    with FactStore(spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), args.db) as store:
        if args.command == "add":
            made = store.remember(args.content, args.entity, source=args.source, effective_at=args.effective_at, auto_resolve=not args.no_resolve)
            print(f"stored {made}")
            if args.show_id:
                print(made)
        elif args.command == "query":
            found = store.query(args.question, args.k, at=args.at)
            for n, r in enumerate(found, 1):
                print(f"{shown(n, r)}\n   score={r['score']:.4f}")
            if not found:
                print("nothing found")
        elif args.command == "timeline":
            for n, r in enumerate(store.timeline(args.entity).toLocalIterator(), 1):
                print(shown(n, r))
        elif args.command == "graph":
            if store.entity_id(args.entity) is None:
                print(f"unknown entity: {args.entity}")
                return 1
            print(f"neighbours of {args.entity}: " + (", ".join(r["name"] for r in store.neighbors(args.entity, args.depth).collect()) or "none"))
        elif args.command == "conflicts":
            found = store.conflicts_for(args.content, args.entity).collect()
            for r in found:
                print(f"- {r['content']} (score={r['score']:.3f})")
            if not found:
                print("no conflicts")
        elif args.command == "deprecate":
            print("deprecated" if store.deprecate(args.id, args.replaced_by) else "not found")
        else:
            for n, r in enumerate((store.list(True) if args.all else store.active()).toLocalIterator(), 1):
                print(shown(n, r))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
