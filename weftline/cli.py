"""python -m weftline.cli COMMAND ...: scripts from the command line."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from weftline.plans.runs import Engine, diagram, node_statuses
from weftline.plans.script import Script, load
from weftline.sources.infer import csv_reader, parquet_reader, table_writer


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _script(args) -> Script:
    params = Path(args.params).read_text() if args.params else None
    return load(Path(args.script).read_text(), params)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str):
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(o if o.startswith("--") else o)
        return c

    command("validate_script", "script", "--params")
    command("get_table_ddl", "script", "table", "--params")
    command("get_diagram", "script", "--params", "--root", "--keyspace", "--run")
    command("start_run", "root", "keyspace", "script", "nodes", "--params")
    command("exec_node", "root", "keyspace", "script", "node", "run", "--params")
    command("stop_run", "root", "keyspace", "run")
    for name in ("get_run_history", "get_node_history", "get_batch_history"):
        command(name, "root", "keyspace")
    command("drop_keyspace", "root", "keyspace")
    command("list_keyspaces", "root")
    c = command("proto_file_reader_creator", "file", "table", "--separator")
    c.add_argument("--parquet", action="store_true")
    args = p.parse_args(argv)

    if args.command == "validate_script":
        print(f"{len(_script(args).nodes)} nodes, in this order: {', '.join(_script(args).order())}")
        return 0
    if args.command == "get_diagram" and not args.run:
        print(diagram(_script(args)))
        return 0
    spark = _session()
    if args.command == "proto_file_reader_creator":
        r = parquet_reader(spark, args.file) if args.parquet else csv_reader(spark, args.file, separator=args.separator or ",")
        print(json.dumps({"nodes": {f"read_{args.table}": {"type": "file_table", "r": r, "w": table_writer(r, args.table)}}}, indent=2))
        return 0
    engine = Engine(spark, getattr(args, "root", None) or "")
    if args.command == "get_table_ddl":
        print(engine.ddl(_script(args), args.table))
    elif args.command == "get_diagram":
        found = node_statuses(engine.history(args.keyspace, "wf_batch_history")).where(f"run_id = {int(args.run)}")
        print(diagram(_script(args), {r["script_node"]: r["status"] for r in found.collect()}))
    elif args.command == "start_run":
        print(engine.start_run(args.keyspace, _script(args), args.nodes.split(",")))
    elif args.command == "exec_node":
        print(engine.exec_node(args.keyspace, _script(args), args.node, int(args.run)))
    elif args.command == "stop_run":
        engine.stop_run(args.keyspace, int(args.run))
    elif args.command == "drop_keyspace":
        engine.drop_keyspace(args.keyspace)
    elif args.command == "list_keyspaces":
        print("\n".join(engine.keyspaces()))
    else:
        name = {"get_run_history": "wf_run_history", "get_node_history": "wf_node_history", "get_batch_history": "wf_batch_history"}[args.command]
        for r in engine.history(args.keyspace, name).orderBy("ts").toLocalIterator():
            print(json.dumps(r.asDict(), default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
