"""``python -m engramite.cli``: scan or watch a directory, or answer tool calls as lines of JSON."""

from __future__ import annotations

import argparse
import json
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from engramite.api import Engine
from engramite.schema import NODES, ConsolidationConfig
from engramite.sources.filesystem import scan_directory
from engramite.streaming.watch import Watch

TOOLS = ("store_node", "query_graph", "retrieve_context", "learn_from_outcome", "manage_goal", "review_goal", "run_consolidation", "health", "goals_snapshot")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="engramite", description=__doc__)
    top.add_argument("--db", default="engramite-db", help="folder of the tables")
    top.add_argument("--learning-rate", type=float, default=0.2)
    top.add_argument("--decay-rate", type=float, default=0.02)
    top.add_argument("--prune-threshold", type=float, default=0.1)
    actions = top.add_subparsers(dest="action")
    for name in ("scan", "watch"):
        one = actions.add_parser(name)
        one.add_argument("root")
        one.add_argument("--extensions", type=lambda s: s.split(","))
        one.add_argument("--include-hidden", action="store_true")
        one.add_argument("--follow-symlinks", action="store_true")
        one.add_argument("--no-gitignore", action="store_true")
        if name == "watch":
            one.add_argument("--poll-ms", type=int, default=1000)
            one.add_argument("--cycles", type=int)
            one.add_argument("--ingest-on-start", action="store_true")
    actions.add_parser("serve")
    return top


def answer(engine: Engine, line: str) -> str:
    """One tool call {"tool": name, "arguments": {...}} as one line of JSON."""
    try:
        call = json.loads(line)
        if call["tool"] not in TOOLS:
            raise ValueError(f"unknown tool {call['tool']}")
        out = getattr(engine, call["tool"])(**call.get("arguments", {}))
        if isinstance(out, DataFrame):
            out = [r.asDict(recursive=True) for r in out.collect()]
        if isinstance(out, dict):
            out = {k: v for k, v in out.items() if k != "embedding"}
        return json.dumps({"ok": True, "result": out}, default=str)
    except Exception as error:  # a bad call mustn't end the service
        return json.dumps({"ok": False, "error": f"{type(error).__name__}: {error}"})


def serve(engine: Engine, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if line.strip():
            print(answer(engine, line), file=out, flush=True)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    for name in ("learning_rate", "decay_rate", "prune_threshold"):
        if not 0 <= getattr(args, name) <= 1:
            print(f"{name} must be within 0 and 1", file=sys.stderr)
            return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, args.db, learning_rate=args.learning_rate, consolidation=ConsolidationConfig(args.decay_rate, args.prune_threshold))

    def ingest(nodes: DataFrame) -> None:
        engine.db.nodes.append(nodes.select([c for c in nodes.columns if c in NODES.names]))

    if args.action in ("scan", "watch"):
        options = {"extensions": args.extensions, "include_hidden": args.include_hidden, "follow_symlinks": args.follow_symlinks, "respect_gitignore": not args.no_gitignore}
        if args.action == "scan":
            nodes, summary = scan_directory(spark, args.root, **options)
            ingest(nodes)
            print(json.dumps(summary))
            return 0
        from engramite.sources.filesystem import event_nodes

        watch = Watch(spark, args.root, lambda events: ingest(event_nodes(events)), args.poll_ms, args.ingest_on_start, **options)
        done = 0
        while args.cycles is None or done < args.cycles:
            watch._stop.wait(args.poll_ms / 1000)
            print(json.dumps(watch.cycle()), flush=True)
            done += 1
        return 0
    serve(engine, sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
