"""Commands over a warehouse folder. Exit code 0: done, 1: issues, 2: wrong use."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scriptorium.engine import VERSION, Engine
from scriptorium.operators import ingest
from scriptorium.operators.retrieval import parse_filters
from scriptorium.operators.writing import DELIVERIES
from scriptorium.sources.warehouse import read_extraction, read_ignore

#: Commands and the argument each cannot do without.
COMMANDS = {
    "version": "", "init": "", "ingest": "inbox", "ingest-verify": "", "prepare": "", "compile-write": "deliveries", "compile-reduce": "", "compile-verify": "",
    "graph": "extraction", "graph-verify": "", "query": "question", "status": "",
}


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    p = argparse.ArgumentParser(prog="scriptorium")
    p.add_argument("command", choices=tuple(COMMANDS))
    p.add_argument("--kb", help="the warehouse folder")
    p.add_argument("--inbox", help="the folder to ingest")
    p.add_argument("--no-auto-update", action="store_true", help="files of known names replace nothing")
    p.add_argument("--deliveries", help="JSON lines of what agents deliver")
    p.add_argument("--extraction", help="JSON files with nodes, edges and hyperedges")
    p.add_argument("--question", default="")
    known, rest = p.parse_known_args(args)
    if known.command == "version":
        print(VERSION)
        return 0
    need = COMMANDS[known.command]
    if not known.kb or (need and not getattr(known, need)):
        print(f"{known.command} needs --kb" + (f" and --{need}" if need else ""), file=sys.stderr)
        return 2
    engine = Engine(SparkSession.builder.getOrCreate(), known.kb)
    return _run(engine, known, rest)


def _told(issues) -> int:
    """Shows what is wrong; 1 if anything is."""
    some = issues.orderBy(*issues.columns).limit(100).collect()
    for r in some:
        print("FAILED: " + ": ".join(str(x) for x in r), file=sys.stderr)
    return int(bool(some))


def _run(engine: Engine, known: argparse.Namespace, rest: list[str]) -> int:
    if known.command == "init":
        print(*engine.init())
    elif known.command == "ingest":
        found = engine.ingest(known.inbox, read_ignore(known.inbox), not known.no_auto_update)
        for r in ingest.report_lines(found).orderBy("ord", "sub").toLocalIterator():
            print(r["line"])
        return int(not found.where("status = 'failed'").isEmpty())
    elif known.command == "prepare":
        engine.prepare().show()
    elif known.command == "compile-write":
        return _told(engine.write(engine.spark.read.schema(DELIVERIES).json(known.deliveries)))
    elif known.command == "compile-reduce":
        print(engine.reduce().count())
    elif known.command in ("compile-verify", "ingest-verify", "graph-verify"):
        return _told({"compile-verify": engine.verify_compile, "ingest-verify": engine.verify_ingest, "graph-verify": engine.verify_graph}[known.command]())
    elif known.command == "graph":
        parts = read_extraction(engine.spark, known.extraction)
        made = engine.build_graph(parts["nodes"], parts["edges"], hyper=parts["hyperedges"].select("id", "members"))
        made["report"].orderBy("ord", "sub").select("line").show(100, False)
        return _told(made["verify"])
    elif known.command == "query":
        engine.query(known.question, parse_filters(rest))["text"].orderBy("ord").select(F.col("line")).show(200, False)
    else:
        engine.status().show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
