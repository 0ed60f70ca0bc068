"""Command line: ``python -m tessera query | run | list``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

import tessera
from tessera.plans import registry
from tessera.plans.engine import Config, Engine


def ask(spark: SparkSession, args: argparse.Namespace) -> None:
    """Print the answer to a question over a table of chunks, or all of its result as JSON."""
    engine = Engine(spark.read.parquet(args.chunks), Config(top_k=args.top_k))
    asked = spark.createDataFrame([(0, args.question, [])], "query_id long, text string, targets array<string>")
    said = [r["answer"] for r in engine.answer(asked).collect()]
    answer = said[0] if said else ""
    if not args.json:
        print(answer)
        return
    hits = engine.retrieve(asked).select("rank", "doc_id", "paper_id", "section", "score").orderBy("rank").collect()
    print(json.dumps({"query": args.question, "answer": answer, "documents": [h.asDict() for h in hits]}))


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """Run a registered query over a folder of tables, to a Parquet folder or the screen."""
    found = registry.QUERIES[args.name](spark, args.tables)
    if args.out:
        found.write.mode("errorifexists").parquet(args.out)
    else:
        found.show(args.rows, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--version", action="version", version=tessera.__version__)
    commands = top.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="answer one question")
    query.add_argument("question")
    query.add_argument("--chunks", required=True, help="Parquet of (doc_id, paper_id, section, text)")
    query.add_argument("--top-k", type=int, default=15)
    query.add_argument("--json", action="store_true")
    query.set_defaults(do=ask)
    one = commands.add_parser("run", help="run a registered query")
    one.add_argument("name", choices=sorted(registry.QUERIES), metavar="name")
    one.add_argument("--tables", required=True)
    one.add_argument("--out")
    one.add_argument("--rows", type=int, default=20)
    one.set_defaults(do=run)
    commands.add_parser("list", help="name the registered queries").set_defaults(do=None)
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.do is None:
        print("\n".join(sorted(registry.QUERIES)))
        return
    args.do(SparkSession.builder.appName("tessera").getOrCreate(), args)


if __name__ == "__main__":
    main()
