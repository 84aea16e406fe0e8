"""python -m foliant COMMAND STORE …

ingest FOLDER [--only PREFIX] [--limit N] [--force] [--reset]   reads a folder into the archive
ask QUESTION, search WORDS [--mode hybrid|keyword|vector]        answers, passages
conflicts, stats, modes                                          what the archive holds
evaluate FILE, sweep FILE, diagnose FILE                         golden questions, retrieval probes, misses
remove PREFIX, vacuum [--keep N]                                 documents out, old versions out
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from foliant.operators import facts
from foliant.plans.service import Service
from foliant.sources.archive import Archive, Settings

COMMANDS = ("ingest", "ask", "search", "conflicts", "stats", "modes", "evaluate", "sweep", "diagnose", "remove", "vacuum")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="foliant", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("store")
    parser.add_argument("what", nargs="*")
    parser.add_argument("--only")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--reset", action="store_true")
    parser.add_argument("--mode", choices=("hybrid", "keyword", "vector"), default="hybrid")
    parser.add_argument("--keep", type=int, default=2)
    args = parser.parse_args(arguments)
    spark, said = SparkSession.builder.appName("foliant").getOrCreate(), " ".join(args.what)
    archive, settings = Archive(spark, args.store), Settings.from_environment()
    service = Service(archive, settings=settings)
    if args.command == "ingest":
        if args.reset:
            archive.reset()
        archive.ingest(args.what[0], settings, args.only, args.limit, args.force).show()
    elif args.command == "ask":
        print(json.dumps(service.question(said), indent=2, default=str))
    elif args.command == "search":
        for hit in service.search(said, mode=args.mode):
            print(f"{hit['rank']:2} {hit['score']:.3f} [{hit['channels']}] {hit['chunk_id']}: {' '.join(hit['content'].split())[:100]}")
    elif args.command == "conflicts":
        facts.conflict_positions(archive.table("facts")).show(truncate=False)
    elif args.command == "evaluate":
        service.evaluate(args.what[0]).orderBy("level", "category", "status").show(100, truncate=False)
    elif args.command in ("sweep", "diagnose"):
        getattr(service, args.command)(args.what[0]).show(truncate=False)
    elif args.command == "modes":
        print(json.dumps(service.modes()))
    elif args.command == "remove":
        archive.remove(said)
    elif args.command == "vacuum":
        print(archive.vacuum(args.keep))
    else:
        archive.statistics().show()


if __name__ == "__main__":
    main()
