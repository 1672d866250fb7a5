"""Command line: ingest a film, evaluate a gold set, check the environment."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from shotloom import config, doctor, session


def main(argv: list[str] | None = None, engine_of=None) -> int:
    """``engine_of(config)`` builds the engine with its models; needed for ingest, and for search with a real encoder."""
    parser = argparse.ArgumentParser(prog="shotloom")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("ingest").add_argument("film")
    commands.add_parser("eval").add_argument("--queries", default="gold_queries.yaml")
    commands.add_parser("doctor")
    args = parser.parse_args(argv)
    if args.command == "doctor":
        return doctor.main()
    settings = config.load(args.config)
    if args.command == "eval" and not Path(args.queries).exists():
        print(f"no queries at {args.queries}", file=sys.stderr)
        return 1
    if engine_of is None:
        from shotloom.api import Engine

        engine_of = lambda c: Engine(session.build(), c)
    engine = engine_of(settings)
    if args.command == "ingest":
        for film in engine.run([args.film]).select("film_id", "title", "duration").collect():
            print(f"{film['film_id']}  {film['title']}  {film['duration']:.1f} s")
        print(f"{engine.store.units.count()} units in the index")
        return 0
    from shotloom.sources.gold import read_gold

    row = engine.evaluate(read_gold(engine.spark, args.queries)).first()
    show = lambda x: "not available" if x is None else f"{x:.3f}"
    print(f"evaluated {row['evaluated']}, skipped {row['skipped']}, hit@5 {show(row['hit@5'])}, hit@10 {show(row['hit@10'])}, mrr {show(row['mrr'])}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
