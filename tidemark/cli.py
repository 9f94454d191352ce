"""Command line: ``python -m tidemark.cli [options] [query]``.

Modes: ``adhoc`` runs one query, or takes queries up to ``;`` from a prompt or standard input; ``server`` answers queries over the
network; ``client`` sends them to a server; ``repair`` rebuilds a database's manifest. Options come from a JSON file
(``--config``), else from arguments, else from environment variables named ``TIDEMARK_<OPTION>``.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import SparkSession

from tidemark.engine import Engine

OPTIONS = {"mode": "adhoc", "databases": "", "default_database": "", "host": "127.0.0.1", "port": "51033", "master": "local[*]"}


def settings(argv: list[str], environ: dict[str, str]) -> dict[str, str]:
    """The settings that hold: a configuration file overrides arguments, and these the environment."""
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("query", nargs="?")
    parser.add_argument("--config")
    for name in OPTIONS:
        parser.add_argument(f"--{name.replace('_', '-')}", dest=name)
    given = vars(parser.parse_args(argv))
    out = OPTIONS | {k: environ[f"TIDEMARK_{k.upper()}"] for k in OPTIONS if f"TIDEMARK_{k.upper()}" in environ}
    out |= {k: v for k, v in given.items() if v is not None}
    if given["config"]:
        with open(given["config"]) as f:
            out |= {k: str(v) for k, v in json.load(f).items()}
    return out


def statements(lines: TextIO) -> Iterator[str]:
    """Queries that end with a semicolon, over any number of lines; a rest without one is a query too."""
    held = ""
    for line in lines:
        held += line
        while ";" in held.split("//")[-1] and held.rstrip().endswith(";"):
            yield held.strip()
            held = ""
    if held.strip():
        yield held.strip()


def prompted(name: str = "tidemark") -> Iterator[str]:
    """Queries typed at a prompt, over any number of lines up to a semicolon, with a history of earlier ones."""
    try:
        import readline

        history = os.path.expanduser("~/.tidemark_history")
        if os.path.exists(history):
            readline.read_history_file(history)
    except ImportError:
        readline = None
    held = ""
    while True:
        try:
            held += input(f"{'.' * len(name) if held else name}> ") + "\n"
        except KeyboardInterrupt:
            held = ""
            print()
            continue
        except EOFError:
            break
        if held.rstrip().endswith(";"):
            yield held.strip()
            held = ""
    if readline:
        readline.write_history_file(history)


def main(argv: list[str] | None = None) -> int:
    opts = settings(sys.argv[1:] if argv is None else argv, dict(os.environ))
    spark = SparkSession.builder.master(opts["master"]).appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    databases = [d for d in opts["databases"].split(",") if d]
    engine = Engine(spark, databases, default_database=opts["default_database"] or None)
    if opts["mode"] == "repair":
        print(f"{engine.repair().count()} blocks were dropped or corrected")
        return 0
    if opts["mode"] == "server":
        from tidemark.serving import QueryServer

        QueryServer(engine, opts["host"], int(opts["port"])).serve()
        return 0
    if opts["mode"] == "client":
        from tidemark.serving import QueryClient

        client = QueryClient(opts["host"], int(opts["port"]))
        run = lambda text: client.run(text, spark)
    else:
        run = engine.run
    failed = 0
    typed = prompted() if sys.stdin.isatty() else statements(sys.stdin)
    for text in [opts["query"]] if opts.get("query") else typed:
        try:
            run(text)
        except Exception as e:  # noqa: BLE001 - a bad query ends neither the session nor the other queries
            print(str(e).splitlines()[0], file=sys.stderr)
            failed = 1
    return failed


if __name__ == "__main__":
    sys.exit(main())
