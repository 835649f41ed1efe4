"""Command line: list and run the registered queries, or run steps in order.

``python -m quillstone.cli list``; ``python -m quillstone.cli run NAME --data DIR --out DIR [--format csv]``;
``python -m quillstone.cli steps a.py b.py``.
"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
from collections.abc import Callable, Sequence
from pathlib import Path


def load_settings(path: str, allowed: Sequence[str], environ: dict[str, str] | None = None) -> dict[str, str]:
    """Allow-listed ``KEY=VALUE`` lines of a local file; what the environment has stays.  Returns what was set."""
    env = os.environ if environ is None else environ
    done = {}
    if not Path(path).exists():
        return done
    for n, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        line = line.strip().removeprefix("export ").strip()
        if not line or line.startswith("#"):
            continue
        key, found, value = line.partition("=")
        if not found:
            raise ValueError(f"{path}, line {n}: not KEY=VALUE")
        value = value.strip()
        if len(value) > 1 and (value[0], value[-1]) in {('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’")}:
            value = value[1:-1]
        if key.strip() in allowed and key.strip() not in env:
            env[key.strip()] = done[key.strip()] = value
    return done


def run_steps(scripts: Sequence[str], run: Callable[[list[str]], int] | None = None) -> list[str]:
    """Run scripts in order: all must exist before the first starts, and the first failure ends the run."""
    missing = [s for s in scripts if not Path(s).exists()]
    if missing:
        raise FileNotFoundError(f"no such scripts: {', '.join(missing)}")
    call = run or (lambda args: subprocess.run(args, check=False).returncode)
    for script in scripts:
        if code := call([sys.executable, script]):
            raise RuntimeError(f"{script} ended with code {code}")
    return list(scripts)


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillstone", description="Publication analytics on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the registered queries")
    one = commands.add_parser("run", help="run a query and write its rows")
    one.add_argument("name")
    one.add_argument("--data", required=True, help="folder of the input tables")
    one.add_argument("--out", required=True, help="folder for the result")
    one.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    steps = commands.add_parser("steps", help="run scripts in order")
    steps.add_argument("scripts", nargs="+")
    args = parser.parse_args(argv)
    if args.command == "steps":
        run_steps(args.scripts)
        return 0
    from .plans import registry

    found = registry.queries()
    if args.command == "list":
        print("\n".join(sorted(found)))
        return 0
    if args.name not in found:
        parser.error(f"no query {args.name!r}")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quillstone").getOrCreate()
    writer = found[args.name](spark, args.data).write.mode("overwrite")
    (writer.option("header", True) if args.format == "csv" else writer).format(args.format).save(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
