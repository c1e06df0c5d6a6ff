"""Command line: batch runs over fact files, change streams, and plan reports.

    python -m lodestrata -p program.dl -f facts [-c out] [-d ,] [-O 0..3] [--no-sharing] [--stream]
    python -m lodestrata inspect program.dl [--json] [-O 0..3]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.ast import Program
from .plans.executor import Engine
from .plans.inspect import inspect_json, inspect_text
from .plans.parser import parse_program
from .sources.files import csv_cell, read_relation, write_csv_file, write_sizes
from .streaming.protocol import run_stream
from .streaming.session import Session


@dataclass(frozen=True)
class Args:
    program: str
    facts: str
    csvs: str | None = None
    delimiter: str = ","
    fat_mode: bool = False
    no_sharing: bool = False
    workers: int = 1
    level: int | None = None
    stream: bool = False

    def program_name(self) -> str:
        return Path(self.program).stem

    def fact_name(self) -> str:
        return Path(self.facts).name


def parse_args(argv: list[str]) -> Args:
    p = argparse.ArgumentParser(prog="lodestrata", description="Runs a program over a folder of fact files.")
    p.add_argument("-p", "--program", required=True, help="the program's path")
    p.add_argument("-f", "--facts", required=True, help="folder of fact files")
    p.add_argument("-c", "--csvs", help="folder for the results; without it they are printed")
    p.add_argument("-d", "--delimiter", default=",", help="between the cells of fact files")
    p.add_argument("--fat-mode", action="store_true", help="taken and ignored: rows of any width are alike")
    p.add_argument("--no-sharing", action="store_true", help="plan relations anew for every reader")
    p.add_argument("-w", "--workers", type=int, default=1, help="partitions that facts are dealt to by their first column")
    p.add_argument("-O", dest="level", type=int, choices=range(4), help="0 as it is, 1 reducers, 2 join order, 3 both")
    p.add_argument("--stream", action="store_true", help="then read changes from standard input")
    a = p.parse_args(argv)
    if a.workers < 1:
        p.error("-w must be positive")
    return Args(a.program, a.facts, a.csvs, a.delimiter, a.fat_mode, a.no_sharing, a.workers, a.level, a.stream)


def load_facts(spark: SparkSession, program: Program, folder: str, delimiter: str = ",", workers: int = 1) -> dict:
    """The input relations' files. With several workers a relation's rows are dealt to as many partitions by their first column."""
    out = {d.name: read_relation(spark, d, folder, delimiter) for d in program.edbs}
    return {n: rows.repartition(workers, rows.columns[0]) if workers > 1 and rows.columns else rows for n, rows in out.items()}


def run_batch(spark: SparkSession, args: Args, write: Callable[[str], None] = print) -> dict[str, int]:
    """Runs and returns the number of rows of each output relation that has any."""
    program = parse_program(Path(args.program).read_text())
    engine = Engine(spark, args.level, not args.no_sharing)
    out = engine.run(program, load_facts(spark, program, args.facts, args.delimiter, args.workers))
    sizes: dict[str, int] = {}
    for name, rows in out.items():
        if args.csvs:
            rows = rows.persist()
            n = rows.count()
            if n:
                path = program.idb(name).path
                write_csv_file(rows, f"{args.csvs}/csvs/{name}.csv")
                if path:
                    write_csv_file(rows, f"{args.csvs}/csvs/{path}")
            rows.unpersist()
        else:
            n = 0
            for row in rows.orderBy(*rows.columns).toLocalIterator():
                write(f"{name}: {','.join(csv_cell(v) for v in row)}")
                n += 1
        if n:
            sizes[name] = n
    if args.csvs:
        write_sizes(sizes, f"{args.csvs}/size.txt")
    return sizes


def run_streaming(spark: SparkSession, args: Args, lines: Iterable[str], write: Callable[[str], None] = print) -> None:
    program = parse_program(Path(args.program).read_text())
    session = Session(spark, program, load_facts(spark, program, args.facts, args.delimiter, args.workers), Engine(spark, args.level, not args.no_sharing))
    run_stream(session, lines, write, args.delimiter)


def run_inspect(path: str, as_json: bool = False, level: int | None = None) -> str:
    text = Path(path).read_text()
    return (inspect_json if as_json else inspect_text)(text, path, level)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["inspect"]:
        p = argparse.ArgumentParser(prog="lodestrata inspect")
        p.add_argument("program")
        p.add_argument("--json", action="store_true")
        p.add_argument("-O", dest="level", type=int, choices=range(4))
        a = p.parse_args(argv[1:])
        print(run_inspect(a.program, a.json, a.level))
        return 0
    args = parse_args(argv)
    spark = SparkSession.builder.appName(args.program_name()).getOrCreate()
    if args.stream:
        run_streaming(spark, args, (line.rstrip("\n") for line in sys.stdin), lambda line: print(line, flush=True))
    else:
        run_batch(spark, args)
    return 0
