"""The command line: check a file, a folder or standard input."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexward import __version__
from lexward.functions.lines import KEYWORD
from lexward.operators import report as Rp
from lexward.plans import registry as R
from lexward.sinks import render
from lexward.sources import files


class Failure(Exception):
    """An error that ends the run with exit code 1."""


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lexward", description="Scan texts for prompt injection")
    parser.add_argument("--version", action="version", version=f"lexward {__version__}")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check", help="scan files for patterns of prompt injection")
    check.add_argument("path", help="file or folder, or - for standard input")
    check.add_argument("--format", type=str.lower, choices=("text", "json"), default="text", help="form of the output")
    check.add_argument("--patterns", help="folder with more patterns")
    check.add_argument("--strict-patterns", action="store_true", help="fail where a pattern is invalid or its id is taken")
    check.add_argument("--directive-keyword", default=KEYWORD, help=f"word that opens a directive in a document (default: {KEYWORD})")
    check.add_argument("--no-suppress", action="store_true", help="heed no directive in the scanned documents; use it for texts that aren't your own")
    return parser


def load_patterns(folder: str | None, strict: bool, warn) -> list[R.Compiled]:
    """Accepted patterns. With a folder and without strict, what is rejected is told and left out; else it fails."""
    loaded = R.load_all(folder)
    if folder is not None and not strict:
        accepted, errors = R.compile_lenient(loaded.categories)
        errors = [*loaded.errors, *errors]
        for e in errors:
            warn(f"warning: pattern skipped — {e}")
        if errors:
            warn(f"warning: {len(errors)} pattern(s) were rejected and are NOT being applied")
        return accepted
    try:
        if loaded.errors:
            raise loaded.errors[0]
        return R.compile_strict(loaded.categories)
    except R.PatternError as e:
        raise Failure("the patterns aren't valid") from e


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("lexward").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def check(path: str, form: str = "text", patterns: str | None = None, strict: bool = False, no_suppress: bool = False, keyword: str = KEYWORD, spark: SparkSession | None = None, out=None, err=None) -> int:
    """Scan, write the report to out and warnings to err, and give the exit code: 1 with findings, else 0."""
    out, err = out or sys.stdout, err or sys.stderr

    def warn(text: str) -> None:
        print(text, file=err)

    accepted = load_patterns(patterns, strict, warn)
    spark = spark or _session()
    skipped, table = 0, None
    try:
        if path == "-":
            docs = files.single(spark, "<stdin>", sys.stdin.buffer.read().decode("utf-8"))
        elif os.path.isfile(path):
            docs = files.single(spark, path, files.read_text(path))
        elif os.path.isdir(path):
            os.listdir(path)  # the folder itself must be readable
            # Kept, on disk where memory is short: the folder is walked once and each of its files read once.
            table = files.folder_table(spark, path).persist()
            for row in files.skipped_files(table).orderBy(F.desc("is_folder"), "file").toLocalIterator():
                warn(f"warning: skipped {'directory ' if row['is_folder'] else ''}{row['file']} — {row['reason']}")
                skipped += 1
            docs = files.documents(table)
        else:
            raise Failure(f"there is no such path: {path}")
    except (OSError, UnicodeDecodeError) as e:
        raise Failure(f"can't read {path}") from e
    reported = Rp.reports(docs, accepted, not no_suppress, keyword).persist()
    try:
        totals = Rp.run_totals(Rp.sized(reported)).first()
        for chunk in render.json_chunks(reported) if form == "json" else render.text_chunks(reported, totals):
            out.write(chunk)
        out.flush()
        if skipped:
            warn(f"warning: {skipped} file(s) skipped and NOT scanned, as told above")
        return totals["exit_code"]
    finally:
        reported.unpersist()
        if table is not None:
            table.unpersist()


def main(arguments: list[str] | None = None) -> int:
    """Exit code: 0 clean, 1 with findings or on an error, 2 for a wrong command line."""
    a = _parser().parse_args(arguments)
    try:
        return check(a.path, a.format, a.patterns, a.strict_patterns, a.no_suppress, a.directive_keyword)
    except Failure as e:
        cause = e.__cause__
        why = files.describe(cause) if isinstance(cause, OSError | UnicodeDecodeError) else files.root_cause(e)
        print(f"error: {e}" + (f": {why}" if cause is not None else ""), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
