"""Reports as text and as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexward.operators.report import COUNTS, finding_text
from lexward.operators.scan import FINDING


def _summary(totals) -> str:
    n = totals["total"]
    if not n:
        out = "No injection patterns detected.\n"
    else:
        parts = ", ".join(f"{totals[c]} {c.removesuffix('_count')}" for c in COUNTS)
        out = f"\n{n} finding(s): {parts}\n"
    held, files = totals["suppressed_count"], totals["files_with_suppressions"]
    if held:
        what, them = ("finding", "it") if held == 1 else ("findings", "them")
        where = f"{files} scanned file" + ("" if files == 1 else "s")
        out += f"{held} {what} suppressed by directives in {where}. Re-run with --no-suppress to see {them}.\n"
    return out


def text_chunks(reported: DataFrame, totals) -> Iterable[str]:
    """The text report, a document at a time in the order of names, then the summary of the totals row."""
    lines = reported.where(F.size("matches") > 0).select("file", F.transform("matches", lambda m: _line(m)).alias("lines")).orderBy("file")
    for row in lines.toLocalIterator():
        yield f"\n{row['file']}\n" + "".join(line + "\n" for line in row["lines"])
    yield _summary(totals)


def _line(m):
    return F.concat(F.lit("  :"), m["line"].cast("string"), F.lit(" "), m["severity"], F.lit("  "), m["message"], F.lit(" — "), m["remediation"], F.lit("  ("), m["pattern_id"], F.lit(")"))


def _indented(text: str) -> str:
    return "\n".join("  " + line for line in text.split("\n"))


def json_chunks(reported: DataFrame) -> Iterable[str]:
    """One JSON array with the reports by name, two spaces an indent; characters outside ASCII stay as they are."""
    first = True
    fields = ("file", "matches", "suppressed", *COUNTS)
    for row in reported.orderBy("file").toLocalIterator():
        report = {c: ([{f: m[f] for f in FINDING} for m in row[c]] if c in ("matches", "suppressed") else row[c]) for c in fields}
        yield ("[\n" if first else ",\n") + _indented(json.dumps(report, indent=2, ensure_ascii=False))
        first = False
    yield "[]" if first else "\n]"


def write_text(found: DataFrame, path: str) -> None:
    """Findings as lines of text files, for results too large for one: file, then the finding's line."""
    found.select(F.concat_ws("\t", "file", finding_text()).alias("value")).write.text(path)


def write_json(reported: DataFrame, path: str) -> None:
    """Reports as files of one JSON object a line."""
    reported.write.json(path)


__all__ = ["json_chunks", "text_chunks", "write_json", "write_text"]
