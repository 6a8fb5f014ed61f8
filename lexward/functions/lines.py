"""Lines of a text and the directives on them, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keyword that opens a directive in a scanned document, as in "lexward:ignore PI001". Every function that reads
#: directives takes another one as a parameter, for documents that were written for another scanner.
KEYWORD = "lexward"

KINDS = ("ignore-next-line", "ignore-file", "ignore")

_ID = "[A-Za-z][A-Za-z0-9_-]*"


def directive_pattern(keyword: str = KEYWORD) -> str:
    """Kind and list of ids; white space is Unicode's. The list never has to be given back, so it is possessive: any
    number of ids is matched in a loop, without the engine's stack."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]*", keyword):
        raise ValueError("a directive's keyword is made of letters, digits, '-' and '_'")
    return rf"(?U){keyword}:({'|'.join(KINDS)})\s+({_ID}(?:\s*,\s*{_ID})*+)"


#: Lines from the top in which ignore-file counts.
HEADER_LINES = 10


def sql_text(text: str) -> str:
    """A text as an SQL expression that no setting of the parser changes; it is folded to a literal."""
    return f"CAST(X'{text.encode().hex()}' AS STRING)"


def lines_sql(content: str) -> str:
    """SQL of the array of the lines: parted by a line feed with or without one carriage return; a last empty one is none."""
    end, feed = sql_text("\r?\n\\z"), sql_text("\r?\n")
    whole = f"CASE WHEN endswith({content}, chr(10)) THEN regexp_replace({content}, {end}, '') ELSE {content} END"
    return f"CASE WHEN {content} <> '' THEN split({whole}, {feed}, -1) ELSE CAST(array() AS ARRAY<STRING>) END"


def lines(content: Column) -> Column:
    """The same of a column."""
    cut = F.when(F.endswith(content, F.lit("\n")), F.regexp_replace(content, "\r?\n\\z", "")).otherwise(content)
    return F.when(content != "", F.split(cut, "\r?\n", -1)).otherwise(F.array().cast("array<string>"))


def ids_of(listed: Column) -> Column:
    """Ids of a directive's list."""
    return F.split(listed, r"(?U)\s*,\s*")


def line_directives(line: Column, keyword: str = KEYWORD) -> Column:
    """Array of struct(kind, pattern_id) of a line, in order."""
    pattern = F.lit(directive_pattern(keyword))
    found = F.arrays_zip(F.regexp_extract_all(line, pattern, 1).alias("kind"), F.regexp_extract_all(line, pattern, 2).alias("ids"))
    each = F.transform(found, lambda d: F.transform(ids_of(d["ids"]), lambda i: F.struct(d["kind"].alias("kind"), i.alias("pattern_id"))))
    return F.flatten(each)


def none() -> Column:
    """No directives."""
    return F.array().cast("array<struct<line:int,kind:string,pattern_id:string>>")


def may_hold(text: Column, keyword: str = KEYWORD) -> Column:
    """Whether a text contains the keyword: one without it has no directives."""
    return F.contains(text, F.lit(keyword + ":"))


def document_directives(content: Column, keyword: str = KEYWORD) -> Column:
    """Array of struct(line, kind, pattern_id) of a document that counts: ignore-file in its first lines only.

    Lines without the keyword are left out first, so a document without directives costs one search.
    """
    numbered = F.filter(F.transform(lines(content), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"))), lambda x: may_hold(x["text"], keyword))
    found = F.flatten(F.transform(numbered, lambda x: F.transform(line_directives(x["text"], keyword), lambda d: F.struct(x["line"].alias("line"), d["kind"].alias("kind"), d["pattern_id"].alias("pattern_id")))))
    counted = F.filter(found, lambda d: (d["kind"] != "ignore-file") | (d["line"] <= HEADER_LINES))
    return F.when(may_hold(content, keyword), counted).otherwise(none())


def is_suppressed(directives: Column, line: Column, pattern_id: Column) -> Column:
    """Whether a finding on the line is held back: by a directive for the file, on the line, or on the one before."""
    return F.exists(
        directives,
        lambda d: (d["pattern_id"] == pattern_id)
        & ((d["kind"] == "ignore-file") | ((d["kind"] == "ignore") & (d["line"] == line)) | ((d["kind"] == "ignore-next-line") & (d["line"] == line - 1))),
    )
