"""Suppression as relations: directives as rows, and the joins that route findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexward.functions import lines as L
from lexward.operators import scan as S
from lexward.plans import registry as R


def doc_lines(docs: DataFrame) -> DataFrame:
    """(file, line, text) of every line."""
    split = docs.selectExpr("file", f"posexplode_outer({L.lines_sql('content')}) AS (at, text)")
    return split.where("text IS NOT NULL").select("file", (F.col("at") + 1).alias("line"), "text")


def all_directives(docs: DataFrame, keyword: str = L.KEYWORD) -> DataFrame:
    """(file, line, kind, pattern_id) of every directive, late ignore-file ones included."""
    marked = docs.where(L.may_hold(F.col("content"), keyword))
    found = doc_lines(marked).where(L.may_hold(F.col("text"), keyword))
    return found.select("file", "line", F.explode(L.line_directives(F.col("text"), keyword)).alias("d")).select("file", "line", "d.kind", "d.pattern_id")


def directives(docs: DataFrame, keyword: str = L.KEYWORD) -> DataFrame:
    """Those that count."""
    return all_directives(docs, keyword).where((F.col("kind") != "ignore-file") | (F.col("line") <= L.HEADER_LINES))


def file_wide_ids(docs: DataFrame) -> DataFrame:
    """(file, ids): the ids that a document suppresses as a whole, in order."""
    return directives(docs).where("kind = 'ignore-file'").groupBy("file").agg(F.array_sort(F.collect_set("pattern_id")).alias("ids"))


def withheld_by(docs: DataFrame, kind: str, patterns: Sequence[R.Compiled] | None = None) -> DataFrame:
    """Findings that directives of one kind hold back, whatever others do."""
    patterns = list(R.embedded() if patterns is None else patterns)
    of_kind = F.filter(L.document_directives(F.col("content")), lambda d: d["kind"] == kind)
    held = S.once(docs.where(L.may_hold(F.col("content"))).select("file", "content", of_kind.alias("directives"))).where(F.size("directives") > 0)
    lines = held.selectExpr("file", "directives", f"posexplode_outer({L.lines_sql('content')}) AS (at, text)").selectExpr("file", "directives", "at + 1 AS line", "text")
    return _named(S.line_findings(lines, patterns), patterns).where(L.is_suppressed(F.col("directives"), F.col("line"), F.col("pattern_id"))).select("file", "line", "pattern_id", "k", "matched_text")


def _named(found: DataFrame, patterns: Sequence[R.Compiled]) -> DataFrame:
    """Matches with the ids of their patterns."""
    ids = ", ".join(S.sql_text(p.id) for p in patterns) or "''"
    return found.withColumn("pattern_id", F.expr(f"element_at(array({ids}), ord + 1)"))


def _holding(found: DataFrame, held: DataFrame):
    """held, named apart, and the condition under which one of its directives holds a finding back."""
    at = F.when(F.col("kind") == "ignore", F.col("line")).when(F.col("kind") == "ignore-next-line", F.col("line") + 1)
    keys = held.select(F.col("file").alias("of_file"), F.col("pattern_id").alias("of_pattern"), at.alias("of_line"))
    # Equal files and patterns key the join; the line, which a directive for the whole file lacks, is tested behind them.
    return keys, (found["file"] == F.col("of_file")) & (found["pattern_id"] == F.col("of_pattern")) & (F.col("of_line").isNull() | (F.col("of_line") == found["line"]))


def semi(found: DataFrame, held: DataFrame) -> DataFrame:
    """Suppressed findings by one left semi join."""
    return found.join(*_holding(found, held), "left_semi")


def anti(found: DataFrame, held: DataFrame) -> DataFrame:
    """Findings that stay, by one left anti join."""
    return found.join(*_holding(found, held), "left_anti")


def next_line_by_window(docs: DataFrame, patterns: Sequence[R.Compiled] | None = None) -> DataFrame:
    """Findings that the line before holds back, by a window over the lines of a document."""
    patterns = list(R.embedded() if patterns is None else patterns)
    w = Window.partitionBy("file").orderBy("line")
    own = F.transform(F.filter(L.line_directives(F.col("text")), lambda d: d["kind"] == "ignore-next-line"), lambda d: d["pattern_id"])
    rows = doc_lines(docs).withColumn("before", F.lag(own).over(w)).where(F.size("before") > 0)
    named = _named(S.line_findings(rows, patterns), patterns)
    return named.where(F.array_contains("before", F.col("pattern_id"))).select("file", "line", "pattern_id", "k", "matched_text")


def matches_by_difference(docs: DataFrame, patterns: Sequence[R.Compiled] | None = None) -> DataFrame:
    """What stays, as all findings except the suppressed ones; the latter's search leaves out documents without directives."""
    return S.findings(docs, patterns, suppress=False).drop("is_suppressed").exceptAll(S.suppressed(docs, patterns))


def cap_by_window(docs: DataFrame, patterns: Sequence[R.Compiled] | None = None) -> DataFrame:
    """The cap a pattern and line as a limit by group: row numbers of all matches of a line."""
    patterns = list(R.embedded() if patterns is None else patterns)
    every = _named(S.line_findings(doc_lines(docs), patterns, cap=None), patterns)
    w = Window.partitionBy("file", "line", "pattern_id").orderBy("at")
    numbered = every.withColumnRenamed("k", "at").withColumn("n", F.row_number().over(w)).where(F.col("n") <= S.CAP)
    return numbered.select("file", "line", "pattern_id", (F.col("n") - 1).alias("k"), "matched_text")
