"""The scan: documents to findings, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexward.functions import dialect
from lexward.functions import lines as L
from lexward.functions.lines import sql_text
from lexward.plans import registry as R

#: Matches of a pattern that are reported on a line.
CAP = 10

#: A finding's fields, in order.
FINDING = ("pattern_id", "pattern_name", "severity", "message", "remediation", "file", "line", "matched_text")

#: Tables of fewer bytes are spread over the session's parallelism before a scan; larger ones have splits enough.
SMALL_BYTES = 1 << 30


def folded(text: str) -> str:
    """SQL of text in lower case as the gates see it; the two letters outside ASCII that fold into it are folded too."""
    return f"lower(translate({text}, {sql_text('\u017f\u212a')}, 'sk'))"


def gate_texts(p: R.Compiled) -> tuple[str, ...]:
    """Texts of which any match of the pattern holds at least one, folded as by folded(); () where none is known."""
    return dialect.gate_texts(p.pattern, p.case_sensitive)


def _contains_any(low: str, texts: Sequence[str]) -> str:
    return " OR ".join(f"contains({low}, {sql_text(t)})" for t in texts)


def line_gate(patterns: Sequence[R.Compiled], text: str, gates: bool = True) -> str:
    """SQL of a condition that holds for every line with a match. The line is folded once, as the one element that exists() binds."""
    known = [gate_texts(p) for p in patterns]
    if not gates or not all(known):
        return "true"
    return f"exists(array({folded(text)}), low -> {_contains_any('low', sorted({t for texts in known for t in texts}))})"


def line_hits(patterns: Sequence[R.Compiled], text: str, gates: bool = True, cap: int | None = CAP) -> str:
    """SQL of the array of struct(ord, found) of a line: for each pattern with matches, in order, the first cap of them.

    Patterns are literals of the expression, so each is compiled once a task, and it runs only behind its gate.
    """

    def found(p: R.Compiled) -> str:
        every = f"regexp_extract_all({text}, {sql_text(p.java)}, 0)"
        every = every if cap is None else f"slice({every}, 1, {cap})"
        known = gate_texts(p) if gates else ()
        return f"CASE WHEN {_contains_any('low', known)} THEN {every} END" if known else every

    each = ", ".join(f"named_struct('ord', {p.ord}, 'found', {found(p)})" for p in patterns)
    return f"filter(element_at(transform(array({folded(text)}), low -> array({each})), 1), h -> size(h.found) > 0)"


_HITS = "array<struct<line:int,ord:int,k:int,matched_text:string>>"


def document_hits(patterns: Sequence[R.Compiled], content: str = "content", gates: bool = True) -> Column:
    """Array of the hits of the document in a column, ordered by line, pattern and place; all within the row."""
    if not patterns:
        return F.array().cast(_HITS)
    lines = f"transform({L.lines_sql(content)}, (text, i) -> named_struct('line', i + 1, 'text', text))"
    each = "transform(h.found, (m, k) -> named_struct('line', x.line, 'ord', h.ord, 'k', k, 'matched_text', m))"
    return F.expr(f"flatten(transform(filter({lines}, x -> {line_gate(patterns, 'x.text', gates)}), x -> flatten(transform({line_hits(patterns, 'x.text', gates)}, h -> {each}))))")


def once(df: DataFrame) -> DataFrame:
    """df behind a generator of one row each: filters on its columns can't be moved below and work them out again."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def spread(docs: DataFrame, parallelism: int | None = None) -> DataFrame:
    """docs over all cores if the table is small; a single row group would otherwise keep one core busy.

    A large table is left as it is read: it has splits enough, and shuffling its texts would cost more.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(parallelism or docs.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else docs


def scan_documents(docs: DataFrame, patterns: Sequence[R.Compiled] | None = None, suppress: bool = True, gates: bool = True, keyword: str = L.KEYWORD) -> DataFrame:
    """(file, hits, directives): docs (file, content) with the hits of each document, none left out.

    A null content is an empty document.
    """
    patterns = R.embedded() if patterns is None else patterns
    held = L.document_directives(F.col("content"), keyword) if suppress else F.lit(None)
    plain = docs.select("file", F.coalesce("content", F.lit("")).alias("content"))
    return plain.select("file", document_hits(patterns, "content", gates).alias("hits"), F.coalesce(held, L.none()).alias("directives"))


def _attributes(patterns: Sequence[R.Compiled]) -> str:
    """SQL of the constant array of the fields that a pattern gives its findings, by place."""
    fields = [(p.id, p.name, p.severity, p.message, p.remediation) for p in patterns] or [("",) * 5]
    return "array(" + ", ".join("named_struct(" + ", ".join(f"'{n}', {sql_text(v)}" for n, v in zip(FINDING[:5], row)) + ")" for row in fields) + ")"


def line_findings(lines: DataFrame, patterns: Sequence[R.Compiled], gates: bool = True, cap: int | None = CAP) -> DataFrame:
    """lines (with a column text) as one row a match: ord, k and matched_text in the place of text.

    Lines without an open gate go before any pattern runs; outer generators keep the optimizer from working
    the arrays out a second time to see whether they are empty.
    """
    others = [c for c in lines.columns if c != "text"]
    if not patterns:
        return lines.limit(0).selectExpr(*others, "0 AS ord", "0 AS k", "text AS matched_text")
    gated = lines.where(F.expr(f"text IS NOT NULL AND {line_gate(patterns, 'text', gates)}"))
    found = gated.selectExpr(*others, f"inline_outer({line_hits(patterns, 'text', gates, cap)})").where("ord IS NOT NULL")
    return found.selectExpr(*others, "ord", "posexplode_outer(found) AS (k, matched_text)")


def findings(docs: DataFrame, patterns: Sequence[R.Compiled] | None = None, suppress: bool = True, gates: bool = True, keyword: str = L.KEYWORD) -> DataFrame:
    """One row a finding: FINDING's fields, then ord, k and is_suppressed. Directives are read once a document."""
    held = L.document_directives(F.col("content"), keyword) if suppress else L.none()
    return _routed(docs.select("file", held.alias("directives"), "content"), list(R.embedded() if patterns is None else patterns), gates)


def _routed(docs: DataFrame, patterns: Sequence[R.Compiled], gates: bool = True) -> DataFrame:
    """findings() of documents with their directives."""
    lines = docs.selectExpr("file", "directives", f"posexplode_outer({L.lines_sql('content')}) AS (at, text)")
    found = line_findings(lines.selectExpr("file", "directives", "at + 1 AS line", "text"), patterns, gates)
    named = found.withColumn("p", F.expr(f"element_at({_attributes(patterns)}, ord + 1)"))
    return named.select(*[F.col(f"p.{n}").alias(n) for n in FINDING[:5]], "file", "line", "matched_text", "ord", "k", L.is_suppressed(F.col("directives"), F.col("line"), F.col("p.pattern_id")).alias("is_suppressed"))


def matches(docs: DataFrame, patterns: Sequence[R.Compiled] | None = None, suppress: bool = True, keyword: str = L.KEYWORD) -> DataFrame:
    return findings(docs, patterns, suppress, keyword=keyword).where("NOT is_suppressed").drop("is_suppressed")


def suppressed(docs: DataFrame, patterns: Sequence[R.Compiled] | None = None, keyword: str = L.KEYWORD) -> DataFrame:
    """Findings that are held back. A document without a directive goes before its lines are parted."""
    marked = docs.where(L.may_hold(F.col("content"), keyword))
    held = once(marked.select("file", L.document_directives(F.col("content"), keyword).alias("directives"), "content")).where(F.size("directives") > 0)
    return _routed(held, list(R.embedded() if patterns is None else patterns)).where("is_suppressed").drop("is_suppressed")
