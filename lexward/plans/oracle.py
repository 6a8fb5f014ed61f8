"""The scan as DuckDB SQL, stage by stage, to hold the queries against."""

from __future__ import annotations

from lexward.functions.lines import HEADER_LINES, KEYWORD, KINDS
from lexward.operators.scan import CAP
from lexward.plans import registry as R
from lexward.plans.corpus import planted_sql


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def registry_rows(categories=None) -> str:
    """VALUES with the patterns as declared: ord, category, default_severity, id, name, pattern, severity, case_sensitive, description, remediation."""
    rows, i = [], 0
    for c in R.load_embedded() if categories is None else categories:
        for p in c.patterns:
            flag = "NULL::BOOLEAN" if p.case_sensitive is None else str(p.case_sensitive)
            severity = "NULL" if p.severity is None else quoted(p.severity)
            rows.append(f"({i}::INT, {quoted(c.category)}, {quoted(c.default_severity)}, {quoted(p.id)}, {quoted(p.name)}, {quoted(p.pattern)}, {severity}, {flag}, {quoted(p.description)}, {quoted(p.remediation)})")
            i += 1
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS r(ord, category, default_severity, id, name, pattern, severity, case_sensitive, description, remediation)"


def _regex(p: R.Compiled) -> str:
    return quoted(("" if p.case_sensitive else "(?i)") + p.pattern.removeprefix("(?i)"))


def stages(patterns=None, directives: bool = True) -> str:
    """Common table expressions planted, doc_lines, directives, hits and findings."""
    patterns = R.embedded() if patterns is None else patterns
    each = "\nUNION ALL ".join(
        f"SELECT file, line, {p.ord}::INT AS ord, {quoted(p.id)} AS pattern_id, {quoted(p.name)} AS pattern_name, {quoted(p.severity)} AS severity, {quoted(p.message)} AS message, {quoted(p.remediation)} AS remediation, "
        f"unnest(list_slice(regexp_extract_all(text, {_regex(p)}, 0), 1, {CAP})) AS matched_text, generate_subscripts(list_slice(regexp_extract_all(text, {_regex(p)}, 0), 1, {CAP}), 1) - 1 AS k FROM doc_lines WHERE regexp_matches(text, {_regex(p)})"
        for p in patterns
    )
    rx = quoted(rf"{KEYWORD}:({'|'.join(KINDS)})\s+([A-Za-z][A-Za-z0-9_-]*(?:\s*,\s*[A-Za-z][A-Za-z0-9_-]*)*)")
    kept = f"kind <> 'ignore-file' OR line <= {HEADER_LINES}" if directives else "false"
    return f"""planted AS ({planted_sql()}),
split AS (SELECT doc_id, file, regexp_split_to_array(content, '\\r?\\n') AS a FROM planted),
trimmed AS (SELECT doc_id, file, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM split),
doc_lines AS MATERIALIZED (SELECT doc_id, file, unnest(a) AS text, generate_subscripts(a, 1)::INT AS line FROM trimmed),
raw_directives AS (SELECT file, line, unnest(regexp_extract_all(text, {rx}, 1)) AS kind, unnest(regexp_extract_all(text, {rx}, 2)) AS ids FROM doc_lines WHERE contains(text, '{KEYWORD}:')),
all_directives AS (SELECT file, line, kind, trim(unnest(string_split(ids, ','))) AS pattern_id FROM raw_directives),
directives AS MATERIALIZED (SELECT * FROM all_directives WHERE {kept}),
hits AS MATERIALIZED ({each}),
findings AS MATERIALIZED (SELECT h.pattern_id, pattern_name, severity, message, remediation, h.file, h.line, matched_text, ord, k::INT AS k,
  EXISTS (SELECT 1 FROM directives d WHERE d.file = h.file AND d.pattern_id = h.pattern_id
    AND (d.kind = 'ignore-file' OR (d.kind = 'ignore' AND d.line = h.line) OR (d.kind = 'ignore-next-line' AND d.line = h.line - 1))) AS is_suppressed FROM hits h),
reports AS MATERIALIZED (SELECT p.file, count(*) FILTER (WHERE NOT is_suppressed AND severity = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE NOT is_suppressed AND severity = 'HIGH') AS high_count,
  count(*) FILTER (WHERE NOT is_suppressed AND severity = 'MEDIUM') AS medium_count, count(*) FILTER (WHERE NOT is_suppressed AND severity = 'LOW') AS low_count,
  count(*) FILTER (WHERE NOT is_suppressed) AS n_matches, count(*) FILTER (WHERE is_suppressed) AS suppressed_count FROM planted p LEFT JOIN findings f ON f.file = p.file GROUP BY p.file)"""


def query(select: str, patterns=None, directives: bool = True) -> str:
    return f"WITH {stages(patterns, directives)}\n{select}"
