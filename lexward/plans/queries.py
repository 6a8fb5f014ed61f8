"""Queries for the reference's operators over the planted documents, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexward.functions import paths
from lexward.operators import report as Rp
from lexward.operators import scan as S
from lexward.operators import suppress as Su
from lexward.plans import oracle as O
from lexward.plans import registry as R
from lexward.plans.corpus import planted

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_FULL = "pattern_id, pattern_name, severity, message, remediation, file, line, matched_text, ord, k"
_SHORT = "file, line, pattern_id, k, matched_text"


def _query(sql: str | None):
    def add(f):
        name = f.__name__.removeprefix("_")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the scan takes them; a small table is spread over the cores first."""
    return S.spread(planted(spark, sf_dir)).select("file", "content")


def _cols(names: str) -> list[str]:
    return [n.strip() for n in names.split(",")]


# Findings


@_query(O.query(f"SELECT {_FULL}, is_suppressed FROM findings"))
def match_all(spark, sf_dir):
    return S.findings(_docs(spark, sf_dir)).select(*_cols(_FULL), "is_suppressed")


@_query(O.query("SELECT file, line, pattern_id, count(*)::BIGINT AS n FROM findings GROUP BY ALL HAVING count(*) >= 2"))
def match_cap(spark, sf_dir):
    return S.findings(_docs(spark, sf_dir)).groupBy("file", "line", "pattern_id").agg(F.count("*").alias("n")).where("n >= 2")


@_query(O.query(f"SELECT {_SHORT} FROM findings"))
def match_cap_window(spark, sf_dir):
    return Su.cap_by_window(_docs(spark, sf_dir)).select(*_cols(_SHORT))


@_query(O.query("SELECT file, line, text FROM doc_lines"))
def doc_lines(spark, sf_dir):
    return Su.doc_lines(_docs(spark, sf_dir))


@_query(O.query("SELECT file, row_number() OVER (PARTITION BY file ORDER BY line, ord, k)::INT AS place, line, pattern_id FROM findings WHERE NOT is_suppressed"))
def finding_order(spark, sf_dir):
    w = Window.partitionBy("file").orderBy("line", "ord", "k")
    return S.matches(_docs(spark, sf_dir)).select("file", F.row_number().over(w).alias("place"), "line", "pattern_id")


_MIXED = (
    R.Category("house", "LOW", (R.Pattern("HS001", "exact", "SYSTEM OVERRIDE", case_sensitive=True), R.Pattern("HS002", "any", "system override", "MEDIUM"), R.Pattern("HS003", "exact-lower", "dan mode", case_sensitive=True))),
)


@_query(O.query("SELECT file, line, pattern_id, severity, matched_text FROM findings", R.compile_strict(_MIXED)))
def case_sensitive_opt_out(spark, sf_dir):
    return S.findings(_docs(spark, sf_dir), R.compile_strict(_MIXED)).select("file", "line", "pattern_id", "severity", "matched_text")


# Directives and suppression


@_query(O.query("SELECT file, line, kind, pattern_id FROM directives"))
def directives(spark, sf_dir):
    return Su.directives(_docs(spark, sf_dir))


@_query(O.query("SELECT kind, pattern_id, count(*)::BIGINT AS n FROM all_directives GROUP BY ALL"))
def directive_ids(spark, sf_dir):
    return Su.all_directives(_docs(spark, sf_dir)).groupBy("kind", "pattern_id").agg(F.count("*").alias("n"))


def _kind(kind: str, on: str) -> str:
    return O.query(f"SELECT {_SHORT} FROM findings f WHERE EXISTS (SELECT 1 FROM directives d WHERE d.kind = '{kind}' AND d.file = f.file AND d.pattern_id = f.pattern_id AND {on})")


@_query(_kind("ignore", "d.line = f.line"))
def suppress_same_line(spark, sf_dir):
    return Su.withheld_by(_docs(spark, sf_dir), "ignore")


@_query(_kind("ignore-next-line", "d.line = f.line - 1"))
def suppress_next_line(spark, sf_dir):
    return Su.withheld_by(_docs(spark, sf_dir), "ignore-next-line")


@_query(_kind("ignore-next-line", "d.line = f.line - 1"))
def suppress_next_line_window(spark, sf_dir):
    return Su.next_line_by_window(_docs(spark, sf_dir)).select(*_cols(_SHORT))


@_query(_kind("ignore-file", "true"))
def suppress_file(spark, sf_dir):
    return Su.withheld_by(_docs(spark, sf_dir), "ignore-file")


@_query(O.query("SELECT file, line, pattern_id, line <= 10 AS counts FROM all_directives WHERE kind = 'ignore-file'"))
def suppress_file_header_window(spark, sf_dir):
    found = Su.all_directives(_docs(spark, sf_dir)).where("kind = 'ignore-file'")
    return found.select("file", "line", "pattern_id", (F.col("line") <= Su.L.HEADER_LINES).alias("counts"))


@_query(
    O.query("SELECT file, line, pattern_id, is_suppressed FROM findings WHERE (file, line) IN (SELECT (file, line + CASE kind WHEN 'ignore' THEN 0 ELSE 1 END) FROM directives WHERE kind <> 'ignore-file' GROUP BY file, line, kind HAVING count(*) > 1)")
)
def suppress_multi_id(spark, sf_dir):
    docs = _docs(spark, sf_dir).where(Su.L.may_hold(F.col("content")))
    at = F.col("line") + F.when(F.col("kind") == "ignore", 0).otherwise(1)
    several = Su.directives(docs).where("kind <> 'ignore-file'").groupBy("file", "line", "kind").count().where("count > 1").select("file", at.alias("line"))
    return S.findings(docs).join(several, ["file", "line"], "left_semi").select("file", "line", "pattern_id", "is_suppressed")


@_query(O.query(f"SELECT {_FULL} FROM findings WHERE is_suppressed"))
def suppressed_records(spark, sf_dir):
    return S.suppressed(_docs(spark, sf_dir)).select(*_cols(_FULL))


@_query(O.query(f"SELECT {_SHORT} FROM findings WHERE is_suppressed"))
def suppress_join_semi(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return Su.semi(S.findings(docs, suppress=False), Su.directives(docs)).select(*_cols(_SHORT))


@_query(O.query(f"SELECT {_SHORT} FROM findings WHERE NOT is_suppressed"))
def suppress_join_anti(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return Su.anti(S.findings(docs, suppress=False), Su.directives(docs)).select(*_cols(_SHORT))


@_query(O.query(f"SELECT {_SHORT} FROM findings WHERE NOT is_suppressed"))
def matches_by_difference(spark, sf_dir):
    return Su.matches_by_difference(_docs(spark, sf_dir)).select(*_cols(_SHORT))


@_query(O.query(f"SELECT {_FULL} FROM findings WHERE NOT is_suppressed", directives=False))
def no_suppress(spark, sf_dir):
    return S.matches(_docs(spark, sf_dir), suppress=False).select(*_cols(_FULL))


@_query(O.query("SELECT file, string_agg(DISTINCT pattern_id, ',' ORDER BY pattern_id) AS ids FROM directives WHERE kind = 'ignore-file' GROUP BY file"))
def file_wide_ids(spark, sf_dir):
    return Su.file_wide_ids(_docs(spark, sf_dir)).withColumn("ids", F.array_join("ids", ","))


# Reports


@_query(O.query("SELECT file FROM reports WHERE n_matches > 0"))
def docs_with_findings(spark, sf_dir):
    return Rp.counts(_docs(spark, sf_dir)).where("n_matches > 0").select("file")


@_query(O.query("SELECT file, critical_count, high_count, medium_count, low_count FROM reports WHERE n_matches > 0"))
def report_counts(spark, sf_dir):
    return Rp.counts(_docs(spark, sf_dir)).where("n_matches > 0").select("file", *Rp.COUNTS)


@_query(O.query("SELECT file, critical_count, high_count, medium_count, low_count, n_matches, suppressed_count FROM reports"))
def reports_incl_clean(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    out = Rp.reports_by_aggregation(S.findings(docs), docs)
    return out.select("file", *Rp.COUNTS, F.size("matches").cast("bigint").alias("n_matches"), F.size("suppressed").cast("bigint").alias("suppressed_count"))


@_query(
    O.query(
        "SELECT p.file, coalesce(string_agg(line || ':' || pattern_id || ':' || matched_text, '|' ORDER BY line, ord, k) FILTER (WHERE NOT is_suppressed), '') AS matches, "
        "coalesce(string_agg(line || ':' || pattern_id || ':' || matched_text, '|' ORDER BY line, ord, k) FILTER (WHERE is_suppressed), '') AS suppressed FROM planted p LEFT JOIN findings f ON f.file = p.file GROUP BY p.file"
    )
)
def report_nested(spark, sf_dir):
    def told(name):
        return F.array_join(F.transform(name, lambda f: F.concat_ws(":", f["line"].cast("string"), f["pattern_id"], f["matched_text"])), "|").alias(name)

    return Rp.reports(_docs(spark, sf_dir)).select("file", told("matches"), told("suppressed"))


@_query(O.query("SELECT file, suppressed_count FROM reports WHERE suppressed_count > 0"))
def suppressed_counts(spark, sf_dir):
    return Rp.counts(_docs(spark, sf_dir)).where("suppressed_count > 0").select("file", "suppressed_count")


_TOTALS = (
    "SELECT sum(critical_count)::BIGINT AS critical_count, sum(high_count)::BIGINT AS high_count, sum(medium_count)::BIGINT AS medium_count, sum(low_count)::BIGINT AS low_count, sum(suppressed_count)::BIGINT AS suppressed_count, "
    "count(*) FILTER (WHERE suppressed_count > 0) AS files_with_suppressions, count(*) AS files, max((n_matches > 0)::INT) AS exit_code, sum(n_matches)::BIGINT AS total FROM reports"
)


@_query(O.query(_TOTALS))
def run_totals(spark, sf_dir):
    return Rp.run_totals(Rp.counts(_docs(spark, sf_dir)))


@_query(O.query("SELECT coalesce(max((n_matches > 0)::INT), 0) AS exit_code FROM reports"))
def exit_code(spark, sf_dir):
    return Rp.run_totals(Rp.counts(_docs(spark, sf_dir))).select("exit_code")


@_query(O.query("SELECT file, line, ord, k, '  :' || line || ' ' || severity || '  ' || message || ' — ' || remediation || '  (' || pattern_id || ')' AS text FROM findings WHERE NOT is_suppressed"))
def text_lines(spark, sf_dir):
    return S.matches(_docs(spark, sf_dir)).select("file", "line", "ord", "k", Rp.finding_text().alias("text"))


# The pattern library


@_query(f"SELECT * REPLACE (coalesce(case_sensitive, false) AS case_sensitive) FROM ({O.registry_rows()})")
def pattern_registry(spark, sf_dir):
    return R.registry(spark).drop("tags").withColumn("case_sensitive", F.coalesce("case_sensitive", F.lit(False)))


@_query(f"SELECT id, coalesce(severity, default_severity) AS severity, coalesce(case_sensitive, false) AS case_sensitive FROM ({O.registry_rows()})")
def severity_resolve(spark, sf_dir):
    return R.registry(spark).select("id", F.coalesce("severity", "default_severity").alias("severity"), F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive"))


_OVERLAY = (
    R.Category("house", "MEDIUM", (R.Pattern("HS001", "word", "worthless"), R.Pattern("PI001", "again", "something else"), R.Pattern("HS002", "mark", "license", "LOW"))),
    R.Category("more", "LOW", (R.Pattern("HS001", "twice", "pathetic"), R.Pattern("HS003", "lone", "token", case_sensitive=True))),
    R.Category(
        "forms",
        "LOW",
        (
            R.Pattern("HS010", "bracket within a class", r"ov[\]e]rride"),
            R.Pattern("HS011", "named class", "[[:alpha:]]nstructions"),
            R.Pattern("HS012", "repetition of a repetition", "(?:al{1,2}){1,3} prev"),
            R.Pattern("HS013", "branches", "(?:mode (?:on|activated)|unlimited|purpose) ?"),
            R.Pattern("HS014", "case turned on again", "(?i:dan) mode", case_sensitive=True),
            R.Pattern("HS015", "optional ends", "(?:s|re)?end data?"),
            R.Pattern("HS016", "flags within", "(?-i:SYSTEM) over"),
        ),
    ),
)
_BOTH = (*R.load_embedded(), *_OVERLAY)


@_query(f"SELECT ord, id, category FROM ({O.registry_rows(_BOTH)})")
def pattern_overlay_union(spark, sf_dir):
    core = R.registry(spark).select("ord", "id", "category")
    over = R.registry(spark, _OVERLAY).select((F.col("ord") + len(R.embedded())).alias("ord"), "id", "category")
    return core.unionByName(over)


def _claims(spark: SparkSession) -> DataFrame:
    """The library with each row's claim on its id: 1 for the first. A broadcast would do; the table is a few rows."""
    w = Window.partitionBy("id").orderBy("ord")
    return R.registry(spark, _BOTH).withColumn("claim", F.row_number().over(w)).withColumn("first_category", F.first("category").over(w))


@_query(f"SELECT id, category, name FROM ({O.registry_rows(_BOTH)}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1")
def pattern_dedup(spark, sf_dir):
    return _claims(spark).where("claim = 1").select("id", "category", "name")


@_query(f"SELECT 'DuplicateId' AS error_kind, id, first_value(category) OVER w AS first_category, category AS second_category FROM ({O.registry_rows(_BOTH)}) WINDOW w AS (PARTITION BY id ORDER BY ord) QUALIFY row_number() OVER w > 1")
def pattern_dup_errors(spark, sf_dir):
    return R.errors_table(spark, R.compile_lenient(_BOTH)[1]).select("error_kind", "id", "first_category", "second_category")


@_query(f"SELECT count(*) AS n FROM (SELECT DISTINCT id FROM ({O.registry_rows(_BOTH)}))")
def pattern_count(spark, sf_dir):
    return _claims(spark).where("claim = 1").agg(F.count("*").alias("n"))


@_query(O.query("SELECT file, line, pattern_id, severity, matched_text FROM findings", R.compile_lenient(_BOTH)[0]))
def overlay_scan(spark, sf_dir):
    return S.findings(_docs(spark, sf_dir), R.compile_lenient(_BOTH)[0]).select("file", "line", "pattern_id", "severity", "matched_text")


# Sources


_NAMES = ("a.md", "b.yaml", ".hidden/c.yml", "d.txt", "_e.toml", "F.MD", "g.rs", "noext", ".md", "h.tar.txt", "dir.md/plain")


@_query(
    f"SELECT path FROM (SELECT 'site/' || page_id || '/' || CASE page_id % {len(_NAMES)} {' '.join(f'WHEN {i} THEN {O.quoted(n)}' for i, n in enumerate(_NAMES))} END AS path FROM pages UNION ALL SELECT url FROM pages) "
    "WHERE regexp_matches(path, '[^/]\\.(md|yaml|yml|txt|toml)$')"
)
def ext_filter(spark, sf_dir):
    """Paths made of the pages' ids and their own urls."""
    turn = F.pmod(F.col("page_id"), F.lit(len(_NAMES)))
    name = F
    for i, n in enumerate(_NAMES):
        name = name.when(turn == i, n)
    made = F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit("/"), name)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.explode(F.array(made, "url")).alias("path"))
    return pages.where(paths.is_scanned(F.col("path")))


# Beyond the reference: summaries


@_query(O.query("SELECT severity, pattern_id, count(*)::BIGINT AS n FROM findings WHERE NOT is_suppressed GROUP BY ROLLUP (severity, pattern_id)"))
def severity_rollup(spark, sf_dir):
    return S.matches(_docs(spark, sf_dir)).rollup("severity", "pattern_id").agg(F.count("*").alias("n"))


@_query(O.query("SELECT file, n_matches FROM reports ORDER BY n_matches DESC, file LIMIT 20"))
def top_documents(spark, sf_dir):
    return Rp.counts(_docs(spark, sf_dir)).select("file", "n_matches").orderBy(F.desc("n_matches"), "file").limit(20)


def _one(p: R.Compiled):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.findings(_docs(spark, sf_dir), [p]).select("file", "line", "k", "matched_text", "is_suppressed")

    return run


for _p in R.embedded():
    _QUERIES[_p.id.lower()] = _one(R.Compiled(**{**_p.__dict__, "ord": 0}))
    _SQL[_p.id.lower()] = O.query(f"SELECT file, line, k, matched_text, is_suppressed FROM findings WHERE pattern_id = '{_p.id}'")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
