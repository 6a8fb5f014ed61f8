"""Reports: one a document, their totals and their renderings as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexward.functions import lines as L
from lexward.operators import scan as S
from lexward.plans import registry as R

COUNTS = tuple(f"{s.lower()}_count" for s in reversed(R.SEVERITIES))


def reports(docs: DataFrame, patterns: Sequence[R.Compiled] | None = None, suppress: bool = True, keyword: str = L.KEYWORD) -> DataFrame:
    """(file, matches, suppressed, critical_count, high_count, medium_count, low_count) of every document.

    Both arrays hold findings in the order of lines, patterns and places; the counts are of matches only. All
    is worked out within the row: there is no shuffle, and a clean document has its report.
    """
    patterns = list(R.embedded() if patterns is None else patterns)
    fields = ", ".join(f"'{n}', {e}" for n, e in zip(S.FINDING, (*[f"p.{n}" for n in S.FINDING[:5]], "file", "h.line", "h.matched_text")))
    bound = f"transform(hits, h -> element_at(transform(array(element_at({S._attributes(patterns)}, h.ord + 1)), p -> named_struct({fields})), 1))"
    found = S.once(S.scan_documents(docs, patterns, suppress, keyword=keyword)).select("file", "directives", F.expr(bound).alias("every"))
    held = F.col("directives")
    routed = found.select(
        "file",
        F.filter("every", lambda f: ~L.is_suppressed(held, f["line"], f["pattern_id"])).alias("matches"),
        F.filter("every", lambda f: L.is_suppressed(held, f["line"], f["pattern_id"])).alias("suppressed"),
    )
    return with_counts(S.once(routed))


def with_counts(routed: DataFrame) -> DataFrame:
    def count(severity: str):
        return F.size(F.filter("matches", lambda f: f["severity"] == severity)).cast("bigint")

    counts = [count(s).alias(c) for c, s in zip(COUNTS, reversed(R.SEVERITIES))]
    return routed.select("file", "matches", "suppressed", *counts)


def counts(docs: DataFrame, patterns: Sequence[R.Compiled] | None = None, suppress: bool = True, keyword: str = L.KEYWORD) -> DataFrame:
    """(file, critical_count, high_count, medium_count, low_count, n_matches, suppressed_count) of every document.

    The counts of reports() from the hits alone: no finding is put together.
    """
    patterns = list(R.embedded() if patterns is None else patterns)
    ranks = F.array(*[F.lit(R.RANK[p.severity]) for p in patterns] or [F.lit(0)])
    ids = F.array(*[F.lit(p.id) for p in patterns] or [F.lit("")])
    held = F.col("directives")
    kept = F.filter("hits", lambda h: ~L.is_suppressed(held, h["line"], F.element_at(ids, h["ord"] + 1)))
    found = S.once(S.scan_documents(docs, patterns, suppress, keyword=keyword)).select("file", F.size("hits").alias("n"), F.when(F.size(held) == 0, F.col("hits")).otherwise(kept).alias("kept"))
    ranked = S.once(found.select("file", "n", F.transform("kept", lambda h: F.element_at(ranks, h["ord"] + 1)).alias("ranks")))

    def of(rank: int):
        return F.size(F.filter("ranks", lambda r: r == rank)).cast("bigint")

    each = [of(R.RANK[s]).alias(c) for c, s in zip(COUNTS, reversed(R.SEVERITIES))]
    return ranked.select("file", *each, F.size("ranks").cast("bigint").alias("n_matches"), (F.col("n") - F.size("ranks")).cast("bigint").alias("suppressed_count"))


def reports_by_aggregation(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The same from findings at hand (as scan.findings() gives): one shuffle on the file, clean documents joined back."""
    fields = F.struct("line", "ord", "k", *[c for c in S.FINDING if c not in ("line", "file")], "file")
    listed = {n: F.array_sort(F.collect_list(F.when(cond, fields))) for n, cond in (("matches", ~F.col("is_suppressed")), ("suppressed", F.col("is_suppressed")))}
    grouped = found.groupBy("file").agg(*[c.alias(n) for n, c in listed.items()])
    joined = docs.select("file").join(grouped, "file", "left")
    plain = [F.transform(F.coalesce(n, F.array()), lambda f: F.struct(*[f[c].alias(c) for c in S.FINDING])).alias(n) for n in listed]
    return with_counts(joined.select("file", *plain))


def sized(reported: DataFrame) -> DataFrame:
    """reports() as counts() has them."""
    return reported.select("file", *COUNTS, F.size("matches").cast("bigint").alias("n_matches"), F.size("suppressed").cast("bigint").alias("suppressed_count"))


def run_totals(counted: DataFrame) -> DataFrame:
    """One row: sums over the counts of all documents, the documents with suppressed findings, and the exit code."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in (*COUNTS, "suppressed_count")]
    out = counted.agg(
        *sums,
        F.count_if(F.col("suppressed_count") > 0).alias("files_with_suppressions"),
        F.count("*").alias("files"),
        F.coalesce(F.max((F.col("n_matches") > 0).cast("int")), F.lit(0)).alias("exit_code"),
    )
    return out.withColumn("total", F.col("critical_count") + F.col("high_count") + F.col("medium_count") + F.col("low_count"))


def finding_text(prefix: str = ""):
    """A finding's line of the text report, from its columns."""
    c = {n: F.col(prefix + n) for n in S.FINDING}
    return F.concat(F.lit("  :"), c["line"].cast("string"), F.lit(" "), c["severity"], F.lit("  "), c["message"], F.lit(" — "), c["remediation"], F.lit("  ("), c["pattern_id"], F.lit(")"))
