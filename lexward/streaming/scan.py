"""The scan over a stream of documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexward.functions import paths
from lexward.operators import report as Rp
from lexward.operators import scan as S
from lexward.plans import registry as R


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content, reason, seen) of the files that arrive in a folder or below it: the batch source's rules.

    A file counts by the extension of its name and is one document, with its bytes as they are; one that isn't UTF-8
    has no content but a reason. Names that begin with '.' or '_' are what writers use for files that aren't ready: the
    stream leaves them alone, and Spark passes over empty files, which have no findings; in both it differs from the batch source.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    file = F.col("path")
    content = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.where(paths.is_scanned(file)).select(file.alias("file"), content.alias("content"), F.when(content.isNull(), F.lit("not valid UTF-8 text")).alias("reason"), F.current_timestamp().alias("seen"))


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content, seen) of the files that can be read."""
    return file_stream(spark, folder).where("reason IS NULL").drop("reason")


def findings(stream: DataFrame, patterns: Sequence[R.Compiled] | None = None, suppress: bool = True) -> DataFrame:
    """Findings of a stream of documents: a document is a row, so there is no state, and rows are appended."""
    return S.findings(stream, patterns, suppress)


def tallies(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes", patterns: Sequence[R.Compiled] | None = None) -> DataFrame:
    """Findings that stay by severity and window of the time 'seen'; windows close when no row can be so late."""
    patterns = list(R.embedded() if patterns is None else patterns)
    marked = stream.withWatermark("seen", late)
    severity = F.array(*[F.lit(p.severity) for p in patterns])
    ids = F.array(*[F.lit(p.id) for p in patterns])
    found = marked.select("seen", S.L.document_directives(F.col("content")).alias("directives"), F.explode(S.document_hits(patterns)).alias("h"))
    kept = found.where(~S.L.is_suppressed(F.col("directives"), F.col("h.line"), F.element_at(ids, F.col("h.ord") + 1)))
    return kept.groupBy(F.window("seen", window), F.element_at(severity, F.col("h.ord") + 1).alias("severity")).agg(F.count("*").alias("n"))


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, patterns: Sequence[R.Compiled] | None = None, suppress: bool = True) -> StreamingQuery:
    """Start a query that hands the reports of each batch of documents to sink, which must bear a batch twice."""
    return _reports(stream, patterns, suppress).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _reports(stream: DataFrame, patterns, suppress) -> DataFrame:
    return Rp.reports(stream, patterns, suppress)
