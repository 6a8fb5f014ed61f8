"""Documents with everything that may go wrong."""

from pyspark.sql import functions as F

#: Names that operators use within.
CLASHING = ("row", "id", "ids", "key", "u", "v", "fp", "body", "f", "p", "p_good", "tokens", "topic", "found", "gone_", "suspect", "c", "n", "keep")

LONG = "lorem ipsum dolor sit amet " * 40_000

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank at dawn", "en", "web"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank at dawn", "en", "web"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank at dawn", "en", "web"),
    (3, "", "en", "web"),
    (4, "", None, None),
    (5, None, "en", "web"),
    (6, None, None, None),
    (None, "a text of its own that nobody else has written before today", "de", "books"),
    (None, "the quick brown fox jumps over the lazy dog near the old river bank at dawn", "de", "books"),
    (7, LONG, "en", "books"),
    (8, LONG, "en", "books"),
    (9, "!!! ??? ...", "fr", "web"),
    (10, "ünïcödé   wörds\t\n and 数字 ١٢٣ \U0001f600 ​ end", "fr", "web"),
]

SCHEMA = "doc_id bigint, text string, lang string, source string"


def messy(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


def empty(spark):
    return messy(spark, []).limit(0)
