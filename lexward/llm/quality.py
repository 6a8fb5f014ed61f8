"""Document quality by a supervised subword classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexward.llm import subwords

#: Labelled documents that the model is fitted on, at most: those of least hash. More don't change it much.
MAX_TRAIN = 2000

#: Bytes of their texts that reach the driver, at most; where whole texts in that order come to more, the rest is left out.
MAX_TRAIN_BYTES = 64 << 20

#: A document is good when its probability is at least this.
THRESHOLD = 0.5


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, limit_bytes: int = MAX_TRAIN_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, class) of up to limit labelled documents, whole, in the order of a hash of their ids.

    Labels without an id or a quality don't count; of several labels of an id the least does. A text under
    several rows of one id is taken once. A text with which they all come to more than limit_bytes is left out, as are
    those after it, so the driver's share is bounded however long the texts are; the rest of the fit isn't.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("class"))
    # The bound is on ids, so the side that is broadcast never exceeds it.
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("id_"), "class")
    rows = docs.select(docs[f"`{doc_id}`"].alias("id_"), docs[f"`{text}`"].alias("text")).where(F.col("text").isNotNull())
    found = rows.join(F.broadcast(picked), "id_").groupBy("id_").agg(F.min("text").alias("text"), F.first("class").alias("class"))
    # At most limit rows go through the window.
    before = F.sum(F.octet_length("text").cast("bigint")).over(Window.orderBy(F.xxhash64("id_"), "id_"))
    return found.withColumn("bytes", before).where(F.col("bytes") <= limit_bytes).orderBy(F.xxhash64("id_"), "id_").select("text", "class")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN, doc_id: str = "doc_id", text: str = "text") -> subwords.Model:
    """The classifier, fitted on the driver on at most limit labelled documents."""
    table = training_rows(docs, labels, limit, doc_id=doc_id, text=text).toArrow()
    classes = (table.column("class").to_numpy() > 0).astype(np.int64)
    return subwords.train(table.column("text"), classes)


def probability(model: subwords.Model, text: Column) -> Column:
    """P(good) of a text. The model is two numbers and an array of fixed size, whatever the corpus."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.probabilities(texts))

    return run(text)


def classify(docs: DataFrame, model: subwords.Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_good, quality) of every row, in one pass without a shuffle.

    quality is 1 for a probability of at least threshold, else 0. A null text has null
    p_good and quality 0; an empty one has no features, so the model's bias decides. Texts of any length count whole. Repeated rows get the same result.
    An empty table gives no rows. Only the two columns named are read.
    """
    column = docs[f"`{text}`"]
    scored = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.when(column.isNotNull(), probability(model, column)).alias("p_good"))
    return scored.withColumn("quality", F.coalesce(F.col("p_good") >= threshold, F.lit(False)).cast("int"))


def keep_good(docs: DataFrame, model: subwords.Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model calls good, with their columns as they were; a null text is rejected.

    An empty text is judged by the model's bias, very long ones by all their words, repeated rows alike. Columns of
    any name pass through, and an empty table gives no rows.
    """
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    scored = row.where(F.col(f"row.`{text}`").isNotNull()).withColumn("p", probability(model, F.col(f"row.`{text}`")))
    return scored.where(F.col("p") >= threshold).select("row.*")
