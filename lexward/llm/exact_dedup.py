"""Exact deduplication by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexward.llm import golomb
from lexward.llm.common import cut, hinted

#: Bits of a fingerprint. Chance collisions only add suspects, which are compared byte by byte.
FINGERPRINT_BITS = 48

#: Fingerprints that an owner holds, about.
OWNED = 1 << 22

_MESSAGE = "sender int, owner int, blob binary"


def _fingerprint(text):
    return F.shiftrightunsigned(F.xxhash64(text), 64 - FINGERPRINT_BITS)


def _send(owners: int):
    """For a partition of fingerprints, one sorted and coded message to each owner of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not parts:
            return
        values = np.sort(np.concatenate(parts).astype(np.int64))
        edges = [-(-(o << FINGERPRINT_BITS) // owners) for o in range(owners + 1)]
        at = np.searchsorted(values, edges)
        rows = [(o, golomb.encode(values[at[o] : at[o + 1]] - edges[o])) for o in range(owners) if at[o] < at[o + 1]]
        sender = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([sender] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
            names=["sender", "owner", "blob"],
        )

    return run


def _judge(messages: pa.Table) -> pa.Table:
    """An owner's answers: for each message the bitmap of its fingerprints that occur more than once in all."""
    values = [golomb.decode(b) for b in messages.column("blob").to_pylist()]
    every = np.concatenate(values)
    distinct, where, counts = np.unique(every, return_inverse=True, return_counts=True)
    marks = np.split(counts[where] > 1, np.cumsum([len(v) for v in values])[:-1])
    return pa.table({"sender": messages.column("sender"), "owner": messages.column("owner"), "bitmap": pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())})


def _marked(owners: int):
    """The sender's side: its marked fingerprints, from its own message and the bitmap that came back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for owner, blob, bitmap in zip(*(batch.column(c).to_pylist() for c in ("owner", "blob", "bitmap"))):
                values = golomb.decode(blob) + -(-(owner << FINGERPRINT_BITS) // owners)
                out.append(np.unique(values[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(values)).astype(bool)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64())], names=["suspect"])

    return run


def suspect_fingerprints(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """The fingerprints that more than one text of docs has, with their number; only coded messages are exchanged."""
    spark = docs.sparkSession
    column = docs[f"`{text}`"]
    # As many owners as there are shuffle partitions, and more where each would hold too many fingerprints.
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNED))
    sent = cut(docs.where(column.isNotNull()).select(_fingerprint(column).alias("fp")).mapInArrow(_send(owners), _MESSAGE))
    answers = sent.groupBy("owner").applyInArrow(_judge, "sender int, owner int, bitmap binary")
    marked = cut(sent.join(answers, ["sender", "owner"]).mapInArrow(_marked(owners), "suspect bigint").distinct())
    return marked, marked.count()


def _digest(text):
    """What stands for a text in the second shuffle, after the first compared the bytes; 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def _later(order):
    """Nulls last, and then by the column."""
    return F.struct(order.isNull().alias("none"), order.alias("id"))


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, bool]:
    """(digest, keep, body) for each text that several rows have, its suspects (id, digest, body), and whether bodies count.

    Suspects alone are shuffled, by their whole text, so equal groups are equal byte for byte. Copies within a
    map task are combined before the shuffle into one row with their least id and number, so a text that is repeated
    very often travels once a task, and no list of its ids is ever made. Where no two of the texts have one digest, which
    is to say always, the texts go no further, and body is null.
    """
    marked, n = suspect_fingerprints(docs, text)
    rows = docs.select(docs[f"`{doc_id}`"].alias("id"), docs[f"`{text}`"].alias("body")).where(F.col("body").isNotNull())
    suspects = rows.join(hinted(marked, n, 40), _fingerprint(F.col("body")) == F.col("suspect"), "left_semi").withColumn("digest", _digest(F.col("body")))
    texts = suspects.groupBy("digest", "body").agg(F.min(_later(F.col("id"))).alias("least"), F.count("*").alias("n"))
    told = cut(texts.select("digest", F.col("least.id").alias("keep"), "n"))
    clashing = told.groupBy("digest").count().where("count > 1").limit(1).count() > 0
    if clashing:
        return cut(texts.where("n > 1").select("digest", F.col("least.id").alias("keep"), "body")), suspects, True
    return told.where("n > 1").select("digest", "keep", F.lit(None).cast("string").alias("body")), suspects, False


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_doc_id) for every row whose text an earlier row has; the row with the least id is kept.

    A null text equals nothing; empty texts equal each other. Null ids come last; a group of null ids only is
    reported with null keep_doc_id. Rows repeated with the same id count as copies: all but one are listed,
    with keep_doc_id equal to doc_id where the kept row has the same id. An empty table gives no rows. Texts
    of any length are compared whole. Other columns are not read, so their names can't clash.
    """
    groups, suspects, by_body = duplicate_groups(docs, doc_id, text)
    side = hinted(groups.withColumnRenamed("body", "of_body"), groups.count(), 80)
    # A text with very many rows is one row of the side, so its rows stay where they are or are split.
    found = suspects.join(side, "digest")
    found = found.where("body = of_body") if by_body else found
    rows = cut(found.select("id", "keep", "digest", "of_body", F.col("id").eqNullSafe(F.col("keep")).alias("kept")))
    later = rows.where("NOT kept").select("id", "keep")
    # Of rows with the kept one's id all but one are listed: their number less one, written out in two steps of bounded arrays.
    again = rows.where("kept").groupBy("digest", "of_body", "id", "keep").count().where("count > 1").withColumn("more", F.col("count") - 1)
    thousands = again.select("id", "keep", "more", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("more") - 1) / 1000))).alias("k"))
    each = thousands.select("id", "keep", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(1000).cast("bigint"), F.col("more") - F.col("k") * 1000))).alias("j"))
    return later.unionAll(each.select("id", "keep")).select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_doc_id"))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return kind.typeName() not in ("map", "variant")


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each text: the one with the least id (a null id comes last).

    Columns stay as they are, clashing names included. Rows with a null text all stay. Among rows with the same
    id and text the least by the other columns stays, maps and variants being compared as JSON. Texts of any length
    are compared whole; an empty table gives no rows.
    """
    marked, n = suspect_fingerprints(docs, text)
    names = docs.columns
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in names if c != text]).alias("row"), docs[f"`{text}`"].alias("body"))
    keyed = keyed.withColumn("fp", F.when(F.col("body").isNotNull(), _fingerprint(F.col("body"))))
    side = hinted(marked, n, 40)
    alone = keyed.join(side, F.col("fp") == F.col("suspect"), "left_anti").select("row", "body")
    others = [F.col(f"row.`{f.name}`") if _orderable(f.dataType) else F.to_json(F.struct(F.col(f"row.`{f.name}`"))) for f in docs.schema if f.name not in (doc_id, text)]
    order = F.struct(F.col(f"row.`{doc_id}`").isNull(), F.col(f"row.`{doc_id}`"), *others)
    kept = keyed.join(side, F.col("fp") == F.col("suspect"), "left_semi").groupBy("body").agg(F.min_by("row", order).alias("row")).select("row", "body")
    return alone.unionAll(kept).select(*[F.col("body").alias(text) if c == text else F.col(f"row.`{c}`") for c in names])


ORACLE = """SELECT doc_id, keep_doc_id FROM (
  SELECT doc_id, first_value(doc_id) OVER w AS keep_doc_id, row_number() OVER w AS n
  FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST)
) WHERE n > 1"""
