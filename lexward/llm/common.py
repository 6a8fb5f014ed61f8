"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast by hint only when its checked size stays below this.
BROADCAST_BYTES = 32 << 20

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—¿¡•"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; fall back to a local one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexward-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; executors may be lost afterwards."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared checkpoint folder, read again; and the table's path."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of stored() that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def hinted(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows of row_bytes each fit the limit, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def byte_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts whose bytes add up to about limit each."""
    n = len(texts)
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + limit, side="right"))
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def gathered(values: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values with the codes' numbers one after the other, and where each ends; run i ends at ends[i]."""
    sizes = np.diff(ends, prepend=0)[codes]
    out_ends = np.cumsum(sizes)
    at = np.repeat((ends[codes] - out_ends).astype(np.int64), sizes)
    at += np.arange(len(at))
    return values[at], out_ends


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array without nulls (a null becomes an empty text); not copied where it is one already."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.cast(pa.large_string()).combine_chunks()
    return pc.fill_null(texts, "") if texts.null_count else texts


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Whitespace-separated words: for each word its text's index and its code, and the distinct words."""
    split = pc.utf8_split_whitespace(texts)
    counts = np.diff(split.offsets.to_numpy())
    coded = split.flatten().dictionary_encode()
    docs, codes = np.repeat(np.arange(len(counts), dtype=np.int32), counts), coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # before a leading and after a trailing white space
        docs, codes = docs[codes != empty], codes[codes != empty]
    return docs, codes, coded.dictionary


def joined(words: pa.Array, by: str) -> str:
    """The words as one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), by)[0].as_py()


_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, over uint64 values."""
    with np.errstate(over="ignore"):
        x = x + _ODD * np.uint64(2 * seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = 0x100000001B3) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of the bytes of each word (words have no nulls)."""
    words = words.cast(pa.large_binary())
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    lengths = np.diff(offsets)
    out = np.zeros(n, np.uint64)
    some = lengths > 0
    if some.any():
        starts = (offsets[:-1] - offsets[0])[some]
        at = np.arange(len(data)) - np.repeat(starts, lengths[some])
        with np.errstate(over="ignore"):
            out[some] = np.add.reduceat((data + np.uint64(1)) * powers(int(lengths.max()))[at], starts)
    return mix(out ^ (lengths.astype(np.uint64) << np.uint64(40)))
